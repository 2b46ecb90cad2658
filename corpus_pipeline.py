"""From documents to packed training sequences, in five stages.

Each stage reads all that its predecessor kept, from a Parquet table in the
shared folder, and all but the last return the columns of documents, whatever
these are called. Texts may be of any length, and rows without a doc_id are
documents of their own. A row that comes several times stays as often, since
rows with one doc_id are one document. No documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import langid
from tideline.llm.common import WORD, stage_table, table
from tideline.llm.decontamination import decontaminate
from tideline.llm.jaccard_join import near_duplicates
from tideline.llm.line_dedup import deduplicate_lines
from tideline.llm.packing import pack


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learned stay; null texts and texts without letters, or with none of its n-grams, go."""
    profiles = langid.learn_profiles(langid.learning_rows(docs))
    return langid.accepted(docs, profiles)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go from all documents but the first; a document that loses its last word goes too."""
    done = deduplicate_lines(docs, out="_lines")
    emptied = (F.col("_lines.n_dropped") > 0) & ~F.col("text").rlike(WORD)
    changed = F.when(F.col("_lines.n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.where(~emptied).withColumn("n_chars", changed).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; rows with one doc_id are one document."""
    others = near_duplicates(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in training sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the profiles nor the tokens nor the search; tests/llm/test_pipeline.py holds the stages against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder: doc_id, piece, start, length, ids_crc32, sequence_id and offset of each packed piece."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
