"""Line deduplication by a log-template tree.

A line's path in the tree is its token count and its leading tokens; tokens
with digits are variable from the start, as long as enough plain tokens are
left to tell the line by (else the line is compared as it is). In a leaf with
several templates, fields are learned: first tokens that no other template of
the leaf has in their place, then, in rounds, the place in which most templates
differ that agree in all others. Counts are absolute, so what becomes a field
does not depend on how many unlike lines a leaf holds. A template that recurs
across documents stays in the document with the smallest doc_id and is dropped
from the others, whatever else two documents share.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import drop_tables, hash_bitmap, join_hot, slices, stage_table

VARIABLE, MASK = 0, b"\0"
DIGIT = re.compile(rb"[0-9]")
LEAF_BITS = 1 << 22


@dataclass(frozen=True)
class TreeSettings:
    """``depth``: leading tokens of a path. ``constant``: share of a line that must stay constant, and ``least_plain`` tokens at least.

    ``least_constant``: constant tokens that a line with learned fields must
    have, so that short prose with a common opening is not taken for a
    template. ``rounds``: how many fields are learned beyond tokens that are
    unlike all others in their place.
    """

    depth: int = 3
    constant: float = 0.6
    least_plain: int = 2
    least_constant: int = 6
    rounds: int = 2


def line_keys(text: str | None, s: TreeSettings) -> Iterator[tuple[int, list[bytes], int]]:
    """Of each line with a word: its number, its words with those with digits masked (where enough are left), and its leaf."""
    for number, line in enumerate((text or "").encode("utf-8", "surrogatepass").split(b"\n")):
        words = line.split()
        if not words:
            continue
        if DIGIT.search(line):
            masked = [MASK if DIGIT.search(w) else w for w in words]
            plain = len(masked) - masked.count(MASK)
            if plain >= s.least_plain and plain >= s.constant * len(masked):
                words = masked
        yield number, words, xxh3_64_intdigest(b" ".join(words[: s.depth]), len(words))


def template_hash(words: list[bytes]) -> int:
    return xxh3_64_intdigest(b" ".join(words))


def _token_hash(token: bytes) -> int:
    return VARIABLE if token == MASK else xxh3_64_intdigest(token) | 1


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _lines(docs: DataFrame, s: TreeSettings) -> DataFrame:
    """doc_id, text_key, line, words, template and leaf of each line with a word. Token counts are part of a template's key."""

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, numbers, words, templates, leaves = [], [], [], [], []
            for row, text in enumerate(batch.column(2)):
                for number, tokens, leaf in line_keys(text.as_py(), s):
                    rows.append(row)
                    numbers.append(number)
                    words.append(len(tokens))
                    templates.append(template_hash(tokens))
                    leaves.append(leaf)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(words, pa.int32()), _longs(templates), _longs(leaves)], names=["doc_id", "text_key", "line", "words", "template", "leaf"])

    return docs.select("doc_id", "text_key", "text").mapInArrow(parse, "doc_id long, text_key long, line int, words int, template long, leaf long")


def _leaf_templates(docs: DataFrame, leaves: DataFrame, s: TreeSettings) -> DataFrame:
    """leaf, template, words, token hashes, and first and last document of the templates in the given leaves, from the texts.

    The leaves go to the tasks as a bitmap of fixed size that lets some more
    lines through; a join drops these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hash_bitmap(leaves, "leaf", LEAF_BITS))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.tolist()
        for batch in slices(batches):
            found: dict[tuple[int, int, int], tuple[np.ndarray, list[int]]] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for _, tokens, leaf in line_keys(text.as_py(), s):
                    bit = leaf % LEAF_BITS
                    if doc_id is not None and known[bit >> 5] >> (bit & 31) & 1 and len(tokens) > s.least_constant:
                        key = (leaf, template_hash(tokens), len(tokens))
                        if key in found:
                            ids = found[key][1]
                            ids[:] = min(ids[0], doc_id), max(ids[1], doc_id), ids[2] + 1
                        else:
                            found[key] = np.array(list(map(_token_hash, tokens)), np.uint64), [doc_id, doc_id, 1]
            ends = np.cumsum([0, *(len(x) for x, _ in found.values())]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *(x for x, _ in found.values())])
            ids = [pa.array([x[i] for _, x in found.values()], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([_longs([x[0] for x in found]), _longs([x[1] for x in found]), pa.array([x[2] for x in found], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))), *ids], names=["leaf", "template", "words", "tokens", "lo", "hi", "times"])

    picked = docs.select("doc_id", "text").mapInArrow(pick, "leaf long, template long, words int, tokens array<long>, lo long, hi long, times long")
    return picked.join(leaves, "leaf", "left_semi").groupBy("leaf", "template", "words").agg(F.first("tokens").alias("tokens"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("times").alias("times"))


def _enough(tokens: Column, s: TreeSettings) -> Column:
    """Whether enough of a template is constant."""
    constants = F.size(F.filter(tokens, lambda x: x != VARIABLE))
    return (constants >= s.least_constant) & (constants >= s.constant * F.size(tokens))


def _general(leaf: str, tokens: str) -> Column:
    return F.xxhash64(leaf, tokens)


def _learn_fields(templates: DataFrame, s: TreeSettings) -> DataFrame:
    """template, words, lo, hi, times and general, the template with its fields learned, of each template of the leaves."""
    spark = templates.sparkSession
    places = templates.select("leaf", "template", F.posexplode("tokens").alias("place", "token"))
    lonely = places.groupBy("leaf", "place", "token").agg(F.min("template").alias("template"), F.count("*").alias("n")).where(f"n = 1 and token <> {VARIABLE}")
    lonely = lonely.groupBy("leaf", "template").agg(F.collect_set("place").alias("alone"))
    masked = F.transform("tokens", lambda x, i: F.when(F.array_contains("alone", i), F.lit(VARIABLE).cast("long")).otherwise(x))
    joined = templates.join(lonely, ["leaf", "template"], "left").withColumn("masked", F.when(F.col("alone").isNotNull(), masked))
    joined = joined.withColumn("tokens", F.when(F.coalesce(_enough(F.col("masked"), s), F.lit(False)), F.col("masked")).otherwise(F.col("tokens")))
    held = stage_table(spark, joined.select("leaf", "template", "words", "lo", "hi", "times", "tokens", _general("leaf", "tokens").alias("general")), "line-generals")
    for _ in range(s.rounds):
        generals = held.select("leaf", "general", "tokens").dropDuplicates(["general"])
        several = generals.groupBy("leaf").count().where("count > 1").select("leaf")
        generals = generals.join(several, "leaf", "left_semi")
        # One number for all tokens in their places, from which one token's own can be taken out again.
        whole = F.aggregate("tokens", F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("h")), lambda a, x: F.struct((a["i"] + 1).alias("i"), a["h"].bitwiseXOR(F.xxhash64(a["i"], x)).alias("h")), lambda a: a["h"])
        numbered = generals.withColumn("whole", whole)  # before the explosion, so once for each template
        others = numbered.select("leaf", "general", "whole", F.posexplode("tokens").alias("place", "token")).where(F.col("token") != VARIABLE)
        others = others.select("general", "place", F.xxhash64("leaf", "place", F.col("whole").bitwiseXOR(F.xxhash64("place", "token"))).alias("rest"))
        alike = others.groupBy("rest").agg(F.count("*").alias("n")).where("n > 1")
        best = others.join(alike, "rest").groupBy("general").agg(F.max(F.struct("n", (-F.col("place")).alias("minus"))).alias("best")).select("general", (-F.col("best.minus")).alias("field"))
        field = F.transform("tokens", lambda x, i: F.when(i == F.col("field"), F.lit(VARIABLE).cast("long")).otherwise(x))
        more = held.join(best, "general", "left").withColumn("masked", F.when(F.col("field").isNotNull(), field))
        more = more.withColumn("tokens", F.when(F.coalesce(_enough(F.col("masked"), s), F.lit(False)), F.col("masked")).otherwise(F.col("tokens")))
        after = stage_table(spark, more.select("leaf", "template", "words", "lo", "hi", "times", "tokens", _general("leaf", "tokens").alias("general")), "line-generals")
        drop_tables(spark, held)
        held = after
    return held.drop("leaf", "tokens")


def dropped_lines(docs: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """doc_id, text_key, line (from 0), words, template and owner (the document that keeps it) of the lines to drop.

    ``text_key`` is the hash of the row's text, so rows that share a doc_id but
    not a text lose their own lines only.
    """
    s, spark = settings, docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    lines = stage_table(spark, _lines(docs, s), "lines")
    own = lines.where(F.col("words") > s.least_constant).select("leaf", "template", "words").distinct()
    leaves = stage_table(spark, own.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf"), "leaves")
    templates = stage_table(spark, _leaf_templates(docs, leaves, s), "leaf-templates")
    learned = _learn_fields(templates, s)
    groups = learned.groupBy("general").agg(F.min("lo").alias("owner"), F.max("hi").alias("last")).where("owner < last")
    by_field = learned.join(groups, "general").select("template", "words", "owner", "times")
    plain = lines.groupBy("template", "words").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("times")).where("owner < last")
    plain = plain.drop("last").join(learned.select("template", "words"), ["template", "words"], "left_anti")
    owned = stage_table(spark, plain.unionByName(by_field), "recurring")
    drop_tables(spark, leaves, templates)
    found = join_hot(lines.select("doc_id", "text_key", "line", "words", "template"), owned, ["template", "words"])
    return found.where("doc_id <> owner").drop("times")


def deduplicate_lines(docs: DataFrame, settings: TreeSettings = TreeSettings(), out: str = "dedup") -> DataFrame:
    """All columns with the text without recurring lines, and a struct ``out``: n_lines, n_dropped and words_dropped.

    Lines end at line feeds; blank lines stay, and null texts stay null. Of a
    line of any length, the document with the smallest doc_id keeps all that
    have its template. Rows with one doc_id are one document and take no lines
    from each other; rows without a doc_id stay whole. A column of the struct's
    name is replaced. No rows give no rows.
    """
    drops = dropped_lines(docs, settings).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("gone"), F.collect_set(F.struct("line", "words")).alias("sizes"))
    drops = drops.select(F.col("doc_id").alias("_drop_id"), F.col("text_key").alias("_drop_key"), F.col("gone").alias("_gone"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("_gone_words"))
    # The other columns travel as one struct, so their names can't clash with those used here.
    whole = docs.select(F.struct(*(c for c in docs.columns if c != "text")).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text"))
    joined = whole.join(drops, (F.col("_id") == F.col("_drop_id")) & (F.xxhash64("_text") == F.col("_drop_key")), "left").withColumn("_parts", F.split("_text", "\n", -1))
    numbers = F.sequence(F.lit(0), F.size("_parts") - 1)
    kept = F.transform(F.array_except(numbers, F.col("_gone")), lambda i: F.element_at("_parts", i + 1))
    left = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    counts = F.struct(F.coalesce(F.size("_parts"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).alias("n_dropped"), F.coalesce("_gone_words", F.lit(0)).alias("words_dropped"))
    return joined.select(*(left.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns if c != out), counts.alias(out))
