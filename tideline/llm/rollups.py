"""Token counts as delta-maintained rollups.

A store keeps one folder for each batch, with signed totals by source, language
and tokenizer version. The current totals are the sums over committed batches.
A batch is committed by renaming its finished folder, so a batch that is sent
again (after a lost driver, say) changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import drop_tables, shared_path, stage_table
from tideline.llm.tokens import vocabulary, with_token_counts

KEYS = ["source", "lang", "tokenizer"]
TOTALS = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), T.StructField("n_docs", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_changes", T.LongType())])


def _signed(rows: DataFrame, docs: int, tokens: Column, changes: int = 1) -> DataFrame:
    return rows.select(*KEYS, F.lit(docs).alias("docs"), tokens.cast("long").alias("tokens"), F.lit(changes).alias("changes"))


def inserts(counted: DataFrame) -> DataFrame:
    """Signed rows that add documents. ``counted`` has KEYS and n_tokens."""
    return _signed(counted, 1, F.coalesce("n_tokens", F.lit(0)))


def deletes(counted: DataFrame) -> DataFrame:
    """Signed rows that take documents away again."""
    return _signed(counted, -1, -F.coalesce("n_tokens", F.lit(0)))


def spared(counted: DataFrame) -> DataFrame:
    """Signed rows that take back a delete: the document stays, and its delete is no change."""
    return _signed(counted, 1, F.coalesce("n_tokens", F.lit(0)), -1)


def revisions(revised: DataFrame) -> DataFrame:
    """Signed rows for documents that stay but count otherwise. ``revised`` has KEYS, old_tokens and n_tokens."""
    return _signed(revised, 0, F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0)))


class TokenRollup:
    """The store. Null sources or languages are a group of their own."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or shared_path(spark, "token-rollup")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(self.path))

    def _folders(self, kind: str) -> list[str]:
        names = (x.getPath().getName() for x in self._fs.listStatus(self._hadoop(self.path)))
        return sorted(x for x in names if x.startswith(f"{kind}="))

    def batches(self) -> list[str]:
        """Names of all committed batches, in order of their names."""
        return [x.removeprefix("batch=") for x in self._folders("batch")]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed rows (docs and tokens by KEYS; ``changes`` is 1 where it is missing); False if it was there already, and then nothing is read."""
        final = self._hadoop(f"{self.path}/batch={batch}")
        if self._fs.exists(final):
            return False
        draft = f"{self.path}/_draft-{uuid.uuid4().hex}"
        changes = changes if "changes" in changes.columns else changes.withColumn("changes", F.lit(1))
        totals = changes.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"), F.sum("changes").alias("n_changes"))
        totals.select([F.col(f.name).cast(f.dataType) for f in TOTALS]).write.parquet(draft)
        if self._fs.rename(self._hadoop(draft), final):
            return True
        self._fs.delete(self._hadoop(draft), True)
        return False

    def _uncompacted(self) -> tuple[str | None, list[str]]:
        """The last compacted table and the batches that came after it. A compacted table's name holds their number and a list lies beside it."""
        bases = self._folders("base")
        if not bases:
            return None, self.batches()
        done = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self.path}/{bases[-1]}/batches").collect()}
        return bases[-1], [x for x in self.batches() if x not in done]

    def totals(self) -> DataFrame:
        """Current totals; a group whose documents are all gone stays with zeros."""
        base, names = self._uncompacted()
        paths = [f"{self.path}/{base}/totals"] * bool(base) + [f"{self.path}/batch={x}" for x in names]
        if not paths:
            return self.spark.createDataFrame([], TOTALS)
        parts = self.spark.read.schema(TOTALS).parquet(*paths)
        return parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_changes")))

    def compact(self) -> None:
        """Fold all batches into one table that totals are read from; the batches' folders stay, empty, so that none is taken twice.

        The table is written whole and then renamed into place, so a driver
        that is lost on the way leaves the store as it was.
        """
        base, names = self._uncompacted()
        if not names:
            return
        everything, draft = self.batches(), f"{self.path}/_draft-{uuid.uuid4().hex}"
        self.totals().write.parquet(f"{draft}/totals")
        self.spark.createDataFrame([(x,) for x in everything], "batch string").write.parquet(f"{draft}/batches")
        if self._fs.rename(self._hadoop(draft), self._hadoop(f"{self.path}/base={len(everything):012d}")):
            for x in names:
                for part in self._fs.listStatus(self._hadoop(f"{self.path}/batch={x}")):
                    self._fs.delete(part.getPath(), True)
            if base:
                self._fs.delete(self._hadoop(f"{self.path}/{base}"), True)


def without_repeated_lines(text: str = "text"):
    """The text without lines that are equal to an earlier line of it."""
    return F.array_join(F.array_distinct(F.split(F.col(text), "\n")), "\n")


BATCHES = ("1-insert", "2-delete-copies", "3-revise")


def maintain_counts(docs: DataFrame, path: str | None = None, version: str = "byte_bpe_50k", store: TokenRollup | None = None) -> TokenRollup:
    """Load documents as three batches: insert all, delete exact copies, and revise what repeats its own lines.

    Of rows with equal texts the one with the smallest doc_id stays (at a tie
    that with the smallest source and language, nulls first), and of a row that
    comes several times one stays. A document that stays and repeats lines is
    counted again without the repeats. Null texts have no tokens and are copies
    of no document. Whole texts are counted, however long; other columns are
    ignored. If the store has all three batches, nothing is read.

    Copies are not joined with what they are copies of: all rows with a text
    are deleted, and one row of each text, a minimum that is taken before the
    shuffle too, takes its delete back. So a text that very many rows have
    costs no more than another.
    """
    spark = docs.sparkSession
    path = path or vocabulary()
    store = store or TokenRollup(spark)
    if set(BATCHES) <= set(store.batches()):
        return store
    keys = [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(version).alias("tokenizer")]
    text = F.col("text").cast("string")
    repeats = F.size(F.split(text, "\n")) > F.size(F.array_distinct(F.split(text, "\n")))
    facts = docs.select(F.col("doc_id"), *keys, text.alias("text"), F.sha2(text, 256).alias("digest"), F.when(repeats, without_repeated_lines()).alias("revised"), repeats.alias("repeats"))
    counted = stage_table(spark, with_token_counts(facts, path, n_tokens="text", revised_tokens="revised"), "token-counts")
    store.commit(BATCHES[0], inserts(counted))
    own = F.struct("doc_id", "source", "lang", "tokenizer", "n_tokens", "repeats", "revised_tokens")
    texts = counted.where("digest is not null")
    firsts = stage_table(spark, texts.groupBy("digest").agg(F.min(own).alias("first")).select("first.*"), "token-firsts")
    store.commit(BATCHES[1], deletes(texts).unionByName(spared(firsts)))
    changed = firsts.where("repeats").withColumnRenamed("n_tokens", "old_tokens").withColumnRenamed("revised_tokens", "n_tokens")
    store.commit(BATCHES[2], revisions(changed))
    drop_tables(spark, counted, firsts)
    return store
