"""Helpers that all text operators share: tables, shared storage, and small hashing tools."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir. Where it is unset, a temporary one if Spark runs in one process, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/tideline/{name}-{uuid.uuid4().hex}"


def stage_table(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def drop_table(spark: SparkSession, df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(df.staged_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_tables(spark: SparkSession, *tables: DataFrame) -> None:
    for df in tables:
        drop_table(spark, df)


class Memo(dict):
    """What ``of`` gave for its arguments, for one task: made in the task's function, it ends with it.

    It begins anew once its entries take about ``limit`` bytes; arguments over
    ``longest`` characters are not kept.
    """

    def __init__(self, of: Callable, limit: int = 24 << 20, entry: int = 190, longest: int = 64):
        super().__init__()
        self.of, self.limit, self.entry, self.longest, self.room = of, limit, entry, longest, limit

    def __missing__(self, key):
        value = self.of(key)
        if len(key) <= self.longest:
            if self.room <= 0:
                self.clear()
                self.room = self.limit
            self.room -= self.entry + len(key)
            self[key] = value
        return value


def slices(batches: Iterable, rows: int = 1024) -> Iterator:
    """Arrow batches in parts of at most some rows, so that what is made of a part stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def join_hot(left: DataFrame, right: DataFrame, key: list[str], share: int = 1000) -> DataFrame:
    """Inner join of many rows with a table of one row for each key and ``times``, how many rows of the left have it.

    Keys of more than one row in ``share`` number fewer than ``share``, so they
    are broadcast and their rows stay where they are; all other keys are dealt
    out, each with few rows. ``right`` is a staged table.
    """
    rows = right.agg(F.sum("times")).first()[0] or 0
    least = max(1000, rows // share)
    hot, cold = right.where(F.col("times") > least), right.where(F.col("times") <= least)
    if not hot.head(1):
        return left.join(cold, key)
    few = left.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key)
    many = left.join(F.broadcast(hot), key)
    return few.unionByName(many)


def hash_bitmap(hashed: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of fixed size of the column's values by their remainder; it never misses one, and false hits do no harm."""
    placed = hashed.select(F.pmod(column, F.lit(bits)).alias("bit")).selectExpr("shiftright(bit, 5) as w", "shiftleft(1L, cast(bit % 32 as int)) as x")
    out = np.zeros(bits // 32, np.uint32)
    for r in placed.groupBy("w").agg(F.bit_or("x").alias("x")).collect():
        out[r["w"]] = r["x"]
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether unsigned hashes may be in a bitmap; 2**64 is a multiple of its size, so signed remainders are the same."""
    at = (hashes % np.uint64(len(bitmap) * 32)).astype(np.int64)
    return (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def fold(column: str, modulus: int):
    """crc32 of an id as text, by a modulus: the split into learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def sample_share(rows: int, bound: int) -> float:
    """Share of rows to learn from, so that about ``bound`` rows are used at most."""
    return 1.0 if rows <= bound else bound / rows


def in_sample(column: str, share: float):
    """A sample that depends on the id alone, so it is the same however the rows are dealt."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(F.col(column), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))
