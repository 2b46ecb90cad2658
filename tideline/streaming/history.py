"""A history of scores that micro-batches add to, and the watch payload that is read from it.

Three tables by entity: how often each score occurred, the last scores, and
how many windows of the last scores had how many positives. All add up, so a
batch is worked out from its own rows and the last scores alone. What a batch
adds is a folder named by the batch's number, which is overwritten if the batch
is sent again; reading for a batch leaves out its own and later folders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.evaluation import exact_quantiles


class History:
    """Kept at ``path``. Rows have entity_id, ts, id and score (null scores are left out); they come in the order of time, batch by batch.

    ``window``: how many of the last scores are recent; ``threshold``: from
    where on a score is positive; ``fold``: after how many batches the counts
    are added up into one folder, so that few are read.
    """

    def __init__(self, spark: SparkSession, path: str, entity_type: T.DataType, window: int = 20, threshold: float = 0.5, fold: int = 16):
        self.spark, self.path, self.window, self.threshold, self.fold = spark, path, window, threshold, fold
        e = T.StructField("entity_id", entity_type)
        long = lambda x: T.StructField(x, T.LongType())
        score, ts = T.StructField("score", T.DoubleType()), T.StructField("ts", T.TimestampType())
        self.schemas = {"counts": T.StructType([e, score, long("n")]), "windows": T.StructType([e, long("positives"), long("n")]), "recent": T.StructType([e, ts, long("id"), score])}

    def _folders(self, table: str) -> list[tuple[int, str]]:
        """Numbers of what is committed, whole ones only: a folder without _SUCCESS is of a batch that broke off."""
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        root = fs_path(f"{self.path}/{table}")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [(x.getPath().getName(), x.getPath()) for x in fs.listStatus(root)]
        return sorted((int(name.split("=")[1]), name.split("=")[0]) for name, p in found if fs.exists(fs_path(p, "_SUCCESS")))

    def _read(self, table: str, before: int) -> DataFrame:
        """Counts that batches before this one have added: the last sum, and what came after it."""
        folders = [x for x in self._folders(table) if x[0] < before]
        base = max((n for n, kind in folders if kind == "sum"), default=None)
        paths = [f"{self.path}/{table}/{kind}={n}" for n, kind in folders if (kind == "sum" and n == base) or (kind == "batch" and (base is None or n > base))]
        return self.spark.read.schema(self.schemas[table]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[table])

    def _last(self, before: int) -> DataFrame:
        """The recent scores of all entities as they were before a batch."""
        n = max((n for n, _ in self._folders("recent") if n < before), default=None)
        return self.spark.createDataFrame([], self.schemas["recent"]) if n is None else self.spark.read.schema(self.schemas["recent"]).parquet(f"{self.path}/recent/batch={n}")

    def counts(self, before: int = 1 << 60) -> DataFrame:
        return self._read("counts", before).groupBy("entity_id", "score").agg(F.sum("n").alias("n"))

    def windows(self, before: int = 1 << 60) -> DataFrame:
        return self._read("windows", before).groupBy("entity_id", "positives").agg(F.sum("n").alias("n"))

    def add(self, rows: DataFrame, number: int) -> None:
        """Commit a batch; sent again under its number, it changes nothing. Its recent scores are written last and mark it as done."""
        rows = rows.select("entity_id", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score")).where(F.col("score").isNotNull())
        order = Window.partitionBy("entity_id").orderBy("ts", "id")
        both = self._last(number).withColumn("new", F.lit(False)).unionByName(rows.withColumn("new", F.lit(True)))
        last = order.rowsBetween(-(self.window - 1), 0)
        seen = both.withColumn("k", F.count("*").over(last)).withColumn("positives", F.sum((F.col("score") >= self.threshold).cast("long")).over(last))
        tables = {
            "counts": rows.groupBy("entity_id", "score").agg(F.count("*").alias("n")),
            "windows": seen.where(F.col("new") & (F.col("k") == self.window)).groupBy("entity_id", "positives").agg(F.count("*").alias("n")),
            "recent": both.withColumn("back", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("ts"), F.desc("id")))).where(F.col("back") <= self.window).select("entity_id", "ts", "id", "score"),
        }
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")
        if number and number % self.fold == 0:
            for name, total in (("counts", self.counts(number + 1)), ("windows", self.windows(number + 1))):
                total.write.mode("overwrite").parquet(f"{self.path}/{name}/sum={number}")

    def payload(self, zone: tuple[float, float], before: int = 1 << 60) -> DataFrame:
        """The watch payload of each entity, from what is kept before a batch."""
        return watch_payload(self._last(before), self.counts(before), self.windows(before), self.window, self.threshold, zone)


def watch_payload(recent: DataFrame, counts: DataFrame, windows: DataFrame, window: int, threshold: float, zone: tuple[float, float]) -> DataFrame:
    """A row for each entity: its latest score against the history's q10 to q90, the recent rate against the band of rates, and the promotion zone.

    Rates have no band where the history is shorter than a window; such
    entities are not watched for their rate.
    """
    last = recent.groupBy("entity_id").agg(
        F.max_by("score", F.struct("ts", "id")).alias("latest"), F.count("*").alias("n_recent"), F.avg("score").alias("recent_mean"), F.stddev_pop("score").alias("recent_std"), F.min("score").alias("recent_min"), F.max("score").alias("recent_max"),
        F.avg((F.col("score") >= threshold).cast("double")).alias("recent_rate"),
    )
    scores = exact_quantiles(counts, ["entity_id"], "score", [0.1, 0.9], weight="n").select("entity_id", F.col("q")[0].alias("q10"), F.col("q")[1].alias("q90"))
    rates = windows.select("entity_id", (F.col("positives") / window).alias("rate"), "n")
    rates = exact_quantiles(rates, ["entity_id"], "rate", [0.1, 0.9], weight="n").select("entity_id", F.col("q")[0].alias("rate_q10"), F.col("q")[1].alias("rate_q90"))
    out = last.join(scores, "entity_id").join(rates, "entity_id", "left")
    status = lambda flag: F.when(F.coalesce(flag, F.lit(False)), "watch").otherwise("ok")
    return out.select(
        "*", status((F.col("latest") < F.col("q10")) | (F.col("latest") > F.col("q90"))).alias("latest_status"),
        status((F.col("recent_rate") < F.col("rate_q10")) | (F.col("recent_rate") > F.col("rate_q90"))).alias("rate_status"), status(F.col("latest").between(*zone)).alias("zone_status"),
    )
