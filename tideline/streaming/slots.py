"""Streaming twins of batch operators: slot rollups with a watermark, and checks of each micro-batch against a kept history."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.evaluation import exact_quantiles
from tideline.sources.shared import staged


def slot_rollup(events: DataFrame, minutes: int = 15, watermark: str = "1 hour") -> DataFrame:
    """Mean and sum by entity and tumbling slot. A row later than the watermark is dropped by Spark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    slots = timed.groupBy("entity_id", F.window("ts", f"{minutes} minutes").alias("w")).agg(F.avg("value").alias("level"), F.sum("value").alias("amount"), F.count("*").alias("n"))
    return slots.select("entity_id", F.col("w.start").alias("slot"), "level", "amount", "n")


def finished_slots(events: DataFrame, out: str, minutes: int = 15, hours: int = 1) -> tuple[DataFrame, int]:
    """All slots of a source that has ended, each written once, and how many late rows were dropped.

    In append mode the slots of the last hours stay open, as the watermark never
    passes them. So once the source is read to its end, a closing row later than
    any event and the watermark is sent through the same query, from a folder
    that the query also watches. The closing row's own slot never ends, so it
    is not written. ``events`` is a stream of entity_id, ts and value.
    """
    spark = events.sparkSession
    plain = events.select("entity_id", F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    closing = f"{out}/closing"
    spark.createDataFrame([], plain.schema).write.mode("overwrite").parquet(closing)
    both = plain.unionByName(spark.readStream.schema(plain.schema).parquet(closing))
    latest, late = None, 0

    def run() -> None:
        nonlocal latest, late
        job = slot_rollup(both, minutes, f"{hours} hours").writeStream.outputMode("append").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{out}/slots")
        job.awaitTermination()
        for progress in job.recentProgress:
            late += sum(x.numRowsDroppedByWatermark for x in progress.stateOperators)
            if (top := (progress.eventTime or {}).get("max")) and (latest is None or top > latest):
                latest = top

    run()
    if latest is not None:
        end = datetime.datetime.fromisoformat(latest) + datetime.timedelta(hours=hours, minutes=2 * minutes)
        spark.range(1).select(F.lit(None).cast(plain.schema["entity_id"].dataType).alias("entity_id"), F.lit(end).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("value")).write.mode("append").parquet(closing)
        run()
    schema = slot_rollup(spark.createDataFrame([], plain.schema), minutes).schema
    return spark.read.schema(schema).parquet(f"{out}/slots"), late


def watch_checks(history: DataFrame, entity: str = "entity_id", value: str = "value") -> Callable[[DataFrame], DataFrame]:
    """A function of a batch of scores: rows outside the history's q10 to q90 of their entity. The history is read once, before the first batch."""
    bounds = staged(exact_quantiles(history, [entity], value, [0.1, 0.9]).select(entity, F.col("q").alias("_q")), "watch-bounds")

    def check(batch: DataFrame) -> DataFrame:
        outside = (F.col(value) < F.col("_q")[0]) | (F.col(value) > F.col("_q")[1])
        return batch.join(bounds, entity).where(outside).drop("_q")

    return check
