"""Queries that run a stream over the tables' files to its end and return what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans.registry import load, query
from tideline.sources.shared import shared_path
from tideline.streaming import slots as W
from tideline.streaming.history import History


def _source(spark, d) -> DataFrame:
    schema = load(spark, d, "events").schema
    # As a pattern, so that the table may be a file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumnRenamed("user_id", "entity_id")


@query("SELECT user_id AS entity_id, time_bucket(INTERVAL 15 MINUTE, ts) AS slot, round(avg(value), 6) AS level, round(sum(value), 6) AS amount, count(*) AS n FROM events GROUP BY 1, 2")
def x01_stream_slot_rollup(spark, d):
    """All slots of the stream, each written once: a closing row lets the last ones end too."""
    slots, _ = W.finished_slots(_source(spark, d), shared_path(spark, "stream-slots"))
    return slots.select("entity_id", F.col("slot").cast("timestamp_ntz").alias("slot"), F.round("level", 6).alias("level"), F.round("amount", 6).alias("amount"), "n")


@query("WITH q AS (SELECT user_id, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi FROM events WHERE event_type <> 'purchase' GROUP BY 1) SELECT e.event_id, e.user_id AS entity_id, e.value FROM events e JOIN q USING (user_id) WHERE e.event_type = 'purchase' AND (e.value < lo OR e.value > hi)")
def x02_stream_watch(spark, d):
    out = shared_path(spark, "stream-watch")
    history = load(spark, d, "events").where("event_type <> 'purchase'").withColumnRenamed("user_id", "entity_id")
    check = W.watch_checks(history)

    def keep(batch: DataFrame, number: int) -> None:
        check(batch.select("event_id", "entity_id", "value")).write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    job = _source(spark, d).where("event_type = 'purchase'").writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    job.awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("event_id", "entity_id", "value")


@query("""WITH s AS (SELECT user_id, ts, event_id, round(value / 500, 4) AS score FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, row_number() OVER u AS nth, avg(CASE WHEN score >= 0.2 THEN 1.0 ELSE 0.0 END) OVER (u ROWS 19 PRECEDING) AS rate FROM s WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT user_id, max(CASE WHEN back = 1 THEN score END) AS latest, count(*) AS n_recent, avg(score) AS recent_mean, stddev_pop(score) AS recent_std, min(score) AS recent_min, max(score) AS recent_max, avg(CASE WHEN score >= 0.2 THEN 1.0 ELSE 0.0 END) AS recent_rate FROM o WHERE back <= 20 GROUP BY 1),
 q AS (SELECT user_id, quantile_cont(score, 0.1) AS q10, quantile_cont(score, 0.9) AS q90 FROM o GROUP BY 1), w AS (SELECT user_id, quantile_cont(rate, 0.1) AS rate_q10, quantile_cont(rate, 0.9) AS rate_q90 FROM o WHERE nth >= 20 GROUP BY 1)
 SELECT r.user_id AS entity_id, latest, n_recent, round(recent_mean, 6) AS recent_mean, round(recent_std, 6) AS recent_std, recent_min, recent_max, round(recent_rate, 6)::DOUBLE AS recent_rate, round(q10, 6) AS q10, round(q90, 6) AS q90, round(rate_q10, 6)::DOUBLE AS rate_q10, round(rate_q90, 6)::DOUBLE AS rate_q90,
 CASE WHEN latest < q10 OR latest > q90 THEN 'watch' ELSE 'ok' END AS latest_status, CASE WHEN round(recent_rate, 9) < round(rate_q10, 9) OR round(recent_rate, 9) > round(rate_q90, 9) THEN 'watch' ELSE 'ok' END AS rate_status, CASE WHEN latest BETWEEN 0.15 AND 0.25 THEN 'watch' ELSE 'ok' END AS zone_status FROM r JOIN q USING (user_id) LEFT JOIN w USING (user_id)""")
def x02_stream_watch_payload(spark, d):
    """Each micro-batch adds to a kept history; the payload after the last one is that of all rows together."""
    out = shared_path(spark, "stream-history")
    source = _source(spark, d).select("entity_id", "ts", F.col("event_id").alias("id"), F.round(F.col("value") / 500, 4).alias("score"))
    history = History(spark, f"{out}/history", source.schema["entity_id"].dataType, threshold=0.2)
    job = source.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(history.add).start()
    job.awaitTermination()
    seen = history.payload((0.15, 0.25))
    rounded = ("recent_mean", "recent_std", "recent_rate", "q10", "q90", "rate_q10", "rate_q90")
    return seen.select(*(F.round(c, 6).alias(c) if c in rounded else c for c in seen.columns))
