"""Queries on role projections, leakage screens and plan-time column choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import roles as R
from tideline.plans.registry import load, query


def decision_points(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = load(spark, d, "events")
    return ev.select("event_id", "user_id", "ts", F.col("value").alias("state_value"), F.lag("value").over(w).alias("state_prior_value"), F.lead("value").over(w).alias("state_next_value"), F.col("event_type").alias("target_type"), F.lead("event_type").over(w).alias("outcome_type"))


@query("SELECT event_id, user_id, value AS state_value, lag(value) OVER w AS state_prior_value, event_type AS target_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def p02_p03_leakage_screen(spark, d):
    """The next value is known only later, so it goes."""
    return R.leakage_screen(decision_points(spark, d), ids=["event_id", "user_id"], safe=["state_value", "state_prior_"], labels=["target_"])[0]


@query("SELECT unnest(['ts', 'state_next_value', 'outcome_type']) AS dropped, (SELECT count(*) FROM events) AS n_rows")
def p03_dropped_columns(spark, d):
    points = decision_points(spark, d)
    kept, dropped = R.leakage_screen(points, ids=["event_id", "user_id"], safe=["state_value", "state_prior_"], labels=["target_"])
    names = F.explode(F.array(*map(F.lit, dropped))).alias("dropped")
    return kept.agg(F.count("*").alias("n_rows")).select(names, "n_rows")


@query("SELECT event_id, value AS state_value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS state_prior_value, lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS state_next_value FROM events")
def p04_feature_frame(spark, d):
    points = decision_points(spark, d)
    return R.feature_frame(points, drop=["user_id", "ts"], prefixes=["target_", "outcome_"], keep=["event_id"])


@query("SELECT event_id, user_id, value, value > 100 AND event_type = 'view' AS eligible FROM events WHERE value > 100 AND event_type = 'view'")
def p16_eligible_filter(spark, d):
    ev = load(spark, d, "events").withColumn("has_value", (F.col("value") > 100).cast("int")).withColumn("has_view", (F.col("event_type") == "view").cast("int"))
    return R.eligible(ev, ["value", "view"]).select("event_id", "user_id", "value", F.lit(True).alias("eligible"))


@query("WITH t AS (SELECT CASE WHEN event_type = 'error' THEN NULL ELSE value END AS temp_mean, event_type FROM events) SELECT 'weather' AS feature_group, CAST(1 AS BIGINT) AS n_features, count(temp_mean) AS n_known, count(*) AS n_rows FROM t UNION ALL SELECT 'temporal', 2, 2 * count(*), count(*) FROM t UNION ALL SELECT 'other', 1, count(event_type), count(*) FROM t")
def p18_feature_groups(spark, d):
    """Columns by what their names say, and how many known values each group has."""
    ev = load(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("value")).alias("temp_mean"), F.hour("ts").alias("hour_no"), F.weekday("ts").alias("weekday_no"), "event_type")
    groups = R.group_features(ev.columns, {"weather": ["temp", "rain"], "temporal": ["hour", "weekday"]})
    known = ev.agg(F.count("*").alias("n_rows"), *(F.count(c).alias(c) for c in ev.columns))
    counted = F.inline(F.array(*(F.struct(F.lit(g).alias("feature_group"), F.lit(len(c)).cast("long").alias("n_features"), sum((F.col(x) for x in c[1:]), F.col(c[0])).alias("n_known")) for g, c in groups.items())))
    return known.select(counted, "n_rows")


@query("SELECT event_id, user_id AS entity_id, ts AS event_time, value AS src__value, props AS src__props, event_type AS src__event_type, user_id AS src__user_id, ts AS src__ts, event_id AS src__event_id FROM events WHERE ts IS NOT NULL")
def p14_p21_standardize_source(spark, d):
    return R.standardize(load(spark, d, "events"), {"event_id": "event_id", "entity_id": "user_id", "event_time": "ts"}, required=["event_time"])


@query("SELECT event_id, CAST(NULL AS DOUBLE) AS value, event_type FROM events")
def p22_neutralize(spark, d):
    return R.neutralize(load(spark, d, "events"), ["value"]).select("event_id", "value", "event_type")


@query("SELECT lang, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS place, count(*) AS n FROM documents GROUP BY 1, 2")
def p20_sort_key(spark, d):
    place = R.custom_order(F.col("lang"), ["en", "de"])
    return load(spark, d, "documents").groupBy("lang", place.alias("place")).agg(F.count("*").alias("n"))


@query("WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, role, i AS ordinal, round(CASE WHEN n = 1 THEN 12.0 ELSE 7 + 15.0 * i / (n - 1) END, 6)::DOUBLE AS spread_hour FROM t")
def w14_w16_spread_times(spark, d):
    w = Window.partitionBy("conv_id")
    i, n = F.row_number().over(w.orderBy("turn")) - 1, F.count("*").over(w)
    return load(spark, d, "conversations").select("conv_id", "turn", "role", i.cast("long").alias("ordinal"), F.round(F.when(n == 1, 12.0).otherwise(7 + 15.0 * i / F.nullif(n - 1, F.lit(0))), 6).alias("spread_hour"))


@query("WITH t AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT i, avg(x::DOUBLE) AS mean, greatest(stddev_pop(x::DOUBLE), 1e-6) AS std FROM t WHERE vec_id % 10 < 8 GROUP BY 1) SELECT CAST(i - 1 AS INTEGER) AS place, round(mean, 5) AS mean, round(std, 5) AS std FROM s")
def w22_masked_mean_std(spark, d):
    e = load(spark, d, "embeddings").where("vec_id % 10 < 8").select(F.posexplode("embedding").alias("place", "x"))
    x = F.col("x").cast("double")
    return e.groupBy("place").agg(F.round(F.avg(x), 5).alias("mean"), F.round(F.greatest(F.stddev_pop(x), F.lit(1e-6)), 5).alias("std"))
