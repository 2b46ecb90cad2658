"""Queries on column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.plans.registry import load, query


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN 1.0 WHEN event_type = 'error' THEN 0.0 END::DOUBLE AS flag, least(greatest(value, 10.0), 100.0) AS clipped, round(CASE WHEN value IS NULL THEN 0.5 ELSE least(greatest((value - 0.0) / 200.0, 0), 1) END, 6) AS score, round(1 - CASE WHEN value IS NULL THEN 0.5 ELSE least(greatest(value / 200.0, 0), 1) END, 6) AS inverse, CASE WHEN value IS NULL THEN NULL WHEN value <= 20 THEN 'cold' WHEN value <= 60 THEN 'mild' ELSE 'hot' END AS band, value >= 60 AS is_hot, (value >= 60) = (value >= 20) AS same, abs(value - 50) <= 10 AS near, round(least(greatest(coalesce(value, 0) * 0.004 + 0.1 * 1.0, 0), 1), 6) AS blend FROM events")
def p05_p15_scores_and_flags(spark, d):
    ev = load(spark, d, "events")
    v = F.col("value")
    text = F.when(F.col("event_type").isin("view", "click"), "Yes ").when(F.col("event_type") == "error", "0").otherwise("?")
    blend = S.weighted_score({"value": 0.004, "one": 0.1})
    return ev.withColumn("one", F.lit(1)).select("event_id", S.binary_coerce(text).alias("flag"), S.clip(v, 10.0, 100.0).alias("clipped"), F.round(S.minmax_score(v, F.lit(0.0), F.lit(200.0)), 6).alias("score"), F.round(S.inverse_minmax_score(v, F.lit(0.0), F.lit(200.0)), 6).alias("inverse"), S.band(v, [20, 60], ["cold", "mild", "hot"]).alias("band"), S.threshold_flag(v, ">=", 60).alias("is_hot"), S.nullable_same(v >= 60, v >= 20).alias("same"), S.gap_flag(v, 50, 10).alias("near"), F.round(blend, 6).alias("blend"))


@query("SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS weekday_no, isodow(ts) >= 6 AS is_weekend, CAST(year(ts) AS INTEGER) AS year_no, CAST(month(ts) AS INTEGER) AS month_no, CAST(quarter(ts) AS INTEGER) AS quarter_no, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CAST(weekofyear(ts) AS INTEGER) AS iso_week, CAST(isoyear(ts) AS INTEGER) AS iso_year, CAST(floor((day(ts) - 1) / 7.0) + 1 AS BIGINT) AS week_of_month, round(hour(ts) + minute(ts) / 60.0, 6)::DOUBLE AS hour_no, round(sin(2 * pi() * (dayofyear(ts) - 1) / 365.25), 6) AS year_sin, round(cos(2 * pi() * (dayofyear(ts) - 1) / 365.25), 6) AS year_cos, round(ln(1 + greatest(value, 0)), 6) AS log_value, time_bucket(INTERVAL 15 MINUTE, ts) AS slot, time_bucket(INTERVAL 15 MINUTE, ts + INTERVAL 450 SECOND) AS nearest_slot, CASE WHEN month(ts) IN (12, 1, 2) THEN 'winter' WHEN month(ts) IN (3, 4, 5) THEN 'spring' WHEN month(ts) IN (6, 7, 8) THEN 'summer' ELSE 'fall' END AS season, monthname(ts) AS month_name, CASE WHEN hour(ts) < 10 THEN 'breakfast' WHEN hour(ts) < 12 THEN 'snack' WHEN hour(ts) < 14 THEN 'lunch' WHEN hour(ts) < 17 THEN 'snack' ELSE 'dinner' END AS slot_group FROM events")
def f12_f18_calendar(spark, d):
    ev = load(spark, d, "events")
    t = F.col("ts")
    sin, cos = S.cyclic_year(t)
    of_day = S.band(F.hour(t), [10, 12, 14, 17], ["breakfast", "morning_snack", "lunch", "afternoon_snack", "dinner"], "left")
    return ev.select("event_id", *(c.alias(k) for k, c in S.calendar(t).items()), F.round(S.hour_of_day(t), 6).alias("hour_no"), F.round(sin, 6).alias("year_sin"), F.round(cos, 6).alias("year_cos"), F.round(S.log1p_clip(F.col("value")), 6).alias("log_value"), S.slot_start(t).alias("slot"), S.slot_start(t, nearest=True).alias("nearest_slot"), S.season(F.month(t)).alias("season"), S.month_name(t).alias("month_name"), S.slot_group(of_day, ["morning_snack", "afternoon_snack"]).alias("slot_group"))


@query(r"""WITH t AS (SELECT p_partkey, p_name, p_type, p_brand, p_name || ' (old) & [x] LARGE ' || p_type AS raw FROM part) SELECT p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(raw), '&', ' and '), '\[[^\]]*\]|\([^)]*\)', ' ', 'g'), '[^a-z0-9+''\-/ ]', ' ', 'g'), '\b(small|medium|large|mini|regular|serving)\b', ' ', 'g'), ' +', ' ', 'g')), ''), 'unknown_item') AS clean_name,
 regexp_matches(lower(p_name), '\b(ring|bolt)\b') AS is_metal, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(raw), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'with', 'of')))), ',') AS tokens, CASE WHEN contains(lower(p_name || ' ' || p_type), 'hot') THEN 'warm' WHEN contains(lower(p_name || ' ' || p_type), 'eco') THEN 'cheap' ELSE 'other' END AS family, CASE WHEN p_name = 'hot' OR starts_with(p_name, 'hot ') THEN 'hot' WHEN p_name = 'large' OR starts_with(p_name, 'large ') THEN 'large' END AS brand, CASE WHEN starts_with(p_name, 'hot ') THEN trim(substr(p_name, 4)) WHEN starts_with(p_name, 'large ') THEN trim(substr(p_name, 6)) ELSE p_name END AS bare, coalesce(nullif(trim(CASE WHEN p_partkey % 2 = 0 THEN '  ' ELSE p_name END), ''), p_brand) AS first_text FROM t""")
def f01_f09_item_text(spark, d):
    part = load(spark, d, "part").withColumn("raw", F.concat(F.col("p_name"), F.lit(" (old) & [x] LARGE "), F.col("p_type")))
    brand = S.prefix_of(F.col("p_name"), ["hot", "large"])
    family = S.keyword_family([F.col("p_name"), F.col("p_type")], [("warm", ["hot"]), ("cheap", ["eco"])], "other")
    blank = F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(F.col("p_name"))
    return part.select("p_partkey", S.normalize_text(F.col("raw"), ["small", "medium", "large", "mini", "regular", "serving"]).alias("clean_name"), S.pattern_flag(F.col("p_name"), ["ring", "bolt"]).alias("is_metal"), F.array_join(S.clean_tokens(F.col("raw")), ",").alias("tokens"), family.alias("family"), brand.alias("brand"), S.strip_prefix(F.col("p_name"), brand).alias("bare"), S.first_nonblank(blank, F.col("p_brand")).alias("first_text"))


@query("WITH t AS (SELECT event_id, ts, 'days__t_minus_' || (event_id % 7) || '__value_' || event_type AS name FROM events) SELECT event_id, split_part(name, '__', 1) AS modality, CAST(event_id % 7 AS BIGINT) AS lag, regexp_replace(name, '^.*__t_minus_[0-9]+__', '') AS core, date_trunc('second', ts) AS wall, CAST(ts AS DATE) AS ms_date FROM t")
def f20_s09_s11_names_and_times(spark, d):
    """Times are written out with zones and names first, and then read back as they were."""
    ev = load(spark, d, "events").withColumn("name", F.concat(F.lit("days__t_minus_"), (F.col("event_id") % 7).cast("string"), F.lit("__value_"), F.col("event_type")))
    parts = S.feature_parts(F.col("name"))
    written = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+02:00[Europe/Paris]").otherwise("Z"))
    return ev.select("event_id", *(c.alias(k) for k, c in parts.items()), S.wallclock(written).alias("wall"), S.epoch_ms_date(F.unix_millis(F.col("ts").cast("timestamp"))).alias("ms_date"))


@query("SELECT o_orderkey, round(o_totalprice * 1.12 + 1e-7, 3) AS scaled, round(o_totalprice / nullif(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 3 END, 0), 4) AS per_item, CASE o_orderpriority WHEN '1-URGENT' THEN 6 WHEN '2-HIGH' THEN 9 ELSE 12 END AS slot_hour, round(o_totalprice * 2.20462 + 1e-7, 3) AS pounds, CASE WHEN o_totalprice < 100000 THEN 'below budget' ELSE 'over budget' END || ' by ' || CAST(CAST(round(abs(o_totalprice - 100000)) AS BIGINT) AS VARCHAR) AS note FROM orders")
def f21_f22_s12_s14_p19_units(spark, d):
    price = F.col("o_totalprice")
    hour = F.coalesce(F.create_map(F.lit("1-URGENT"), F.lit(6), F.lit("2-HIGH"), F.lit(9))[F.col("o_orderpriority")], F.lit(12))
    note = F.concat_ws(" by ", F.when(price < 100000, "below budget").otherwise("over budget"), F.round(F.abs(price - 100000)).cast("long").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", F.round(S.portion_scale(price, 1.12) + 1e-7, 3).alias("scaled"), F.round(price / F.nullif(F.col("o_orderkey") % 3, F.lit(0)), 4).alias("per_item"), hour.alias("slot_hour"), F.round(price * 2.20462 + 1e-7, 3).alias("pounds"), note.alias("note"))


@query("WITH h AS (SELECT event_id, user_id, value, value < 20 AS is_cold, coalesce(value > 60, false) AS is_hot FROM events) SELECT event_id, is_cold, is_hot, NOT coalesce(is_cold, false) AND NOT is_hot AS is_mild, hour(ts) >= 6 AND hour(ts) < 18 AS is_daylight, ts >= date_trunc('day', ts) + INTERVAL 7 HOUR + INTERVAL 30 MINUTE AND ts < date_trunc('day', ts) + INTERVAL 19 HOUR + INTERVAL 30 MINUTE AS is_daylight_there FROM h JOIN (SELECT event_id, ts FROM events) USING (event_id)")
def p10_f17_weather_flags(spark, d):
    v, t = F.col("value"), F.col("ts")
    cold, hot = v < 20, F.coalesce(v > 60, F.lit(False))
    rise, fall = F.date_trunc("day", t) + F.expr("interval 6 hours"), F.date_trunc("day", t) + F.expr("interval 18 hours")
    return load(spark, d, "events").select("event_id", cold.alias("is_cold"), hot.alias("is_hot"), (~F.coalesce(cold, F.lit(False)) & ~hot).alias("is_mild"), S.is_daylight(t, rise, fall).alias("is_daylight"), S.is_daylight(t, S.solar_shift(rise, 1.5), S.solar_shift(fall, 1.5)).alias("is_daylight_there"))


@query("""WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'inf' WHEN 1 THEN 'n/a' WHEN 2 THEN NULL ELSE CAST(value AS VARCHAR) END AS raw FROM events) SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE CAST(raw AS DOUBLE) END AS number, coalesce(CASE WHEN event_id % 5 < 3 THEN NULL ELSE CAST(raw AS DOUBLE) END, -1.0)::DOUBLE AS safe FROM t""")
def p06_numeric_coerce(spark, d):
    """Texts that are no finite numbers become null, or a default."""
    raw = F.when(F.col("event_id") % 5 == 0, "inf").when(F.col("event_id") % 5 == 1, "n/a").when(F.col("event_id") % 5 > 2, F.col("value").cast("string"))
    return load(spark, d, "events").select("event_id", S.numeric_coerce(raw).alias("number"), S.numeric_coerce(raw, -1.0).alias("safe"))


@query("""WITH t AS (SELECT p_partkey, p_type, p_size, p_retailprice, CASE p_type WHEN 'LARGE' THEN 'Crispy fried' WHEN 'PROMO' THEN 'packaged' ELSE 'plain' END AS prep, CASE WHEN p_name LIKE '%ring%' THEN 'Salad Bowl' WHEN p_name LIKE '%bolt%' THEN 'pasta plate' ELSE p_name END AS kind, p_size % 3 AS desserts, p_size % 2 AS drinks, nullif(p_size % 7, 0) AS items FROM part),
 f AS (SELECT *, prep <> 'plain' AS fried, regexp_matches(lower(kind), 'salad|bowl') AS fresh_kind, regexp_matches(lower(kind), 'pizza|burger|pasta|dessert') AS rich_kind FROM t)
 SELECT p_partkey, round(least(greatest(0.45 + CASE WHEN fried THEN 0.1 ELSE 0 END + CASE WHEN rich_kind THEN 0.2 ELSE 0 END, 0), 1), 6)::DOUBLE AS comfort, round(least(greatest(0.40 - CASE WHEN fried THEN 0.15 ELSE 0 END + CASE WHEN fresh_kind THEN 0.2 ELSE 0 END - CASE WHEN rich_kind THEN 0.1 ELSE 0 END + CASE WHEN drinks > 0 AND coalesce(items, 1) = 1 THEN 0.05 ELSE 0 END, 0), 1), 6)::DOUBLE AS fresh,
 round(least(greatest(0.40 + CASE WHEN fried THEN 0.2 ELSE 0 END + CASE WHEN rich_kind THEN 0.2 ELSE 0 END + CASE WHEN desserts > 0 THEN 0.15 ELSE 0 END, 0), 1), 6)::DOUBLE AS indulgence, CASE WHEN p_retailprice >= 900 THEN 'high' WHEN p_retailprice >= 500 THEN 'moderate' ELSE 'light' END AS density, CASE WHEN p_size >= 30 OR desserts >= 8 THEN 'high' WHEN p_size >= 15 OR desserts >= 4 THEN 'moderate' ELSE 'light' END AS satiety,
 round(least(greatest(CASE WHEN items <= 2 THEN 0.8 WHEN items <= 4 THEN 0.65 ELSE 0.5 END - CASE WHEN CAST(p_size > 10 AS INT) + CAST(p_size > 20 AS INT) + CAST(desserts > 0 AS INT) + CAST(drinks > 0 AS INT) + CAST(p_size > 30 AS INT) >= 4 THEN 0.1 ELSE 0 END, 0), 1), 6)::DOUBLE AS coherence FROM f""")
def f11_derive_scores(spark, d):
    """Additive scores of parts; their preparation, kind and counts are derived from type, name and size."""
    size, name = F.col("p_size"), F.col("p_name")
    prep = F.when(F.col("p_type") == "LARGE", "Crispy fried").when(F.col("p_type") == "PROMO", "packaged").otherwise("plain")
    kind = F.when(name.contains("ring"), "Salad Bowl").when(name.contains("bolt"), "pasta plate").otherwise(name)
    desserts, drinks, items = size % 3, size % 2, F.nullif(size % 7, F.lit(0))
    scores = S.additive_scores(prep, kind, desserts, drinks, items)
    styles = {"density": S.density_style(F.col("p_retailprice")), "satiety": S.satiety_style(size.cast("double"), desserts.cast("double"))}
    coherence = S.coherence_score(items, [size - 10, size - 20, desserts, drinks, size - 30])
    return load(spark, d, "part").select("p_partkey", *(F.round(c, 6).alias(k) for k, c in scores.items()), *(c.alias(k) for k, c in styles.items()), F.round(coherence, 6).alias("coherence"))


@query("""SELECT o_orderkey, 'day plan: ' || CASE WHEN o_totalprice >= 300000 THEN 'heavy total' WHEN o_totalprice >= 100000 THEN 'usual total' ELSE 'light total' END || CASE WHEN o_orderpriority = '1-URGENT' THEN '; urgent slot' ELSE '' END || CASE WHEN isodow(o_orderdate) >= 6 THEN '; weekend' ELSE '' END AS plan_note, 'cluster ' || o_orderstatus || CASE WHEN o_orderstatus = 'F' THEN ', often seen' ELSE '' END AS cluster_note,
 CASE WHEN o_totalprice / 500000 < 0.25 THEN 'low: keep watching' WHEN o_totalprice / 500000 < 0.5 THEN 'watch: near the threshold' ELSE 'high: act' END AS band_note FROM orders""")
def p19_explain_columns(spark, d):
    """Rule texts of a plan, a cluster and a band."""
    price = F.col("o_totalprice")
    total = F.concat(F.lit("day plan: "), S.band(price, [100000, 300000], ["light total", "usual total", "heavy total"], "left"))
    notes = {"low": "low: keep watching", "watch": "watch: near the threshold", "high": "high: act"}
    band = S.probability_band(price / 500000, 0.5)
    return load(spark, d, "orders").select(
        "o_orderkey", S.explain("; ", total, (F.col("o_orderpriority") == "1-URGENT", "urgent slot"), (F.weekday("o_orderdate") >= 5, "weekend")).alias("plan_note"),
        S.explain(", ", F.concat(F.lit("cluster "), "o_orderstatus"), (F.col("o_orderstatus") == "F", "often seen")).alias("cluster_note"), S.code_map(band, notes).alias("band_note"),
    )
