"""Queries on reading and shaping exports. Text forms are derived from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.plans.registry import load, query
from tideline.sources import exports as X
from tideline.sources.shared import shared_path


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS k_user, event_type AS k_type, '{' || event_type || ',x}' AS k_set, CAST(4 AS BIGINT) AS n_keys FROM events")
def s04_s06_kv_entries(spark, d):
    ev = load(spark, d, "events")
    text = F.concat(F.lit("[user="), F.col("user_id").cast("string"), F.lit(", set={"), F.col("event_type"), F.lit(",x}, list=[1,2], type="), F.col("event_type"), F.lit("]"))
    m = X.parse_kv_entries(text)
    return ev.select("event_id", m["user"].alias("k_user"), m["type"].alias("k_type"), m["set"].alias("k_set"), F.size(m).cast("long").alias("n_keys"))


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS a, event_type AS b, CASE WHEN event_id % 3 = 1 THEN 'v' || event_id % 5 END AS c, event_id % 3 > 0 AS names_c FROM events")
def s05_zip_keys_values(spark, d):
    """Each row names its own keys; one that has no value is null, and one that is not named is missing."""
    third = F.col("event_id") % 3
    keys = F.concat_ws(",", F.lit("a"), F.lit(" b"), F.when(third > 0, "c"))
    m = X.zip_keys_values(keys, F.concat_ws(",", F.col("user_id").cast("string"), F.col("event_type"), F.when(third == 1, F.concat(F.lit("v"), (F.col("event_id") % 5).cast("string")))))
    return load(spark, d, "events").select("event_id", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"), F.map_contains_key(m, "c").alias("names_c"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS DOUBLE) / 1000 AS k_grams FROM events")
def s07_s08_json_fields(spark, d):
    """Fields of a JSON text, and of one that lies inside another JSON text."""
    ev = load(spark, d, "events").withColumn("outer", F.to_json(F.struct(F.col("props").alias("inner"))))
    inner = X.json_fields(X.json_fields(F.col("outer"), "inner string")["inner"], "k double")
    return ev.select("event_id", X.json_fields(F.col("props"), "k bigint")["k"].alias("k"), (inner["k"] / 1000).alias("k_grams"))


@query("SELECT DISTINCT user_id AS entity_id, CAST(ts AS DATE) AS day, event_type FROM events WHERE value IS NOT NULL")
def s13_u03_canonical_events(spark, d):
    mapping = {"entity_id": ("user_id", "bigint"), "day": ("ts", "date"), "event_type": ("event_type", "string"), "value": ("value", "double")}
    return X.canonical_events(load(spark, d, "events"), mapping, ["value"], ["entity_id", "day", "event_type"]).drop("value")


@query("SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS top, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1, 2")
def s15_canonical_daily(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("top"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("""WITH x AS (SELECT event_id, user_id, ts, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE event_type WHEN 'purchase' THEN 'budget' WHEN 'view' THEN 'assignment' WHEN 'click' THEN 'user_event' WHEN 'signup' THEN 'goal' ELSE 'app_open' END AS kind, CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN event_type IN ('view', 'signup') THEN k END AS item, CASE WHEN event_type = 'click' THEN 'k=' || k END AS detail, CAST(ts AS DATE) AS day,
 event_type = 'error' AND row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) = 1 AS ends_day FROM x""")
def s16_s17_action_fanout(spark, d):
    """Each kind of log row as one typed table: budgets, assignments, goals, user events, and app opens with the day's last one marked."""
    kinds = {"purchase": "budget", "view": "assignment", "click": "user_event", "signup": "goal", "error": "app_open"}
    kind, k = F.col("event_type"), X.json_fields(F.col("props"), "k bigint")["k"]
    last = F.row_number().over(Window.partitionBy("user_id", "event_type", "day").orderBy(F.desc("ts"), F.desc("event_id"))) == 1
    ev = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    return ev.select("event_id", S.code_map(kind, kinds).alias("kind"), F.when(kind == "purchase", F.col("value")).alias("amount"), F.when(kind.isin("view", "signup"), k).alias("item"), F.when(kind == "click", F.concat(F.lit("k="), k.cast("string"))).alias("detail"), "day", ((kind == "error") & last).alias("ends_day"))


@query("SELECT user_id, event_id, value FROM events WHERE value IS NOT NULL")
def s18_columnar_json(spark, d):
    """Each user's events of a month as one JSON text of arrays, and then as rows again; so no text holds all rows of a user."""
    packed = load(spark, d, "events").where("value is not null").groupBy("user_id", F.trunc("ts", "month").alias("month")).agg(F.collect_list(F.struct("event_id", "value")).alias("rows"))
    packed = packed.select("user_id", F.to_json(F.struct(F.col("rows.event_id").alias("event_id"), F.col("rows.value").alias("value"))).alias("landed"))
    return packed.select("user_id", F.inline(X.columnar_json_rows(F.col("landed"), {"event_id": "bigint", "value": "double"})))


@query("SELECT doc_id, coalesce(l.quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'seed' ELSE 'snapshot' END AS origin FROM documents d LEFT JOIN labels l USING (doc_id)")
def s19_s20_snapshot_or_seed(spark, d):
    labels = load(spark, d, "labels").select("doc_id", "quality", F.lit("snapshot").alias("origin"))
    return X.snapshot_or_seed([labels, load(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"), F.lit("seed").alias("origin"))], "doc_id").select("doc_id", "quality", "origin")


@query("""WITH p AS (SELECT 'events' AS name, 2.0 AS boost, true AS has_order, 2 AS hits, false AS has_pair, true AS has_label, count(*) AS n_rows, count(*) / count(DISTINCT CAST(ts AS DATE))::DOUBLE AS rows_per_day FROM events UNION ALL SELECT 'orders', 0.0, false, 3, true, true, count(*), count(*) / count(DISTINCT CAST(o_orderdate AS DATE))::DOUBLE FROM orders UNION ALL SELECT 'lineitem', -4.0, true, 3, true, false, count(*), count(*) / count(DISTINCT CAST(l_shipdate AS DATE))::DOUBLE FROM lineitem),
 s AS (SELECT *, boost + 4 + 3 + 3 + CASE WHEN has_order THEN 1 ELSE 0 END + 2 * hits + CASE WHEN has_pair THEN 4 ELSE 0 END + CASE WHEN has_label THEN 2 ELSE 0 END + CASE WHEN n_rows BETWEEN 50 AND 500000 THEN 1 ELSE 0 END + 2 * 1.0 + CASE WHEN rows_per_day <= 1 THEN -3 WHEN rows_per_day <= 12 THEN 8 WHEN rows_per_day <= 24 THEN 1 ELSE -least(18.0, 0.35 * (rows_per_day - 24)) END AS score FROM p)
 SELECT name, n_rows, 1.0::DOUBLE AS time_rate, round(rows_per_day, 6) AS rows_per_day, round(score, 6)::DOUBLE AS score, row_number() OVER (ORDER BY round(score, 9) DESC, name) AS place FROM s""")
def s22_rank_sources(spark, d):
    """Three tables as candidates: what columns they have, what their names are worth, and how dense they are."""
    meanings = {"value", "type", "status", "price", "priority", "quantity"}
    out = None
    for name, boost, time, key, order, pair, label in (("events", 2.0, "ts", "user_id", "event_id", ("value", "price"), "type"), ("orders", 0.0, "o_orderdate", "o_custkey", "line", ("status", "priority"), "status"), ("lineitem", -4.0, "l_shipdate", "l_orderkey", "l_linenumber", ("quantity", "price"), "type")):
        t = load(spark, d, name)
        held = {m for m in meanings if any(m in c for c in t.columns)}
        p = X.source_profile(t.withColumn("day", F.to_date(time)), time, "day", key)
        facts = {"name": name, "boost": boost, "has_id": key in t.columns, "has_time": time in t.columns, "has_day": time in t.columns, "has_order": order in t.columns, "hits": len(held), "has_pair": set(pair) <= held, "has_label": label in held}
        p = p.select(*(F.lit(v).alias(k) for k, v in facts.items()), "n_rows", "time_rate", "rows_per_day")
        out = p if out is None else out.unionByName(p)
    return X.rank_sources(out).select("name", "n_rows", "time_rate", F.round("rows_per_day", 6).alias("rows_per_day"), F.round("score", 6).alias("score"), "place")


@query("SELECT event_id, event_type, value FROM events")
def s01_read_device_csv(spark, d):
    """Events written as files with a banner and a line of names, and read back."""
    path = shared_path(spark, "device-csv")
    ev = load(spark, d, "events").select("event_id", "event_type", "value")
    rows = ev.select(F.spark_partition_id().alias("part"), F.concat_ws(",", F.col("event_id").cast("string"), "event_type", F.coalesce(F.col("value").cast("string"), F.lit(""))).alias("value"), F.lit(2).alias("line"))
    heads = rows.select("part").distinct().select("part", F.explode(F.array(F.struct(F.lit("device export,v1").alias("value"), F.lit(0).alias("line")), F.struct(F.lit("event_id,event_type,value").alias("value"), F.lit(1).alias("line")))).alias("x")).select("part", "x.value", "x.line")
    rows.unionByName(heads).repartition("part").sortWithinPartitions("part", "line").select("value", "part").write.partitionBy("part").text(path)
    return X.read_device_csv(spark, path, ev.schema)


@query("SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def s02_read_log_csv(spark, d):
    """Orders written as plain CSV with a header, and read back by schema."""
    path = shared_path(spark, "log-csv")
    o = load(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    o.write.csv(path, header=True)
    return X.read_log_csv(spark, path, o.schema)


@query("SELECT event_id, CAST(user_id AS VARCHAR) AS k_user, CASE WHEN event_id % 2 = 0 THEN event_type END AS k_type, CASE WHEN event_id % 2 = 1 THEN event_type END AS k_name FROM events")
def s06_parse_export(spark, d):
    """Rows with entries are read from these, others from their lists of keys and values."""
    user, kind, even = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") % 2 == 0
    entries = F.when(even, F.concat(F.lit("[user="), user, F.lit(", type="), kind, F.lit("]")))
    m = X.parse_export(entries, F.when(~even, F.lit("user, name")), F.when(~even, F.concat_ws(",", user, kind)))
    return load(spark, d, "events").select("event_id", m["user"].alias("k_user"), m["type"].alias("k_type"), m["name"].alias("k_name"))


@query("SELECT 'batch_' || (doc_id % 3) AS folder, kind, doc_id, quality FROM labels, (SELECT unnest(['items', 'notes']) AS kind) WHERE doc_id % 3 < 2")
def s19_read_review_batches(spark, d):
    """Labels written as folders of reviews; the third folder lacks a kind, so it is not read."""
    path = shared_path(spark, "reviews")
    rows = load(spark, d, "labels").select((F.col("doc_id") % 3).alias("n"), "doc_id", "quality")
    for n in range(3):
        for kind in ("items", "notes")[: 2 - n // 2]:
            rows.where(F.col("n") == n).drop("n").write.json(f"{path}/batch_{n}/{kind}.json")
    return X.read_review_batches(spark, path, ["items", "notes"], rows.drop("n").schema).select("folder", "kind", "doc_id", "quality")


@query("SELECT event_id, CAST(ts AS DATE) AS day FROM events")
def f25_f26_multi_format_day(spark, d):
    written = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "dd.MM.yyyy HH:mm")).otherwise(F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
    return load(spark, d, "events").select("event_id", F.to_date(S.multi_format_time(written, ["dd.MM.yyyy HH:mm", "yyyy/MM/dd HH:mm:ss"])).alias("day"))


@query("SELECT event_type AS modality, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def s23_s24_write_by_modality(spark, d):
    """Events written by modality into the shared folder and read again; a modality's rows are a folder of their own."""
    path = shared_path(spark, "by-modality")
    X.write_table(load(spark, d, "events").withColumnRenamed("event_type", "modality"), path, ["modality"])
    return spark.read.parquet(path).groupBy(F.col("modality").cast("string").alias("modality")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, ts::TIMESTAMP AS bare FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def s10_strip_offset(spark, d):
    written = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.when(F.col("event_id") % 2 == 0, "+0530").otherwise("Z"))
    return load(spark, d, "events").select("event_id", S.wallclock(written).alias("bare"))
