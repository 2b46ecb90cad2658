"""Queries on baskets (orders) and lines: semantics, profiles, overlays and review batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import baskets as B
from tideline.plans.registry import load, query

LINES = "lines AS (SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice AS amount, l.l_returnflag AS role, l.l_quantity, p.p_name, p.p_type, p.p_brand FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey)"


def lines(spark, d) -> DataFrame:
    part = load(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("amount"), F.col("l_returnflag").alias("role"), "l_quantity")
    return li.join(part, li.l_partkey == part.p_partkey, "left").drop("p_partkey")


@query(f"WITH {LINES} SELECT l_orderkey, count(*) AS n_lines, round(sum(amount), 4) AS amount, string_agg(p_name, ' + ' ORDER BY l_linenumber, l_partkey, p_name) AS names, CAST(count(*) FILTER (role = 'R') AS BIGINT) AS n_returned, count(DISTINCT p_type) AS n_types FROM lines GROUP BY 1")
def a02_a05_a06_basket_rollup(spark, d):
    return lines(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.round(F.sum("amount"), 4).alias("amount"), B.ordered_join(F.col("p_name"), [F.col("l_linenumber"), F.col("l_partkey")]).alias("names"), F.count_if(F.col("role") == "R").alias("n_returned"), F.count_distinct("p_type").alias("n_types"))


@query(f"WITH {LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY amount DESC, p_name, l_partkey, l_linenumber) AS k FROM lines) SELECT l_orderkey, string_agg(p_name, ', ' ORDER BY k) AS signature FROM r WHERE k <= 3 GROUP BY 1")
def a17_basket_signature(spark, d):
    order = [-F.col("amount"), F.col("p_name"), F.col("l_partkey"), F.col("l_linenumber")]
    return lines(spark, d).groupBy("l_orderkey").agg(B.ordered_join(F.col("p_name"), order, ", ", 3).alias("signature"))


@query(f"WITH {LINES}, s AS (SELECT l_orderkey, p_type, round(sum(amount), 6) AS w FROM lines GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p_type <> 'ECONOMY' DESC, w DESC, p_type) AS k FROM s) SELECT l_orderkey, p_type AS main_type FROM r WHERE k = 1")
def a08_weighted_mode(spark, d):
    return B.weighted_mode(lines(spark, d), ["l_orderkey"], "p_type", "amount", "main_type", exclude=["ECONOMY"])


@query(f"WITH {LINES}, s AS (SELECT p_type, role, count(*) AS n FROM lines GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, role) AS k FROM s) SELECT p_type, role AS usual_role FROM r WHERE k = 1")
def a07_mode(spark, d):
    return B.mode(lines(spark, d), ["p_type"], "role", "usual_role")


@query(f"WITH {LINES}, s AS (SELECT p_brand, p_name AS value, count(*) AS n FROM lines GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, value) AS place FROM s) SELECT p_brand, string_agg(value || ':' || n, ' | ' ORDER BY place) AS top_names FROM r WHERE place <= 5 GROUP BY 1")
def a11_f19_top_values(spark, d):
    top = B.top_values(lines(spark, d), ["p_brand"], "p_name", 5)
    return top.groupBy("p_brand").agg(B.ordered_join(F.concat_ws(":", "p_name", F.col("n").cast("string")), [F.col("place")], " | ").alias("top_names"))


@query(f"WITH {LINES}, h AS (SELECT DISTINCT l_orderkey, p_type FROM lines) SELECT x.p_type AS a, y.p_type AS b, count(*) AS n_baskets FROM h x JOIN h y USING (l_orderkey) WHERE x.p_type < y.p_type GROUP BY 1, 2")
def a16_j14_cooccurrence(spark, d):
    return B.cooccurrence(lines(spark, d), "l_orderkey", "p_type")


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, l_partkey, CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY amount DESC) AS BIGINT) AS amount_rank, round(amount / nullif(sum(amount) OVER (PARTITION BY l_orderkey), 0), 6) AS share FROM lines")
def w15_rank_and_share(spark, d):
    w = Window.partitionBy("l_orderkey")
    return lines(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", F.dense_rank().over(w.orderBy(F.desc("amount"))).cast("long").alias("amount_rank"), F.round(F.col("amount") / F.nullif(F.sum("amount").over(w), F.lit(0.0)), 6).alias("share"))


@query(f"WITH {LINES} SELECT l_orderkey, arg_max(p_name, struct_pack(amount := amount, l_partkey := l_partkey, l_linenumber := l_linenumber)) AS primary_item, arg_max(p_type, struct_pack(amount := amount, l_partkey := l_partkey, l_linenumber := l_linenumber)) AS primary_type FROM lines GROUP BY 1")
def a29_primary_item(spark, d):
    best = F.max(F.struct("amount", "l_partkey", "l_linenumber", "p_name", "p_type"))
    return lines(spark, d).groupBy("l_orderkey").agg(best.alias("best")).select("l_orderkey", F.col("best.p_name").alias("primary_item"), F.col("best.p_type").alias("primary_type"))


@query("""WITH o AS (SELECT *, row_number() OVER w AS order_in_day, count(*) OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE)) AS day_count, lag(o_orderkey) OVER c AS prior_id, lead(o_orderkey) OVER c AS next_id, date_diff('day', lag(o_orderdate) OVER c, o_orderdate) AS days_since_prior,
 sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM orders WINDOW w AS (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey), c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
 SELECT o_orderkey, order_in_day, order_in_day = 1 AS is_first, order_in_day = day_count AS is_last, day_count, prior_id, next_id, days_since_prior, round(coalesce(b, 0), 4) AS cum_before, round(coalesce(b, 0) + o_totalprice, 4) AS cum_after, CASE WHEN prior_id IS NOT NULL THEN lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS prior_priority FROM o""")
def w01_w03_w04_j10_basket_order(spark, d):
    c, day = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"), Window.partitionBy("o_custkey", "day")
    o = load(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    n, place = F.count("*").over(day), F.row_number().over(day.orderBy("o_orderkey"))
    run = B.running(F.col("o_totalprice"), c)
    return o.select("o_orderkey", place.cast("long").alias("order_in_day"), (place == 1).alias("is_first"), (place == n).alias("is_last"), n.alias("day_count"), F.lag("o_orderkey").over(c).alias("prior_id"), F.lead("o_orderkey").over(c).alias("next_id"), F.datediff("o_orderdate", F.lag("o_orderdate").over(c)).cast("long").alias("days_since_prior"), F.round(run["before"], 4).alias("cum_before"), F.round(run["before"] + F.col("o_totalprice"), 4).alias("cum_after"), F.lag("o_orderpriority").over(c).alias("prior_priority"))


@query("SELECT o_custkey, CAST(count(*) FILTER (o_orderpriority = '1-URGENT') AS BIGINT) AS urgent, CAST(count(*) FILTER (o_orderpriority = '2-HIGH') AS BIGINT) AS high, CAST(count(*) FILTER (o_orderpriority = '5-LOW') AS BIGINT) AS low FROM orders GROUP BY 1")
def a12_pivot_counts(spark, d):
    out = load(spark, d, "orders").groupBy("o_custkey").pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "5-LOW"]).count().na.fill(0)
    return out.withColumnsRenamed({"1-URGENT": "urgent", "2-HIGH": "high", "5-LOW": "low"})


@query(f"WITH {LINES} SELECT p_name, count(*) AS n, count(DISTINCT l_orderkey) AS n_baskets, round(median(amount), 4) AS median_amount, round(quantile_cont(amount, 0.05), 4) AS q05, round(quantile_cont(amount, 0.95), 4) AS q95, round(min(amount), 4) AS least, round(max(amount), 4) AS most, round(avg(CASE WHEN role = 'R' THEN 1.0 ELSE 0.0 END), 6) AS return_rate FROM lines GROUP BY 1")
def a14_a15_a18_item_profile(spark, d):
    q = F.percentile("amount", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    out = lines(spark, d).groupBy("p_name").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_baskets"), q.alias("q"), F.round(F.min("amount"), 4).alias("least"), F.round(F.max("amount"), 4).alias("most"), F.round(F.avg((F.col("role") == "R").cast("double")), 6).alias("return_rate"))
    return out.select("p_name", "n", "n_baskets", F.round(F.col("q")[1], 4).alias("median_amount"), F.round(F.col("q")[0], 4).alias("q05"), F.round(F.col("q")[2], 4).alias("q95"), "least", "most", "return_rate")


@query(f"WITH {LINES}, c AS (SELECT p_type, role, count(*) AS n FROM lines GROUP BY 1, 2) SELECT p_type, role, n, round(n * 1.0 / sum(n) OVER (), 6) AS share, round(n * 1.0 / sum(n) OVER (PARTITION BY p_type), 6) AS share_of_type FROM c WHERE n >= 3")
def a19_a20_frequency_share(spark, d):
    c = lines(spark, d).groupBy("p_type", "role").agg(F.count("*").alias("n"))
    totals = c.agg(F.sum("n").alias("all_n"))
    by_type = c.groupBy("p_type").agg(F.sum("n").alias("type_n"))
    return c.where("n >= 3").crossJoin(F.broadcast(totals)).join(by_type, "p_type").select("p_type", "role", "n", F.round(F.col("n") / F.col("all_n"), 6).alias("share"), F.round(F.col("n") / F.col("type_n"), 6).alias("share_of_type"))


@query(f"WITH {LINES} SELECT p_type, role, p_brand, round(sum(amount), 2) AS amount, count(*) AS n FROM lines GROUP BY GROUPING SETS ((p_type), (role), (p_brand), ())")
def a25_importance_rollup(spark, d):
    return lines(spark, d).groupingSets([[F.col("p_type")], [F.col("role")], [F.col("p_brand")], []], "p_type", "role", "p_brand").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n"))


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN p_type IS NULL THEN NULL WHEN n >= (SELECT max(n) * 0.95 FROM c) THEN p_type ELSE 'OTHER' END AS label FROM part LEFT JOIN c USING (p_type)")
def p17_common_class_collapse(spark, d):
    part = load(spark, d, "part")
    least = part.groupBy("p_type").count().agg(F.max("count") * 0.95).first()[0]
    return B.collapse_rare(part, "p_type", least, "label").select("p_partkey", "label")


@query("SELECT d.doc_id, coalesce(l.quality, CAST(d.n_chars % 2 AS INTEGER)) AS quality, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)")
def j11_j21_review_overlay(spark, d):
    docs = load(spark, d, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"))
    labels = load(spark, d, "labels").select("doc_id", "quality")
    marked = B.overlay(docs, labels, "doc_id", ["quality"])
    return marked.join(labels.select("doc_id", F.lit(True).alias("r")), "doc_id", "left").select("doc_id", "quality", F.coalesce("r", F.lit(False)).alias("reviewed"))


@query("SELECT 'reviewed' AS part, doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT 'pending', doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j12_j13_semi_and_anti(spark, d):
    docs, labels = load(spark, d, "documents").select("doc_id", "n_chars"), load(spark, d, "labels")
    return docs.join(labels, "doc_id", "left_semi").select(F.lit("reviewed").alias("part"), "doc_id", "n_chars").unionByName(docs.join(labels, "doc_id", "left_anti").select(F.lit("pending").alias("part"), "doc_id", "n_chars"))


@query("SELECT doc_id, CAST(floor((row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1) / 100) AS BIGINT) AS batch FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def t06_review_batches(spark, d):
    pending = load(spark, d, "documents").select("doc_id", "n_chars").join(load(spark, d, "labels"), "doc_id", "left_anti")
    return B.batches(pending, 100, F.desc("n_chars"), F.asc("doc_id")).select("doc_id", "batch")


@query("WITH l AS (SELECT source, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT source, 'placeholder' AS status, n, first_doc, CAST(NULL AS BIGINT) AS quality_sum FROM l UNION ALL SELECT source, 'reviewed', count(*), min(doc_id), CAST(sum(quality) AS BIGINT) FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a28_u02_placeholders(spark, d):
    docs, labels = load(spark, d, "documents"), load(spark, d, "labels").select("doc_id", "quality")
    some = docs.join(labels, "doc_id", "left_anti").groupBy("source").agg(F.lit("placeholder").alias("status"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    done = docs.join(labels, "doc_id").groupBy("source").agg(F.lit("reviewed").alias("status"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum("quality").alias("quality_sum"))
    return some.unionByName(done, allowMissingColumns=True)


@query("SELECT l_orderkey, l_linenumber, l_partkey, s_name, n_name FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey")
def j02_j03_enrich_left(spark, d):
    """Dimensions with keys checked to be unique; Spark broadcasts one where its size is small enough."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    su = load(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey"))
    return B.checked_join(B.checked_join(li, su, ["s_suppkey"]), load(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "s_name", "n_name")


@query("""WITH s AS (SELECT p_brand, p_size, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY 1, 2), l AS (SELECT p_brand, min(p_partkey) AS k FROM part WHERE p_partkey % 2 = 0 GROUP BY 1)
 SELECT p.p_partkey, coalesce(s.k, l.k) AS match_key, CASE WHEN s.k IS NOT NULL THEN 'strict' WHEN l.k IS NOT NULL THEN 'loose' END AS stage FROM part p LEFT JOIN s USING (p_brand, p_size) LEFT JOIN l USING (p_brand) WHERE p.p_partkey % 2 = 1""")
def j04_two_stage_join(spark, d):
    """Parts with odd keys look for one with an even key of their brand and size, else of their brand."""
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    dim = part.where("p_partkey % 2 = 0").select("p_brand", "p_size", F.col("p_partkey").alias("match_key"))
    return B.two_stage_join(part.where("p_partkey % 2 = 1"), dim, ["p_brand", "p_size"], ["p_brand"], "match_key", "match_key").select("p_partkey", "match_key", "stage")


@query("SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 10")
def t01_t02_topk_per_group(spark, d):
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return load(spark, d, "orders").withColumn("k", F.row_number().over(w)).where("k <= 10").select("o_orderpriority", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t03_topk_global(spark, d):
    return load(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_custkey, coalesce(arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) FILTER (o_orderstatus = 'F'), arg_max(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey))) AS latest FROM orders GROUP BY 1")
def t04_latest_eligible(spark, d):
    key = F.struct("o_orderdate", "o_orderkey")
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.coalesce(F.max(F.when(F.col("o_orderstatus") == "F", key))["o_orderkey"], F.max(key)["o_orderkey"]).alias("latest"))


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := abs(o_totalprice - 100000), b := o_orderkey)) AS nearest FROM orders GROUP BY 1")
def t05_nearest_row(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct(F.abs(F.col("o_totalprice") - 100000), "o_orderkey"))["o_orderkey"].alias("nearest"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) AS k FROM part) SELECT p_brand, p_type, max(CASE WHEN k = 1 THEN p_partkey END) AS best, count(*) AS n, min(p_retailprice) AS least, round(median(p_retailprice), 4) AS middle, max(p_retailprice) AS most, coalesce(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY k) FILTER (k BETWEEN 2 AND 4), '') AS others FROM r GROUP BY 1, 2""")
def t08_representative_per_cluster(spark, d):
    part = load(spark, d, "part").withColumn("k", F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy(F.desc("p_retailprice"), "p_partkey")))
    others = F.array_sort(F.collect_list(F.when(F.col("k").between(2, 4), F.struct("k", F.col("p_partkey").cast("string").alias("v")))))
    return part.groupBy("p_brand", "p_type").agg(F.max(F.when(F.col("k") == 1, F.col("p_partkey"))).alias("best"), F.count("*").alias("n"), F.min("p_retailprice").alias("least"), F.round(F.median("p_retailprice"), 4).alias("middle"), F.max("p_retailprice").alias("most"), F.array_join(F.transform(others, lambda x: x["v"]), ",").alias("others"))


@query(f"""WITH {LINES} SELECT l_orderkey, CASE WHEN bool_and(role = 'R') THEN 'returns' WHEN bool_or(role = 'R') AND count(*) >= 4 THEN 'mixed_large' WHEN sum(amount) > 200000 THEN 'large' WHEN count(*) = 1 THEN 'single' ELSE 'plain' END AS category, bool_or(p_type = 'ECONOMY') AS has_economy, round(avg(l_quantity), 4) AS mean_quantity FROM lines GROUP BY 1""")
def a21_f10_basket_category(spark, d):
    n, total = F.count("*"), F.sum("amount")
    r = F.col("role") == "R"
    category = F.when(F.bool_and(r), "returns").when(F.bool_or(r) & (n >= 4), "mixed_large").when(total > 200000, "large").when(n == 1, "single").otherwise("plain")
    return lines(spark, d).groupBy("l_orderkey").agg(category.alias("category"), F.bool_or(F.col("p_type") == "ECONOMY").alias("has_economy"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))


@query("""WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, o_orderpriority AS slot, count(*) AS n, round(sum(o_totalprice)) AS amount FROM orders GROUP BY 1, 2, 3) SELECT o_custkey, day, string_agg(slot || ':' || n || ' (' || CAST(CAST(amount AS BIGINT) AS VARCHAR) || ')', ' | ' ORDER BY slot) AS summary FROM s GROUP BY 1, 2""")
def a30_slot_summary(spark, d):
    s = load(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("slot")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice")).cast("long").alias("amount"))
    text = F.concat(F.col("slot"), F.lit(":"), F.col("n").cast("string"), F.lit(" ("), F.col("amount").cast("string"), F.lit(")"))
    return s.groupBy("o_custkey", "day").agg(B.ordered_join(text, [F.col("slot")], " | ").alias("summary"))


@query("SELECT p_partkey, 'item_' || substr(sha1(coalesce(p_name, '') || '||' || coalesce(p_brand, '')), 1, 12) AS item_id FROM part")
def f06_stable_id(spark, d):
    return load(spark, d, "part").select("p_partkey", S.stable_id("item", F.col("p_name"), F.col("p_brand")).alias("item_id"))
