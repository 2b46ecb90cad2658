"""Queries on scenarios: orders as templates, customers' usual amounts as context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import evaluation as E
from tideline.operators import planning as P
from tideline.operators import scenarios as C
from tideline.plans.registry import load, query
from tideline.sources.shared import staged

TEMPLATES = """t0 AS (SELECT o_orderkey AS template_id, o_custkey, o_orderpriority AS slot, CAST(o_orderdate AS DATE) AS day, count(*) AS size, count(DISTINCT l_returnflag) AS kinds, sum(l_extendedprice) AS amount FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4),
 sl AS (SELECT slot, count(*) AS n FROM t0 GROUP BY 1), templates AS (SELECT t0.*, n / (SELECT count(*) FROM t0)::DOUBLE AS support FROM t0 JOIN sl USING (slot)), usual AS (SELECT o_custkey, avg(amount) AS usual_amount, avg(size)::DOUBLE AS usual_size FROM templates GROUP BY 1)"""
# As in fusion: amounts that are compared with quantiles of amounts are settled first, and so are the quantiles.
SETTLED_TEMPLATES = TEMPLATES.replace("sum(l_extendedprice)", "round(sum(l_extendedprice), 6)")
SCORE = "least(greatest(0.30 * least(greatest(1 - abs(amount * factor - usual_amount) / greatest(usual_amount, 1), 0), 1) + 0.15 * least(greatest(1 - abs(greatest(size + shift, 1) - usual_size) / greatest(usual_size, 1), 0), 1) + 0.15 * least(greatest(kinds / greatest(size + shift, 1)::DOUBLE, 0), 1) + 0.25 * support + 0.15 * (1 - support), 0), 1)"
GRID = "g AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {f}::DOUBLE, {s})" for n, f, s in C.STRESSES) + ") v(stress, factor, shift))"


def templates(spark, d, *more: Column) -> DataFrame:
    """Orders with what their lines (``more``: further sums of them) add up to, and the share of orders in their slot. Written once: counts, means and scores all read it."""
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("template_id"), "o_custkey", F.col("o_orderpriority").alias("slot"), F.to_date("o_orderdate").alias("day"))
    li = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("template_id")).agg(F.count("*").alias("size"), F.count_distinct("l_returnflag").alias("kinds"), F.sum("l_extendedprice").alias("amount"), *more)
    t = staged(o.join(li, "template_id"), "templates")
    n = staged(t.groupBy("slot").agg(F.count("*").alias("n")), "template-slots")
    support = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("slot", (F.col("n") / F.col("total")).alias("support"))
    # A few slots hold all templates, which would go to as many tasks; many slots are left to Spark.
    return t.join(F.broadcast(support) if n.count() <= 1000 else support, "slot")


def settled(t: DataFrame) -> DataFrame:
    """Templates with amounts that don't depend on the order in which they were summed."""
    return t.withColumn("amount", F.round("amount", 6))


def stressed(spark, d) -> DataFrame:
    return C.score_under_stress(C.with_usual(templates(spark, d), ["o_custkey"]))


@query(f"WITH {TEMPLATES}, {GRID} SELECT template_id, stress, round({SCORE} + 1e-9, 6) AS score FROM templates JOIN usual USING (o_custkey), g")
def r01_r04_j15_stress_scores(spark, d):
    return stressed(spark, d).select("template_id", "stress", F.round(F.col("score") + 1e-9, 6).alias("score"))


@query(f"WITH {TEMPLATES}, {GRID}, s AS (SELECT template_id, {SCORE} AS score FROM templates JOIN usual USING (o_custkey), g) SELECT template_id, round(least(greatest(0.8 * avg(score) + 0.2 * min(score) - 0.5 * stddev_pop(score), 0), 1) + 1e-9, 5) AS robust, round(max(score) - min(score) + 1e-9, 5) AS fragility FROM s GROUP BY 1")
def r05_robust_score(spark, d):
    r = C.robust_score(stressed(spark, d), "template_id")
    return r.select("template_id", F.round(F.col("robust") + 1e-9, 5).alias("robust"), F.round(F.col("fragility") + 1e-9, 5).alias("fragility"))


@query(f"WITH {TEMPLATES}, {GRID}, s AS (SELECT template_id, o_custkey, slot, {SCORE} AS score FROM templates JOIN usual USING (o_custkey), g WHERE stress = 'none'), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(score, 6) DESC, template_id) AS i FROM s) SELECT o_custkey, string_agg(slot, '>' ORDER BY i) AS plan, count(DISTINCT slot) AS n_slots, count(*) < 3 OR count(DISTINCT slot) < 2 AS rejected, CASE WHEN count(*) < 3 THEN 'incomplete' WHEN count(DISTINCT slot) < 2 THEN 'repeats' ELSE '' END AS reason FROM k WHERE i <= 3 GROUP BY 1")
def r06_r07_w21_plans(spark, d):
    """A plan of a customer's three best templates by place, and why one is rejected."""
    s = stressed(spark, d).where("stress = 'none'")
    k = s.withColumn("i", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(F.round("score", 6)), "template_id"))).where("i <= 3")
    plan = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "slot"))), lambda x: x["slot"]), ">")
    p = k.groupBy("o_custkey").agg(plan.alias("plan"), F.count_distinct("slot").alias("n_slots"), F.count("*").alias("n"))
    reason = F.when(F.col("n") < 3, "incomplete").when(F.col("n_slots") < 2, "repeats").otherwise("")
    return p.select("o_custkey", "plan", "n_slots", (reason != "").alias("rejected"), reason.alias("reason"))


def _share(weights: dict, factor: float = 1.0, shift: int = 0) -> str:
    """A weighted score of a template as SQL."""
    parts = {
        "amount_fit": f"least(greatest(1 - abs(amount * {factor}::DOUBLE - usual_amount) / greatest(usual_amount, 1), 0), 1)", "size_fit": f"least(greatest(1 - abs(greatest(size + {shift}, 1) - usual_size) / greatest(usual_size, 1), 0), 1)",
        "mix": f"least(greatest(kinds / greatest(size + {shift}, 1)::DOUBLE, 0), 1)", "support": "support", "novelty": "(1 - support)",
    }
    return "least(greatest(" + " + ".join(f"{w}::DOUBLE * {parts[n]}" for n, w in weights.items()) + ", 0), 1)"


def _season(x: str) -> str:
    return f"CASE WHEN month({x}) IN (12, 1, 2) THEN 'winter' WHEN month({x}) <= 5 THEN 'spring' WHEN month({x}) <= 8 THEN 'summer' ELSE 'fall' END"


PLAN_TEMPLATES = f"""{TEMPLATES}, parts AS (SELECT l_orderkey AS template_id, bool_or(l_quantity <= 25) AS has_small, bool_or(l_quantity > 25) AS has_large FROM lineitem GROUP BY 1), band AS (SELECT quantile_cont(amount, 0.05) AS lo, quantile_cont(amount, 0.95) AS hi FROM templates),
 full_t AS (SELECT templates.*, has_small, has_large, usual_amount, usual_size, amount BETWEEN lo AND hi AS is_core, isodow(day) >= 6 AS t_weekend, {_season("day")} AS t_season FROM templates JOIN parts USING (template_id) JOIN usual USING (o_custkey), band)"""
PLAN_SLOTS = f"""{PLAN_TEMPLATES}, hz AS (SELECT unnest([{", ".join(map(str, P.HORIZONS))}])::INTEGER AS horizon), st AS (SELECT max(day) + 1 AS start FROM templates),
 ds AS (SELECT c_custkey AS o_custkey, horizon, k::INTEGER AS slot_no, CAST(start + CAST(k AS INTEGER) AS DATE) AS planned_date FROM customer, hz, st, range(7) r(k) WHERE k < horizon), dk AS (SELECT *, isodow(planned_date) >= 6 AS is_weekend, {_season("planned_date")} AS season FROM ds),
 w AS (SELECT DISTINCT o_custkey, is_weekend, season FROM dk), met AS (SELECT w.is_weekend, w.season, f.*, t_weekend = is_weekend AS dd, t_season = season AS ss FROM full_t f JOIN w USING (o_custkey)),
 p1 AS (SELECT *, count(*) FILTER (dd) OVER g >= 3 AS ud FROM met WINDOW g AS (PARTITION BY o_custkey, is_weekend, season)), p2 AS (SELECT * FROM p1 WHERE dd OR NOT ud),
 p3 AS (SELECT *, count(*) FILTER (ss) OVER (PARTITION BY o_custkey, is_weekend, season) >= 2 AS us FROM p2), p4 AS (SELECT * FROM p3 WHERE ss OR NOT us), p5 AS (SELECT *, count(*) FILTER (is_core) OVER (PARTITION BY o_custkey, is_weekend, season) >= 2 AS uc FROM p4), pool AS (SELECT * FROM p5 WHERE is_core OR NOT uc),
 sc AS ({" UNION ALL ".join(f"SELECT o_custkey, is_weekend, season, template_id, '{n}' AS strategy, round({_share(w)} + 1e-9, 6) AS score FROM pool" for n, w in P.PLAN_STRATEGIES.items())}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, is_weekend, season, strategy ORDER BY score DESC, template_id) AS rank, least(count(*) OVER (PARTITION BY o_custkey, is_weekend, season, strategy), {P.CYCLE}) AS n FROM sc),
 sg AS (SELECT unnest([{", ".join(repr(x) for x in P.PLAN_STRATEGIES)}]) AS strategy), slots AS (SELECT dk.o_custkey, sg.strategy, horizon, slot_no, planned_date, dayname(planned_date) AS planned_day_of_week, CAST(rank AS INTEGER) AS rank, template_id, score FROM dk CROSS JOIN sg LEFT JOIN rk ON rk.o_custkey = dk.o_custkey AND rk.is_weekend = dk.is_weekend AND rk.season = dk.season AND rk.strategy = sg.strategy AND rk.rank = slot_no % n + 1)"""

SETTLED_SLOTS = PLAN_SLOTS.replace(TEMPLATES, SETTLED_TEMPLATES).replace("quantile_cont(amount, 0.05) AS lo, quantile_cont(amount, 0.95) AS hi", "round(quantile_cont(amount, 0.05), 6) AS lo, round(quantile_cont(amount, 0.95), 6) AS hi")


def plan_inputs(spark, d, settle: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Templates with all that plans ask of them (staged), all customers, and the day after the last order."""
    t = templates(spark, d, F.bool_or(F.col("l_quantity") <= 25).alias("has_small"), F.bool_or(F.col("l_quantity") > 25).alias("has_large"))
    t = settled(t) if settle else t
    band = E.exact_quantiles(t, [], "amount", [0.05, 0.95]).select(F.transform("q", lambda x: F.round(x, 6)).alias("q") if settle else "q")
    full = C.with_usual(t, ["o_custkey"]).crossJoin(F.broadcast(band)).withColumn("is_core", F.col("amount").between(F.col("q")[0], F.col("q")[1])).drop("q")
    return staged(full, "plan-templates"), load(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")), t.agg(F.date_add(F.max("day"), 1).alias("start"))


LEAST = {"least_day": 3, "least_season": 2, "least_core": 2}


@query(f"WITH {PLAN_SLOTS} SELECT * FROM slots")
def r06_plan_slots(spark, d):
    """A template for each date of three horizons by five strategies, for every customer; pools are the customer's own orders."""
    return P.plan_slots(*plan_inputs(spark, d), "o_custkey", **LEAST)


def _stress_sql() -> str:
    """Means over the filled dates; a plan without any has none. least() and greatest() skip nulls, so empty dates are left out by a filter."""
    scores = ", ".join(f"avg({_share(C.WEIGHTS, f, s)}) FILTER (template_id IS NOT NULL) AS s{i}" for i, (_, f, s) in enumerate(C.STRESSES))
    fits = " + ".join(_share({"amount_fit": 1.0}, f, s) for _, f, s in C.STRESSES)
    return f"{scores}, avg(({fits}) / {len(C.STRESSES)}) FILTER (template_id IS NOT NULL) AS fit"


_S = [f"s{i}" for i in range(len(C.STRESSES))]
_LIMIT = {k: "CASE " + " ".join(f"WHEN horizon <= {row[0]} THEN {row[k]}" for row in P.PLAN_LIMITS) + " END" for k in (1, 2, 3)}


@query(f"""WITH {SETTLED_SLOTS}, x AS (SELECT s.*, f.* EXCLUDE (template_id, o_custkey, slot), f.slot AS signature FROM slots s LEFT JOIN full_t f USING (template_id)),
 g AS (SELECT o_custkey, strategy, horizon, count(template_id) AS n_filled, bool_and(is_core) AS in_band, bool_and(coalesce(has_small, false)) AS has_small, bool_and(coalesce(has_large, false)) AS has_large, {_stress_sql()} FROM x GROUP BY 1, 2, 3),
 c1 AS (SELECT o_custkey, strategy, horizon, max(n) AS most_t FROM (SELECT o_custkey, strategy, horizon, template_id, count(*) AS n FROM x WHERE template_id IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), c2 AS (SELECT o_custkey, strategy, horizon, max(n) AS most_s FROM (SELECT o_custkey, strategy, horizon, signature, count(*) AS n FROM x WHERE template_id IS NOT NULL GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
 c3 AS (SELECT DISTINCT a.o_custkey, a.strategy, a.horizon, true AS again FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.strategy = b.strategy AND a.horizon = b.horizon AND a.signature = b.signature AND b.slot_no < a.slot_no AND b.slot_no >= a.slot_no - {_LIMIT[3].replace("horizon", "a.horizon")}),
 r AS (SELECT *, list_avg([{", ".join(_S)}]) AS m, list_stddev_pop([{", ".join(_S)}]) AS sd, least({", ".join(_S)}) AS lo, greatest({", ".join(_S)}) AS hi FROM g LEFT JOIN c1 USING (o_custkey, strategy, horizon) LEFT JOIN c2 USING (o_custkey, strategy, horizon) LEFT JOIN c3 USING (o_custkey, strategy, horizon)),
 v AS (SELECT *, CASE WHEN m IS NOT NULL THEN least(greatest(0.8 * m + 0.2 * lo - 0.5 * sd, 0), 1) END AS robust, hi - lo AS fragility FROM r),
 y AS (SELECT *, concat_ws(';', CASE WHEN n_filled <> horizon THEN 'incomplete_horizon' END, CASE WHEN NOT has_small THEN 'missing_small' END, CASE WHEN NOT has_large THEN 'missing_large' END, CASE WHEN NOT in_band THEN 'outside_core_band' END, CASE WHEN most_t > {_LIMIT[1]} THEN 'template_repeat_above_limit' END,
  CASE WHEN most_s / n_filled::DOUBLE > {_LIMIT[2]} + 0.001 THEN 'signature_repeat_above_limit' END, CASE WHEN again THEN 'signature_repeated_inside_recent_window' END, CASE WHEN round(robust, 6) < {P.ROBUST_FLOOR} THEN 'robust_score_below_floor' END, CASE WHEN round(fit, 6) < {P.FIT_FLOOR} THEN 'robust_fit_below_floor' END, CASE WHEN round(fragility, 6) > {P.FRAGILITY_CEILING} THEN 'fragility_above_ceiling' END) AS reasons FROM v)
 SELECT o_custkey, strategy, horizon, n_filled, round(robust + 1e-9, 5) AS robust, round(fragility + 1e-9, 5) AS fragility, round(fit + 1e-9, 5) AS fit, reasons, reasons = '' AS promoted FROM y""")
def r07_reject_plans(spark, d):
    """All reasons against each plan of r06_plan_slots, with its robust score, fragility and fit under eight stresses."""
    t, customers, start = plan_inputs(spark, d, settle=True)
    required = ["has_small", "has_large"]
    judged = P.rejection_reasons(P.summed_plans(t.withColumnRenamed("slot", "signature"), customers, start, "o_custkey", required, **LEAST), required)
    return judged.select("o_custkey", "strategy", "horizon", "n_filled", *(F.round(F.col(c) + 1e-9, 5).alias(c) for c in ("robust", "fragility", "fit")), F.array_join("reasons", ";").alias("reasons"), "promoted")


@query(f"WITH {TEMPLATES}, p AS (SELECT o_custkey, string_agg(slot, '>' ORDER BY day, template_id) AS plan FROM templates GROUP BY 1) SELECT plan, min(o_custkey) AS kept, count(*) AS n FROM p GROUP BY 1")
def r08_dedupe_plans(spark, d):
    plan = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("day", "template_id", "slot"))), lambda x: x["slot"]), ">")
    return templates(spark, d).groupBy("o_custkey").agg(plan.alias("plan")).groupBy("plan").agg(F.min("o_custkey").alias("kept"), F.count("*").alias("n"))


@query(f"WITH {TEMPLATES}, x AS (SELECT template_id, 0.5 * least(amount / 200000, 1) + 0.5 * kinds / size::DOUBLE AS balanced, 0.8 * least(amount / 200000, 1) + 0.2 * kinds / size::DOUBLE AS amount_s, 0.2 * least(amount / 200000, 1) + 0.8 * kinds / size::DOUBLE AS variety FROM templates) SELECT template_id, unnest(['balanced', 'amount', 'variety']) AS strategy, round(unnest([balanced, amount_s, variety]) + 1e-9, 6) AS score FROM x")
def r03_strategy_scores(spark, d):
    t = templates(spark, d)
    a, v = F.least(F.col("amount") / 200000, F.lit(1.0)), F.col("kinds") / F.col("size")
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), F.round(x * a + y * v + 1e-9, 6).alias("score")) for n, (x, y) in C.STRATEGIES.items()))).alias("s")
    return t.select("template_id", rows).select("template_id", "s.*")


@query(f"WITH {TEMPLATES}, c AS (SELECT slot, kinds, count(*) AS n, avg(amount) AS amount FROM templates GROUP BY 1, 2 HAVING count(*) >= 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY slot)::DOUBLE AS share FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY round(0.6 * share + 0.4 * least(amount / 200000, 1), 6) DESC, kinds) AS place FROM s) SELECT slot, kinds, n, round(share, 6) AS share, round(0.6 * share + 0.4 * least(amount / 200000, 1) + 1e-9, 6) AS score, place FROM k")
def r09_r10_next_item(spark, d):
    """Kinds of items by slot: their share of the slot, and their rank."""
    c = templates(spark, d).groupBy("slot", "kinds").agg(F.count("*").alias("n"), F.avg("amount").alias("amount")).where("n >= 2")
    s = c.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("slot")))
    score = 0.6 * F.col("share") + 0.4 * F.least(F.col("amount") / 200000, F.lit(1.0))
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc(F.round(score, 6)), "kinds"))
    return s.select("slot", "kinds", "n", F.round("share", 6).alias("share"), F.round(score + 1e-9, 6).alias("score"), place.cast("long").alias("place"))


@query(f"WITH {SETTLED_TEMPLATES}, x AS (SELECT avg(amount) AS mean_amount, coalesce(CAST(NULL AS DOUBLE), round(quantile_cont(amount, 0.75), 6)) AS pressure FROM templates), s AS (SELECT template_id, o_custkey, support * CASE WHEN pressure > mean_amount THEN 0.6 ELSE 0.8 END + CASE WHEN amount > pressure THEN -0.1 ELSE 0.1 END AS adjusted FROM templates, x) SELECT template_id, round(adjusted + 1e-9, 6) AS adjusted, row_number() OVER (PARTITION BY o_custkey ORDER BY round(adjusted, 6) DESC, template_id) AS place FROM s")
def r11_r12_rerank(spark, d):
    """Ranks under a pressure that is one row of context, which a caller may override."""
    t = settled(templates(spark, d))
    quarter = E.exact_quantiles(t, [], "amount", [0.75]).select(F.coalesce(F.lit(None).cast("double"), F.round(F.col("q")[0], 6)).alias("pressure"))
    x = t.agg(F.avg("amount").alias("mean_amount")).crossJoin(quarter)
    adjusted = F.col("support") * F.when(F.col("pressure") > F.col("mean_amount"), 0.6).otherwise(0.8) + F.when(F.col("amount") > F.col("pressure"), -0.1).otherwise(0.1)
    s = t.crossJoin(F.broadcast(x)).select("template_id", "o_custkey", adjusted.alias("a"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(F.round("a", 6)), "template_id"))
    return s.select("template_id", F.round(F.col("a") + 1e-9, 6).alias("adjusted"), place.cast("long").alias("place"))


@query("WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS lo, quantile_cont(p_retailprice, 0.75) AS hi FROM part GROUP BY 1), v AS (SELECT p_partkey, p_brand, p_retailprice, unnest(['base', 'lighter', 'heartier']) AS variant, unnest([1.0, 0.9, 1.1])::DOUBLE AS m FROM part) SELECT p_partkey, variant, round(CASE WHEN m = 1 THEN p_retailprice ELSE least(greatest(p_retailprice * m, lo), hi) END + 1e-7, 4) AS amount FROM v JOIN q USING (p_brand) WHERE m = 1 OR abs(least(greatest(p_retailprice * m, lo), hi) - p_retailprice) BETWEEN 0.035 * p_retailprice AND 0.12 * p_retailprice")
def u09_portion_variants(spark, d):
    part = load(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice")
    q = E.exact_quantiles(part, ["p_brand"], "p_retailprice", [0.25, 0.75])
    variants = F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), F.lit(m).alias("m")) for n, m in (("base", 1.0), ("lighter", 0.9), ("heartier", 1.1)))))
    v = part.join(q, "p_brand").select("p_partkey", "p_retailprice", "q", variants)
    price = F.col("p_retailprice")
    bounded = F.least(F.greatest(price * F.col("m"), F.col("q")[0]), F.col("q")[1])
    amount = F.when(F.col("m") == 1, price).otherwise(bounded)
    return v.where((F.col("m") == 1) | F.abs(bounded - price).between(0.035 * price, 0.12 * price)).select("p_partkey", "variant", F.round(amount + 1e-7, 4).alias("amount"))


POOL = f"WITH {TEMPLATES}, p AS (SELECT template_id, slot, 'k' || kinds AS kind, amount BETWEEN 50000 AND 150000 AS is_core FROM templates), n1 AS (SELECT slot, count(*) AS n FROM p GROUP BY 1), n2 AS (SELECT kind, count(*) AS n FROM p GROUP BY 1), w AS (SELECT DISTINCT slot, kind FROM p), t AS (SELECT w.slot, w.kind, CASE WHEN n1.n >= 3500 THEN 1 WHEN n2.n >= 4000 THEN 2 ELSE 3 END AS tier FROM w JOIN n1 USING (slot) JOIN n2 USING (kind))"


@query(POOL + " SELECT t.slot, t.kind, t.tier, count(*) AS n_candidates, min(p.template_id) AS first_template FROM t JOIN p ON (tier = 1 AND p.slot = t.slot) OR (tier = 2 AND p.kind = t.kind) OR (tier = 3 AND p.is_core) GROUP BY 1, 2, 3")
def r02_candidate_pool(spark, d):
    """Pools by slot where a slot has many templates, else by kind, else the core band."""
    t = templates(spark, d).select("template_id", "slot", F.concat(F.lit("k"), F.col("kinds").cast("string")).alias("kind"), F.col("amount").between(50000, 150000).alias("is_core"), F.lit(0.0).alias("score"))
    pools = C.pool_members(t, "slot", "kind").groupBy("pool").agg(F.count("*").alias("n_candidates"), F.min("template_id").alias("first_template"))
    return C.candidate_tiers(t, t.select("slot", "kind").distinct(), "slot", "kind", 3500, 4000).join(pools, "pool").drop("pool")


@query(f"""WITH {TEMPLATES}, b AS (SELECT o_custkey, day, count(*) AS n_baskets, round(sum(amount), 4) AS total, round(avg(size), 6) AS mean_size, bool_or(slot = '1-URGENT') AS has_urgent, string_agg(slot, '>' ORDER BY slot, template_id) AS signature FROM templates GROUP BY 1, 2), m AS (SELECT median(total) AS middle FROM b)
 SELECT o_custkey, day, n_baskets, total, mean_size, has_urgent, signature, round(CASE WHEN has_urgent THEN total ELSE middle END, 4) AS planned FROM b, m""")
def a22_day_template_library(spark, d):
    signature = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "template_id"))), lambda x: x["slot"]), ">")
    b = templates(spark, d).groupBy("o_custkey", "day").agg(F.count("*").alias("n_baskets"), F.round(F.sum("amount"), 4).alias("total"), F.round(F.avg("size"), 6).alias("mean_size"), F.bool_or(F.col("slot") == "1-URGENT").alias("has_urgent"), signature.alias("signature"))
    b = staged(b, "day-templates")
    middle = E.exact_quantiles(b, [], "total", [0.5]).select(F.col("q")[0].alias("middle"))
    return b.crossJoin(F.broadcast(middle)).select(*b.columns, F.round(F.when(F.col("has_urgent"), F.col("total")).otherwise(F.col("middle")), 4).alias("planned"))


@query(f"WITH {TEMPLATES} SELECT o_custkey, template_id, rank() OVER (PARTITION BY o_custkey ORDER BY (kinds >= 2) DESC, size DESC, template_id) AS place FROM templates")
def t07_rank_plans(spark, d):
    """Promoted ones first, then by size."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc(F.col("kinds") >= 2), F.desc("size"), "template_id")
    return templates(spark, d).select("o_custkey", "template_id", F.rank().over(w).cast("long").alias("place"))


@query("""WITH t AS (SELECT p_brand AS template_id, string_agg(DISTINCT p_type, '|' ORDER BY p_type) FILTER (p_size > 40) AS signature, max(p_type) AS top_category, round(avg(p_retailprice), 6) AS score FROM part GROUP BY 1), i AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'X-' || p_type ELSE p_type END AS category FROM part), c AS (SELECT DISTINCT category FROM i),
 m AS (SELECT category, template_id, CASE WHEN contains(signature, category) THEN 1 WHEN top_category = category THEN 2 ELSE 3 END AS tier, row_number() OVER (PARTITION BY category ORDER BY CASE WHEN contains(signature, category) THEN 1 WHEN top_category = category THEN 2 ELSE 3 END, score DESC, template_id) AS n FROM c, t) SELECT p_partkey, template_id, tier FROM i JOIN m USING (category) WHERE n = 1""")
def j16_contains_join(spark, d):
    """Each brand is a template with the types of its larger parts as its signature; a part looks for one by its own type."""
    part = load(spark, d, "part")
    signature = F.array_join(F.array_sort(F.collect_set(F.when(F.col("p_size") > 40, F.col("p_type")))), "|")
    t = part.groupBy(F.col("p_brand").alias("template_id")).agg(F.nullif(signature, F.lit("")).alias("signature"), F.max("p_type").alias("top_category"), F.round(F.avg("p_retailprice"), 6).alias("score"))
    items = part.select("p_partkey", F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("X-"), "p_type")).otherwise(F.col("p_type")).alias("category"))
    return items.join(C.contains_join(items.select("category").distinct(), t), "category").select("p_partkey", "template_id", "tier")


@query("""WITH i AS (SELECT p_partkey, p_retailprice, lower(p_type) || '|' || CASE WHEN p_size % 4 = 0 THEN 'unknown' ELSE 'size' || p_size % 4 END || CASE WHEN p_size % 4 = 0 THEN '|' || coalesce(list_sort(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'with', 'of')))[1], 'unknown') ELSE '' END AS cluster FROM part), q AS (SELECT cluster, count(*) AS n, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS kept, min(p_retailprice) AS least, max(p_retailprice) AS most, avg(p_retailprice) AS mean FROM i GROUP BY 1)
 SELECT p_partkey, cluster, n, kept, p_partkey = kept AS is_kept, round(least(greatest(mean / p_retailprice, 0.85), 1.15) + 1e-9, 6) AS portion FROM i JOIN q USING (cluster)""")
def r10_f08_cluster_items(spark, d):
    """Near-identical items share a key (their first word counts where the kind is not known); the dearest stands for them, and portions are guided to the mean within bounds."""
    size = F.when(F.col("p_size") % 4 > 0, F.concat(F.lit("size"), (F.col("p_size") % 4).cast("string")))
    i = load(spark, d, "part").select("p_partkey", "p_retailprice", S.cluster_key(F.col("p_type"), size, fallback=F.col("p_name")).alias("cluster"))
    q = i.groupBy("cluster").agg(F.count("*").alias("n"), F.max(F.struct("p_retailprice", (-F.col("p_partkey")).alias("k"))).alias("top"), F.avg("p_retailprice").alias("mean"))
    portion = S.clip(F.col("mean") / F.col("p_retailprice"), 0.85, 1.15)
    kept = (-F.col("top.k")).alias("kept")
    return i.join(q, "cluster").select("p_partkey", "cluster", "n", kept, (F.col("p_partkey") == -F.col("top.k")).alias("is_kept"), F.round(portion + 1e-9, 6).alias("portion"))


@query("""WITH p AS (SELECT p_partkey, p_brand || '/' || p_type AS signature, p_brand, p_retailprice AS x FROM part), s AS (SELECT signature, count(*) AS ns, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM p GROUP BY 1), c AS (SELECT p_brand, count(*) AS nc, quantile_cont(x, 0.25) AS ca, quantile_cont(x, 0.75) AS cb FROM p GROUP BY 1), bd AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM p),
 t AS (SELECT p_partkey, x, lo, hi, CASE WHEN ns >= 3 THEN 'signature' WHEN nc >= 3 THEN 'category' END AS scope, CASE WHEN ns >= 3 THEN a ELSE ca END AS q1, CASE WHEN ns >= 3 THEN b ELSE cb END AS q3 FROM p JOIN s USING (signature) JOIN c USING (p_brand), bd),
 v AS (SELECT p_partkey, x, lo, hi, scope, unnest(['observed', 'lighter', 'heartier']) AS variant, unnest([1.0::DOUBLE, least(greatest(greatest(q1, x * 0.88::DOUBLE) / x, 0.88::DOUBLE), 1.12::DOUBLE), least(greatest(least(q3, x * 1.12::DOUBLE) / x, 0.88::DOUBLE), 1.12::DOUBLE)]) AS m FROM t)
 SELECT p_partkey, variant, round(m + 1e-9, 6) AS multiplier, round(x * m + 1e-7, 4) AS amount, CASE WHEN variant <> 'observed' THEN scope END AS scope FROM v WHERE variant = 'observed' OR (scope IS NOT NULL AND abs(m - 1) >= 0.035 AND x * m BETWEEN lo AND hi)""")
def u09_bounded_variants(spark, d):
    """Lighter and heartier parts within the quartiles of their brand and type, or of their brand where those are too few."""
    part = load(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("/"), "p_type").alias("signature"), "p_brand", "p_retailprice")
    v = P.portion_variants(part, "p_partkey", "signature", "p_brand", "p_retailprice")
    return v.select("p_partkey", "variant", F.round(F.col("multiplier") + 1e-9, 6).alias("multiplier"), F.round(F.col("amount") + 1e-7, 4).alias("amount"), "scope")


@query(f"WITH {TEMPLATES}, x AS (SELECT o_custkey, quantile_cont(amount, 0.75) AS pressure, avg(amount) AS mean_amount FROM templates GROUP BY 1), o AS (SELECT c_custkey AS o_custkey, c_acctbal * 20 AS np FROM customer WHERE c_acctbal > 5000), y AS (SELECT x.o_custkey, coalesce(np, pressure) AS pressure, mean_amount, np IS NOT NULL AS overridden FROM x LEFT JOIN o USING (o_custkey)), s AS (SELECT template_id, o_custkey, overridden, support * CASE WHEN pressure > mean_amount THEN 0.6 ELSE 0.8 END + CASE WHEN amount > pressure THEN -0.1 ELSE 0.1 END AS a FROM templates JOIN y USING (o_custkey)) SELECT template_id, round(a + 1e-9, 6) AS adjusted, overridden, row_number() OVER (PARTITION BY o_custkey ORDER BY round(a, 6) DESC, template_id) AS place FROM s")
def r12_override_and_rerank(spark, d):
    """Each customer's own pressure, replaced where the customer's balance supplies one, ranks that customer's orders."""
    t = templates(spark, d)
    own = t.groupBy("o_custkey").agg(F.avg("amount").alias("mean_amount")).join(E.exact_quantiles(t, ["o_custkey"], "amount", [0.75]).select("o_custkey", F.col("q")[0].alias("pressure")), "o_custkey")
    given = load(spark, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_acctbal") * 20).alias("pressure"))
    x = P.override_context(own, given, ["o_custkey"])
    adjusted = F.col("support") * F.when(F.col("pressure") > F.col("mean_amount"), 0.6).otherwise(0.8) + F.when(F.col("amount") > F.col("pressure"), -0.1).otherwise(0.1)
    s = t.join(x, "o_custkey").select("template_id", "o_custkey", "overridden", adjusted.alias("a"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc(F.round("a", 6)), "template_id"))
    return s.select("template_id", F.round(F.col("a") + 1e-9, 6).alias("adjusted"), "overridden", place.cast("long").alias("place"))
