"""Plans: a template for each date of a horizon by the rank of a strategy, and why a plan is rejected.

A pool of templates is ranked once for each entity, kind of day and strategy,
and holds as many templates as a horizon can ask for, so a date looks its
template up by rank; no plan is built step by step. All entities have the same
dates, so dates and kinds of days are a few rows that are sent to every task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import season
from tideline.operators.evaluation import exact_quantiles
from tideline.operators.scenarios import STRESSES, WEIGHTS, clip, component_scores
from tideline.sources.shared import staged

# Shares of the component scores by strategy; the cycle of ranks; limits by horizon (longest horizon, most of one
# template, most of one signature as a share, and days in which a signature may not return); floors and ceiling of a plan.
PLAN_STRATEGIES: dict[str, dict[str, float]] = {
    "balanced": WEIGHTS,
    "amount": {"amount_fit": 0.65, "mix": 0.20, "size_fit": 0.15},
    "variety": {"novelty": 0.55, "mix": 0.25, "amount_fit": 0.20},
    "routine": {"support": 0.55, "size_fit": 0.25, "amount_fit": 0.20},
    "mix": {"mix": 0.55, "amount_fit": 0.25, "novelty": 0.20},
}
HORIZONS = (3, 5, 7)
CYCLE = 7
PLAN_LIMITS = ((3, 1, 0.34, 2), (7, 1, 0.30, 3), (14, 2, 0.24, 4), (10_000, 3, 0.20, 5))
ROBUST_FLOOR, FIT_FLOOR, FRAGILITY_CEILING = 0.50, 0.45, 0.22


def weighted(parts: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * parts[name]
    return clip(total, 0.0, 1.0)


def _parts(factor: float = 1.0, shift: int = 0) -> dict[str, Column]:
    size = F.greatest(F.col("size") + shift, F.lit(1)).cast("double")
    return component_scores(F.col("amount") * factor, size, F.col("kinds").cast("double"), F.col("support"), F.col("usual_amount"), F.col("usual_size"))


def day_kind(day: str | Column) -> list[Column]:
    """Whether a date is at a weekend, and its season: what a date asks of its pool."""
    return [F.dayofweek(day).isin(1, 7).alias("is_weekend"), season(F.month(day)).alias("season")]


def with_scores(templates: DataFrame) -> DataFrame:
    """The templates and ``scores``, one by strategy. The component scores are columns first, so each is worked out once: one expression of all takes about six times as long."""
    parts = _parts()
    t = templates.select("*", *(c.alias(f"_{n}") for n, c in parts.items()))
    scores = F.array(*(F.round(weighted({n: F.col(f"_{n}") for n in parts}, w) + 1e-9, 6) for w in PLAN_STRATEGIES.values()))
    return t.withColumn("scores", scores).drop(*(f"_{n}" for n in parts))


def ranked_pools(templates: DataFrame, kinds: DataFrame, e: str, least_day: int = 12, least_season: int = 8, least_core: int = 8, cycle: int = CYCLE) -> DataFrame:
    """e, the columns of ``kinds``, strategy and ``best``: the pool's templates by rank, ``cycle`` at most.

    A pool is all templates of the entity; of these the ones of the same kind of
    day if they are enough, of these the ones of the season, of these the ones in
    the core band. ``kinds`` has a row for each kind of day. An entity's templates
    are gathered once and filtered and ranked in place, so they must be few: see
    dealt_pools.
    """
    own = with_scores(templates).select(e, F.struct("template_id", "is_core", *(c.alias(f"t_{n}") for c, n in zip(day_kind("day"), ("weekend", "season"), strict=True)), "scores").alias("t")).groupBy(e).agg(F.collect_list("t").alias("pool"))
    met = own.crossJoin(F.broadcast(kinds))
    for least, same in ((least_day, lambda x: x["t_weekend"] == F.col("is_weekend")), (least_season, lambda x: x["t_season"] == F.col("season")), (least_core, lambda x: x["is_core"])):
        met = met.withColumn("_same", F.filter("pool", same)).withColumn("pool", F.when(F.size("_same") >= least, F.col("_same")).otherwise(F.col("pool"))).drop("_same")

    def best(i: int) -> Column:
        """By the fields in which structs are sorted: no score last, then the largest score, then the least id."""
        ordered = F.sort_array(F.transform("pool", lambda x: F.struct(x["scores"][i].isNull().alias("none"), (-x["scores"][i]).alias("score"), x["template_id"].alias("template_id"))))
        return F.transform(F.slice(ordered, 1, cycle), lambda x, at: F.struct((at + 1).alias("rank"), x["template_id"].alias("template_id"), (-x["score"]).alias("score")))

    return met.select(e, *kinds.columns, F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), best(i).alias("best")) for i, n in enumerate(PLAN_STRATEGIES)))))


def dealt_pools(templates: DataFrame, kinds: DataFrame, e: str, least_day: int = 12, least_season: int = 8, least_core: int = 8, cycle: int = CYCLE) -> DataFrame:
    """The rows of ranked_pools for entities with very many templates: ranks are taken in hash buckets first, so an entity is dealt out."""
    same = {"day": F.col("t_weekend") == F.col("is_weekend"), "season": F.col("t_season") == F.col("season"), "core": F.col("is_core")}
    keys = [e, "is_weekend", "season"]
    own = with_scores(templates).select(e, "template_id", "is_core", "scores", *(c.alias(f"t_{n}") for c, n in zip(day_kind("day"), ("weekend", "season"), strict=True)))
    met = own.crossJoin(F.broadcast(kinds.select(*keys[1:])))
    number = lambda *names: F.count(F.when(_all([same[x] for x in names]), 1))
    counts = met.groupBy(*keys).agg(number("day").alias("d"), number("season").alias("s"), number("day", "season").alias("ds"), number("core").alias("c"), number("day", "core").alias("dc"), number("season", "core").alias("sc"), number("day", "season", "core").alias("dsc"))
    by_day = F.col("d") >= least_day
    by_season = F.when(by_day, F.col("ds")).otherwise(F.col("s")) >= least_season
    in_core = F.when(by_day & by_season, F.col("dsc")).when(by_day, F.col("dc")).when(by_season, F.col("sc")).otherwise(F.col("c")) >= least_core
    uses = counts.select(*keys, by_day.alias("by_day"), by_season.alias("by_season"), in_core.alias("in_core"))
    pool = met.join(uses, keys).where((same["day"] | ~F.col("by_day")) & (same["season"] | ~F.col("by_season")) & (same["core"] | ~F.col("in_core")))
    scores = F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), F.col("scores")[i].alias("score")) for i, n in enumerate(PLAN_STRATEGIES))))
    scored = pool.select(*keys, "template_id", scores).withColumn("_b", F.pmod(F.xxhash64("template_id"), F.lit(64)))
    order = (F.desc("score"), "template_id")
    few = scored.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "strategy", "_b").orderBy(*order))).where(F.col("_n") <= cycle)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "strategy").orderBy(*order))).where(F.col("rank") <= cycle)
    pools = best.groupBy(*keys, "strategy").agg(F.array_sort(F.collect_list(F.struct("rank", "template_id", "score"))).alias("best"))
    return pools.join(F.broadcast(kinds), keys[1:]).select(e, *kinds.columns, "strategy", "best")


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def plan_dates(start: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """A row for each kind of day: is_weekend, season and ``dates``, those of each horizon; ``start`` is one row with the first date."""
    slots = F.inline(F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(k).alias("slot_no")) for h in horizons for k in range(h))))
    dated = start.select("start", slots).withColumn("planned_date", F.date_add("start", F.col("slot_no")))
    dated = dated.select(F.struct("horizon", "slot_no", "planned_date", F.date_format("planned_date", "EEEE").alias("planned_day_of_week")).alias("date"), *day_kind("planned_date"))
    return dated.groupBy("is_weekend", "season").agg(F.collect_list("date").alias("dates"))


def plan_slots(templates: DataFrame, entities: DataFrame, start: DataFrame, e: str, horizons: Sequence[int] = HORIZONS, gathered: int = 4096, **least: int) -> DataFrame:
    """The template of each entity, strategy, horizon and date: that of rank (date's number modulo the pool's size) in the date's pool; null if the entity has none.

    ``templates`` has e, template_id, day, amount, size, kinds, support,
    usual_amount, usual_size and is_core. It is read more than once. Entities
    with more than ``gathered`` templates are dealt out, with the same result.
    """
    kinds, entities = plan_dates(start, horizons), entities.select(e)
    many = staged(templates.groupBy(e).agg(F.count("*").alias("_n")).where((F.col("_n") > gathered) & F.col(e).isNotNull()).select(e), "plan-many")
    hot = bool(many.head(1))
    few = templates.join(many, e, "left_anti") if hot else templates
    pools = ranked_pools(few, kinds, e, **least)
    if hot:
        pools = pools.unionByName(dealt_pools(templates.join(many, e, "left_semi"), kinds, e, **least))
    # Entities without a template have no pool: all their dates are empty.
    empty = kinds.select(*kinds.columns, F.explode(F.array(*map(F.lit, PLAN_STRATEGIES))).alias("strategy"), F.lit(None).cast(pools.schema["best"].dataType).alias("best"))
    found = entities.join(pools, e).unionByName(entities.join(templates.select(e), e, "left_anti").crossJoin(F.broadcast(empty)))
    dated = found.select(e, "strategy", "best", F.inline("dates"))
    pick = F.get("best", F.col("slot_no") % F.nullif(F.size("best"), F.lit(0)))
    return dated.select(e, "strategy", "horizon", "slot_no", "planned_date", "planned_day_of_week", pick["rank"].cast("int").alias("rank"), pick["template_id"].alias("template_id"), pick["score"].alias("score"))


def under_stress(templates: DataFrame, *kept: str) -> DataFrame:
    """template_id (and the columns ``kept``) with the score and the fit of its amount under each stress, as arrays in the order of the stresses."""
    parts = [_parts(factor, shift) for _, factor, shift in STRESSES]
    t = templates.select("template_id", *kept, *(c.alias(f"_{n}{i}") for i, p in enumerate(parts) for n, c in p.items()))
    scores = [weighted({n: F.col(f"_{n}{i}") for n in p}, WEIGHTS) for i, p in enumerate(parts)]
    return t.select("template_id", *kept, F.array(*scores).alias("scores"), F.array(*(f"_amount_fit{i}" for i in range(len(parts)))).alias("fits"))


def plan_summary(slots: DataFrame, facts: DataFrame, e: str, required: Sequence[str]) -> DataFrame:
    """A row for each plan: what its templates add up to, its robust score and fragility under the stresses.

    ``facts`` has template_id, signature, amount, is_core, scores and fits, and
    a flag for each required part. No stress is a row: a plan's scores are means by stress.
    """
    keys = [e, "strategy", "horizon"]
    n = len(STRESSES)
    filled = slots.select(*keys, "slot_no", "template_id").join(facts, "template_id", "left")
    # What is gathered is as long as the horizon.
    days = F.transform(F.array_sort(F.collect_list(F.when(F.col("template_id").isNotNull(), F.struct("slot_no", "template_id", "signature")))), lambda x: F.struct(x["template_id"].alias("template_id"), x["signature"].alias("signature")))
    plans = filled.groupBy(*keys).agg(
        F.count("template_id").alias("n_filled"), days.alias("days"), F.bool_and("is_core").alias("in_band"), F.avg("amount").alias("mean_amount"), *(F.bool_and(F.coalesce(F.col(c), F.lit(False))).alias(c) for c in required),
        *(F.avg(F.col("scores")[i]).alias(f"s{i}") for i in range(n)), F.avg(_mean_fit()).alias("fit"),
    )
    return _with_toughness(plans, [*keys, "n_filled", "days", "in_band", "mean_amount", *required])


def _mean_fit() -> Column:
    return F.aggregate("fits", F.lit(0.0), lambda a, x: a + x) / len(STRESSES)


def _with_toughness(plans: DataFrame, kept: Sequence[str]) -> DataFrame:
    """The columns ``kept``, and the robust score, fragility and fit of plans whose means by stress are s0, s1, ..."""
    n = len(STRESSES)
    scores = [F.col(f"s{i}") for i in range(n)]
    mean = sum(scores[1:], scores[0]) / n
    spread = F.sqrt(sum(((s - mean) * (s - mean) for s in scores[1:]), (scores[0] - mean) * (scores[0] - mean)) / n)
    robust = clip(0.8 * mean + 0.2 * F.least(*scores) - 0.5 * spread, 0.0, 1.0)
    return plans.select(*kept, robust.alias("robust"), (F.greatest(*scores) - F.least(*scores)).alias("fragility"), "fit")


def summed_plans(templates: DataFrame, entities: DataFrame, start: DataFrame, e: str, required: Sequence[str], horizons: Sequence[int] = HORIZONS, gathered: int = 4096, **least: int) -> DataFrame:
    """The rows of plan_summary over plan_slots, with no row for a date: plans are summed where an entity's templates are gathered.

    ``templates`` has what plan_slots asks for, and signature and a flag for each
    required part. It is read more than once. What is shuffled is the templates,
    once, by entity. Entities with more than ``gathered`` templates go by way of
    plan_slots; they are few, and so are their dates.
    """
    entities = entities.select(e)
    many = staged(templates.groupBy(e).agg(F.count("*").alias("_n")).where((F.col("_n") > gathered) & F.col(e).isNotNull()).select(e), "plan-many")
    if not many.head(1):
        return _gathered_plans(templates, templates, entities, start, e, required, horizons, **least)
    plans = _gathered_plans(templates.join(many, e, "left_anti"), templates, entities.join(many, e, "left_anti"), start, e, required, horizons, **least)
    slots = staged(plan_slots(templates.join(many, e, "left_semi"), entities.join(many, e, "left_semi"), start, e, horizons, gathered, **least), "plan-slots")
    met = staged(templates.join(slots.select("template_id").distinct(), "template_id", "left_semi"), "plan-met")
    facts = under_stress(met).join(met.select("template_id", "signature", "amount", "is_core", *required), "template_id")
    return plans.unionByName(plan_summary(slots, facts, e, required))


def _judged(templates: DataFrame, required: Sequence[str]) -> DataFrame:
    """The templates with ``fact``, what a plan sums of them; ``values`` are the scores by stress, the mean fit and the amount."""
    t = under_stress(templates, *(c for c in templates.columns if c != "template_id"))
    values = F.array(*(F.col("scores")[i] for i in range(len(STRESSES))), _mean_fit(), F.col("amount").cast("double"))
    return t.withColumn("fact", F.struct("signature", "is_core", *required, values.alias("values"))).drop("scores", "fits")


def _gathered_plans(templates: DataFrame, all_templates: DataFrame, entities: DataFrame, start: DataFrame, e: str, required: Sequence[str], horizons: Sequence[int], least_day: int = 12, least_season: int = 8, least_core: int = 8, cycle: int = CYCLE) -> DataFrame:
    """summed_plans of entities with few templates. All that a plan needs lies in one row of its entity, so nothing is shuffled after the gathering."""
    spark, n = templates.sparkSession, len(STRESSES)
    asks = [e, "template_id", "day", "amount", "size", "kinds", "support", "usual_amount", "usual_size", "is_core", "signature", *required]
    few = templates.where(F.col(e).isNotNull()).select(*asks)
    # A date meets all rows with its template's id. Nearly always that is the template's own row, so only ids that come again are gathered by id.
    again = staged(all_templates.groupBy("template_id").agg(F.count("*").alias("_n")).where("_n > 1").select("template_id"), "plan-again")
    facts = F.array("fact")
    if again.head(1):
        twins = _judged(all_templates.select(*asks).join(again, "template_id", "left_semi"), required).groupBy("template_id").agg(F.collect_list("fact").alias("twins"))
        few, facts = few.join(twins, "template_id", "left"), F.coalesce("twins", facts)
    # As many tasks as keep the gathered rows, which are larger than the shuffled ones, in memory.
    parts = max(spark.sparkContext.defaultParallelism, -(-templates.count() // 65536))
    rows = few.unionByName(entities.select(e, F.lit(1).alias("asked")), allowMissingColumns=True).repartition(parts, e)
    t = F.struct("template_id", "is_core", *(c.alias(f"t_{x}") for c, x in zip(day_kind("day"), ("weekend", "season"), strict=True)), "scores", facts.alias("facts"))
    own = with_scores(_judged(rows, required)).groupBy(e).agg(F.collect_list(F.when(F.col("asked").isNull(), t)).alias("pool"), F.count("asked").cast("int").alias("times")).where("times > 0")

    # Kinds of days are an array, and so are the pools by kind.
    dated = start.select(F.transform(F.sequence(F.lit(0), F.lit(max(horizons) - 1)), lambda k: F.struct(*day_kind(F.date_add("start", k)))).alias("dates"))
    dated = dated.select("dates", F.array_distinct("dates").alias("day_kinds")).select("day_kinds", F.transform("dates", lambda x: F.array_position("day_kinds", x).cast("int") - 1).alias("kind_of"))
    met = own.crossJoin(F.broadcast(dated)).withColumn("pools", F.array_repeat("pool", F.size("day_kinds"))).drop("pool")
    for least, same in ((least_day, lambda x, kind: x["t_weekend"] == kind["is_weekend"]), (least_season, lambda x, kind: x["t_season"] == kind["season"]), (least_core, lambda x, kind: x["is_core"])):
        met = met.withColumn("some", F.zip_with("pools", "day_kinds", lambda pool, kind: F.filter(pool, lambda x: same(x, kind))))
        met = met.withColumn("pools", F.zip_with("some", "pools", lambda some, pool: F.when(F.size(some) >= least, some).otherwise(pool))).drop("some")

    def best(i: int) -> Column:
        """In the order of ranked_pools."""
        ordered = lambda pool: F.sort_array(F.transform(pool, lambda x: F.struct(x["scores"][i].isNull().alias("none"), (-x["scores"][i]).alias("score"), x["template_id"].alias("template_id"), x["facts"].alias("facts"))))
        return F.transform("pools", lambda pool: F.slice(ordered(pool), 1, cycle))

    def pick(kind: Column, slot_no: Column) -> Column:
        ranks = F.get("best", kind)
        return F.get(ranks, slot_no % F.nullif(F.size(ranks), F.lit(0)))

    def filled(x: Column, slot_no: Column) -> Column:
        """A date's rows, as the join of its template's id with the facts, which are joined from two sides, would give them."""
        return F.transform(F.flatten(F.array_repeat(x["facts"], F.size(x["facts"]))), lambda f: F.struct(slot_no.alias("slot_no"), x["template_id"].alias("template_id"), *(f[c].alias(c) for c in ("signature", "is_core", *required, "values"))))

    chosen = met.select(e, "times", "kind_of", F.inline(F.array(*(F.struct(F.lit(x).alias("strategy"), best(i).alias("best")) for i, x in enumerate(PLAN_STRATEGIES)))))
    chosen = chosen.select(e, "times", "strategy", F.transform("kind_of", pick).alias("picks")).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("picks", F.slice("picks", 1, F.col("horizon")))
    held = chosen.select("*", F.flatten(F.filter(F.transform("picks", filled), lambda x: x.isNotNull())).alias("rows"))
    zeros, known = F.array_repeat(F.lit(0.0), n + 2), lambda x: F.when(x.isNull(), 0.0).otherwise(1.0)
    held = held.select(
        "*", F.aggregate("rows", zeros, lambda a, r: F.zip_with(a, r["values"], lambda x, y: x + F.coalesce(y, F.lit(0.0)))).alias("sums"), F.aggregate("rows", zeros, lambda a, r: F.zip_with(a, r["values"], lambda x, y: x + known(y))).alias("counts"),
        F.sort_array(F.flatten(F.array_repeat(F.transform("rows", lambda r: F.struct(r["slot_no"].alias("slot_no"), r["template_id"].alias("template_id"), r["signature"].alias("signature"))), F.col("times")))).alias("sorted"),
    )
    mean = lambda i: F.col("sums")[i] / F.nullif(F.col("counts")[i], F.lit(0.0))
    any_row = lambda test: F.exists("rows", lambda r: F.coalesce(test(r), F.lit(False)))
    no_gap = F.forall("picks", lambda x: x.isNotNull())
    plans = held.select(
        e, "strategy", "horizon", (F.size("rows") * F.col("times")).cast("long").alias("n_filled"), F.transform("sorted", lambda x: F.struct(x["template_id"].alias("template_id"), x["signature"].alias("signature"))).alias("days"),
        F.when(any_row(lambda r: ~r["is_core"]), False).when(any_row(lambda r: r["is_core"]), True).alias("in_band"), mean(n + 1).alias("mean_amount"), *((no_gap & ~any_row(lambda r, c=c: ~F.coalesce(r[c], F.lit(False)))).alias(c) for c in required),
        *(mean(i).alias(f"s{i}") for i in range(n)), mean(n).alias("fit"),
    )
    return _with_toughness(plans, [e, "strategy", "horizon", "n_filled", "days", "in_band", "mean_amount", *required])


def limit_of(horizon: Column, field: int) -> Column:
    """A limit by horizon: 1 most of a template, 2 share of a signature, 3 days in which it may not return."""
    out = F.lit(PLAN_LIMITS[-1][field])
    for row in reversed(PLAN_LIMITS[:-1]):
        out = F.when(horizon <= row[0], F.lit(row[field])).otherwise(out)
    return out


def rejection_reasons(plans: DataFrame, required: Sequence[str]) -> DataFrame:
    """plan_summary with ``reasons``, all that hold in a fixed order, and ``promoted`` where none does."""
    ids, signatures = F.transform("days", lambda x: x["template_id"]), F.transform("days", lambda x: x["signature"])
    h = F.col("horizon")
    most = lambda xs: F.array_max(F.transform(F.array_distinct(xs), lambda x: F.size(F.filter(xs, lambda y: y == x))))
    again = F.exists(F.sequence(F.lit(0), F.size("days") - 1), lambda i: F.array_contains(F.slice(signatures, F.greatest(i - limit_of(h, 3), F.lit(0)) + 1, F.least(i, limit_of(h, 3))), F.get(signatures, i)))
    any_day = F.size("days") > 0
    checks = {
        "incomplete_horizon": F.col("n_filled") != h,
        **{f"missing_{c.removeprefix('has_')}": ~F.col(c) for c in required},
        "outside_core_band": ~F.col("in_band"),
        "template_repeat_above_limit": most(ids) > limit_of(h, 1),
        "signature_repeat_above_limit": most(signatures) / F.size("days") > limit_of(h, 2) + 0.001,
        "signature_repeated_inside_recent_window": F.when(any_day, again),
        "robust_score_below_floor": F.round("robust", 6) < ROBUST_FLOOR,
        "robust_fit_below_floor": F.round("fit", 6) < FIT_FLOOR,
        "fragility_above_ceiling": F.round("fragility", 6) > FRAGILITY_CEILING,
    }
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in checks.items())))
    return plans.withColumn("reasons", reasons).withColumn("promoted", F.size("reasons") == 0)


# How far a portion may move, the least move that counts, and the rows that a cluster needs.
PORTION_LOW, PORTION_HIGH, LEAST_MOVE, LEAST_CLUSTER = 0.88, 1.12, 0.035, 3


def portion_variants(templates: DataFrame, id_: str, signature: str, category: str, amount: str) -> DataFrame:
    """Each template as observed, and lighter and heartier within the quartiles of its signature, or of its category where the signature has too few rows.

    A variant must move the amount enough and stay in the table's band from the
    5th to the 95th percentile. Columns: id, variant, multiplier, amount, scope.
    """
    x = F.col(amount)
    known = templates.where(x.isNotNull())
    scopes = {}
    for name, key in (("signature", signature), ("category", category)):
        sizes = templates.groupBy(key).agg(F.count("*").alias(f"n_{name}"))
        scopes[name] = sizes.join(exact_quantiles(known, [key], amount, [0.25, 0.75]).withColumnRenamed("q", f"q_{name}"), key, "left")
    band = exact_quantiles(known, [], amount, [0.05, 0.95]).withColumnRenamed("q", "band")
    t = templates.select(id_, signature, category, amount).join(scopes["signature"], signature, "left").join(scopes["category"], category, "left").crossJoin(F.broadcast(band))
    scope = F.when(F.col("n_signature") >= LEAST_CLUSTER, "signature").when(F.col("n_category") >= LEAST_CLUSTER, "category")
    t = t.withColumn("scope", scope).withColumn("q", F.when(F.col("scope") == "signature", F.col("q_signature")).when(F.col("scope") == "category", F.col("q_category")))
    move = lambda target: clip(target / F.when(x > 0, x), PORTION_LOW, PORTION_HIGH)
    lighter, heartier = move(F.greatest(F.col("q")[0], x * PORTION_LOW)), move(F.least(F.col("q")[1], x * PORTION_HIGH))
    variants = F.inline(F.array(*(F.struct(F.lit(n).alias("variant"), m.alias("multiplier")) for n, m in (("observed", F.lit(1.0)), ("lighter", lighter), ("heartier", heartier)))))
    v = t.select(id_, amount, "scope", "band", variants)
    moved = F.abs(F.col("multiplier") - 1) >= LEAST_MOVE
    inside = (x * F.col("multiplier")).between(F.col("band")[0], F.col("band")[1])
    return v.where((F.col("variant") == "observed") | (F.col("scope").isNotNull() & (x > 0) & moved & inside)).select(id_, "variant", "multiplier", (x * F.col("multiplier")).alias("amount"), F.when(F.col("variant") != "observed", F.col("scope")).alias("scope"))


def override_context(context: DataFrame, overrides: DataFrame, key: Sequence[str]) -> DataFrame:
    """The context with the values that the overrides supply; a null, or no row, leaves a value as it is. Overrides have one row for each key."""
    names = [c for c in overrides.columns if c in context.columns and c not in key]
    given = overrides.select(*key, *(F.col(c).alias(f"_new_{c}") for c in names))
    joined = context.join(given, list(key), "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in context.columns), F.greatest(F.lit(False), *(F.col(f"_new_{c}").isNotNull() for c in names)).alias("overridden"))
