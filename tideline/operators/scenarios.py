"""Templates, stress grids, plans and next-item scores as joins of tables.

The only tables that are crossed with all rows have a fixed number of rows:
stresses, strategies and the days of a horizon.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.scalars import clip

# The usual weights of the five component scores, stresses (name, factor of amount, shift of size), and strategies.
WEIGHTS = {"amount_fit": 0.30, "size_fit": 0.15, "mix": 0.15, "support": 0.25, "novelty": 0.15}
STRESSES = (("none", 1.0, 0), ("more", 1.1, 0), ("less", 0.9, 0), ("larger", 1.0, 1), ("smaller", 1.0, -1), ("more_larger", 1.1, 1), ("less_smaller", 0.9, -1), ("much_more", 1.25, 0))
STRATEGIES = {"balanced": (0.5, 0.5), "amount": (0.8, 0.2), "variety": (0.2, 0.8)}


def stress_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(STRESSES), "stress string, factor double, shift int")


def component_scores(amount: Column, size: Column, kinds: Column, support: Column, usual_amount: Column, usual_size: Column) -> dict[str, Column]:
    """Scores from 0 to 1: nearness to the usual amount and size, mix of kinds, support, and novelty."""
    near = lambda x, usual: clip(1 - F.abs(x - usual) / F.greatest(usual, F.lit(1.0)), 0.0, 1.0)
    return {"amount_fit": near(amount, usual_amount), "size_fit": near(size, usual_size), "mix": clip(kinds / F.greatest(size, F.lit(1.0)), 0.0, 1.0), "support": clip(support, 0.0, 1.0), "novelty": 1 - clip(support, 0.0, 1.0)}


def with_usual(templates: DataFrame, keys: list[str]) -> DataFrame:
    """Each template beside the mean amount and size of its keys."""
    usual = templates.groupBy(*keys).agg(F.avg("amount").alias("usual_amount"), F.avg("size").alias("usual_size"))
    return templates.join(usual, keys)


def score_under_stress(templates: DataFrame, weights: Mapping[str, float] = WEIGHTS) -> DataFrame:
    """Each template of with_usual under each stress: its weighted score."""
    t = templates.crossJoin(F.broadcast(stress_grid(templates.sparkSession)))
    parts = component_scores(F.col("amount") * F.col("factor"), F.greatest(F.col("size") + F.col("shift"), F.lit(1)).cast("double"), F.col("kinds").cast("double"), F.col("support"), F.col("usual_amount"), F.col("usual_size"))
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * parts[name]
    return t.withColumn("score", clip(total, 0.0, 1.0))


def robust_score(stressed: DataFrame, key: str) -> DataFrame:
    """0.8 of the mean and 0.2 of the least, less half the spread; and the span between the best and the worst."""
    s = stressed.groupBy(key).agg(F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.stddev_pop("score").alias("std"))
    return s.select(key, clip(0.8 * F.col("mean") + 0.2 * F.col("least") - 0.5 * F.col("std"), 0.0, 1.0).alias("robust"), (F.col("most") - F.col("least")).alias("fragility"))


def candidate_tiers(templates: DataFrame, wanted: DataFrame, first: str, second: str, least_first: int = 12, least_second: int = 8) -> DataFrame:
    """Wanted rows with ``tier`` and ``pool``: their first category's pool if that is large enough, else their second's, else the core band's."""
    a = templates.groupBy(first).agg(F.count("*").alias("_n1"))
    b = templates.groupBy(second).agg(F.count("*").alias("_n2"))
    tier = F.when(F.col("_n1") >= least_first, 1).when(F.col("_n2") >= least_second, 2).otherwise(3)
    tiered = wanted.join(a, first, "left").join(b, second, "left").withColumn("tier", tier)
    pool = F.when(F.col("tier") == 1, F.concat(F.lit("1:"), first)).when(F.col("tier") == 2, F.concat(F.lit("2:"), second)).otherwise("3")
    return tiered.withColumn("pool", pool).drop("_n1", "_n2")


def pool_members(templates: DataFrame, first: str, second: str) -> DataFrame:
    """Templates by the pools that they are in: pool, template_id and score."""
    pools = F.array(F.concat(F.lit("1:"), first), F.concat(F.lit("2:"), second), F.when(F.col("is_core"), "3"))
    return templates.select("template_id", F.explode(F.array_compact(pools)).alias("pool"), "score")


def candidate_pool(templates: DataFrame, wanted: DataFrame, first: str, second: str, k: int, least_first: int = 12, least_second: int = 8) -> DataFrame:
    """The k best templates (by score, then id) of each wanted row's pool.

    A pool is ranked once, in hash buckets first, whatever number of rows want it.
    """
    order = (F.desc("score"), "template_id")
    members = pool_members(templates, first, second).withColumn("_b", F.pmod(F.xxhash64("template_id"), F.lit(64)))
    best = members.withColumn("_nth", F.row_number().over(Window.partitionBy("pool", "_b").orderBy(*order))).where(F.col("_nth") <= k)
    best = best.withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy(*order))).where(F.col("place") <= k).drop("_b", "_nth")
    return candidate_tiers(templates, wanted, first, second, least_first, least_second).join(best, "pool").drop("pool")


def contains_join(categories: DataFrame, templates: DataFrame) -> DataFrame:
    """For each category the best template: one whose signature text contains it, else one whose top category it is, else any; then by score and id.

    ``categories`` has distinct ones, and templates are kept by signature and
    top category first, so what is compared is categories with kinds of
    templates, never items with templates.
    """
    rank = F.struct((-F.col("score")).alias("minus_score"), F.col("template_id").alias("template_id"))
    kinds = templates.groupBy("signature", "top_category").agg(F.min(rank).alias("best"))
    tier = F.when(F.contains(F.col("signature"), F.col("category")), 1).when(F.col("top_category") == F.col("category"), 2).otherwise(3)
    near = categories.join(kinds, F.contains(F.col("signature"), F.col("category")) | (F.col("top_category") == F.col("category")))
    near = near.groupBy("category").agg(F.min(F.struct(tier.alias("tier"), F.col("best").alias("best"))).alias("x"))
    anything = kinds.agg(F.struct(F.lit(3).alias("tier"), F.min("best").alias("best")).alias("any"))
    found = categories.join(near, "category", "left").crossJoin(F.broadcast(anything)).withColumn("x", F.coalesce("x", "any"))
    return found.select("category", F.col("x.tier").alias("tier"), F.col("x.best.template_id").alias("template_id"))
