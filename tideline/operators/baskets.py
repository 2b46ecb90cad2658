"""Baskets and their lines: rollups, signatures, modes, profiles, co-occurrence, order within a basket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.shared import staged


def ordered_join(values: Column, order: Sequence[Column], separator: str = " + ", most: int | None = None) -> Column:
    """An aggregate: texts in the given order, joined; at most the first ``most`` where that is the feature."""
    held = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), values.alias("v"))))
    held = held if most is None else F.slice(held, 1, most)
    return F.array_join(F.transform(held, lambda x: x["v"]), separator)


def weighted_mode(df: DataFrame, keys: Sequence[str], value: str, weight: str, out: str, exclude: Sequence[str] = ()) -> DataFrame:
    """The value of the largest total weight in each group; excluded ones count only where there is no other.

    Weights are summed by key and value first, so a hot group is pre-aggregated.
    Ties go to the value that comes first.
    """
    sums = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    rank = F.struct((~F.col(value).isin(*exclude) if exclude else F.lit(True)).alias("usable"), F.round("_w", 6).alias("w"))
    best = Window.partitionBy(*keys).orderBy(rank.desc(), F.col(value))
    return sums.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").select(*keys, F.col(value).alias(out))


def mode(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The most frequent value, ties by value."""
    return weighted_mode(df.withColumn("_one", F.lit(1)), keys, value, "_one", out)


def top_values(df: DataFrame, keys: Sequence[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group with their counts and places."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).where(F.col("place") <= n)


def cooccurrence(lines: DataFrame, basket: str, item: str) -> DataFrame:
    """How many baskets hold both of two items (a before b). Baskets are small by nature; items are distinct in each."""
    held = lines.select(basket, item).distinct()
    pairs = held.select(basket, F.col(item).alias("a")).join(held.select(basket, F.col(item).alias("b")), basket).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n_baskets"))


def running(total: Column, w: Window) -> dict[str, Column]:
    """Totals before and after each row, and the whole of its partition's order up to the end."""
    before = F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return {"before": before, "after": F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0))}


def collapse_rare(df: DataFrame, column: str, least: int, out: str, other: str = "OTHER") -> DataFrame:
    """Labels with fewer rows than asked become OTHER; counts are joined, not windowed, so a hot label doesn't meet in one task."""
    counts = df.groupBy(column).agg(F.count("*").alias("_n"))
    return df.join(counts, column, "left").withColumn(out, F.when(F.col(column).isNull(), None).when(F.col("_n") >= least, F.col(column)).otherwise(other)).drop("_n")


def checked_join(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that fails where the dimension has a key twice."""
    unique = dim.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.first(c).alias(c) for c in dim.columns if c not in keys))
    sure = unique.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("the dimension's keys are not unique")))
    return df.join(sure.where(F.col("_ok").isNull()).drop("_n", "_ok"), list(keys), "left")


def two_stage_join(df: DataFrame, dim: DataFrame, strict: Sequence[str], loose: Sequence[str], value: str, order: str) -> DataFrame:
    """A value by the strict keys, else by fewer keys from the dimension's first row of these."""
    near = dim.groupBy(*loose).agg(F.min_by(value, order).alias("_loose"))
    exact = dim.groupBy(*strict).agg(F.min_by(value, order).alias("_strict"))
    return df.join(exact, list(strict), "left").join(near, list(loose), "left").withColumn(value, F.coalesce("_strict", "_loose")).withColumn("stage", F.when(F.col("_strict").isNotNull(), "strict").when(F.col("_loose").isNotNull(), "loose")).drop("_strict", "_loose")


def overlay(base: DataFrame, review: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Review values win where they are there. ``review`` has one row for each key."""
    renamed = review.select(key, *(F.col(c).alias(f"_r_{c}") for c in columns))
    out = base.join(renamed, key, "left")
    return out.select(*(F.coalesce(f"_r_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def batches(df: DataFrame, size: int, *order: Column) -> DataFrame:
    """Priority-ordered batches of a size. Places come from counts by range partition, so no task sorts all rows.

    The dealt table is written once, since ranges are sampled anew each time.
    """
    parted = staged(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = parted.withColumn("_nth", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = inside.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return inside.join(before.select("_part", "_before"), "_part").withColumn("batch", F.floor((F.col("_before") + F.col("_nth") - 1) / size).cast("long")).drop("_part", "_nth", "_before")
