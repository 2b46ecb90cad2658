"""Evaluation of scores: every metric is an aggregate or a window over pre-aggregated scores.

Tables hold ``y`` (1, 0 or null) and ``p`` (a score from 0 to 1), and grouping
columns. Scans over thresholds work on one row for each distinct score, so
they never compare rows with rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.shared import staged


def ratio(a: Column, b: Column) -> Column:
    """A share that is 0 where there is nothing to share."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    recall, specificity, precision = ratio(tp, tp + fn), ratio(tn, tn + fp), ratio(tp, tp + fp)
    n = tp + fp + tn + fn
    return {
        "accuracy": ratio(tp + tn, n), "balanced_accuracy": (recall + specificity) / 2, "precision": precision, "recall": recall, "specificity": specificity,
        "f1": ratio(2 * tp, 2 * tp + fp + fn), "positive_rate_pred": ratio(tp + fp, n), "positive_rate_true": ratio(tp + fn, n),
    }


def counts(y: Column, hit: Column) -> dict[str, Column]:
    return {"tp": F.count_if((y == 1) & hit), "fp": F.count_if((y == 0) & hit), "tn": F.count_if((y == 0) & ~hit), "fn": F.count_if((y == 1) & ~hit)}


def with_rates(table: DataFrame, places: int = 6) -> DataFrame:
    r = rates(*(F.col(c) for c in ("tp", "fp", "tn", "fn")))
    return table.select("*", *(F.round(c, places).alias(k) for k, c in r.items()))


def confusion(df: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Confusion counts and rates at one threshold."""
    return with_rates(df.where("y is not null").groupBy(*keys).agg(*(c.alias(k) for k, c in counts(F.col("y"), F.col("p") >= threshold).items())))


def by_score(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each distinct score with its positives and negatives."""
    return df.where("y is not null and p is not null").groupBy(*keys, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum((1 - F.col("y")).cast("long")).alias("neg"))


def cumulated(s: DataFrame, keys: Sequence[str], columns: Sequence[str], down: bool, own: bool, buckets: int = 1024) -> DataFrame:
    """Running sums ``cum_`` over the scores of a group, from below or from above, with or without a score's own.

    Scores lie from 0 to 1, so they fall into a fixed number of buckets. Sums
    of buckets come first and go to the rows of a bucket, which are ranked among
    themselves; no task sees all scores of a group.
    """
    bucket = F.floor(F.least(F.greatest("p", F.lit(0.0)), F.lit(1.0)) * buckets).cast("int")
    s = s.withColumn("_b", bucket)
    order = (lambda c: F.desc(c)) if down else F.col
    sums = s.groupBy(*keys, "_b").agg(*(F.sum(c).alias(c) for c in columns))
    earlier = Window.partitionBy(*keys).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)  # at most a row for each bucket
    sums = sums.select(*keys, "_b", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_e_{c}") for c in columns))
    inside = Window.partitionBy(*keys, "_b").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    s = s.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_i_{c}") for c in columns)).join(sums, [*keys, "_b"])
    return s.select(*keys, "p", *columns, *((F.col(f"_e_{c}") + F.col(f"_i_{c}")).alias(f"cum_{c}") for c in columns))


def roc_auc(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mann-Whitney's statistic with half credit for ties; no row for a group of one class."""
    s = cumulated(by_score(df, keys), keys, ["neg", "pos"], down=False, own=False)
    total = s.groupBy(*keys).agg(F.sum(F.col("pos") * (F.col("cum_neg") + F.col("neg") / 2.0)).alias("u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.where("n_pos > 0 and n_neg > 0").select(*keys, (F.col("u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def average_precision(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the steps of precision over recall, from the highest score down."""
    s = cumulated(by_score(df, keys), keys, ["pos", "neg"], down=True, own=True)
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    return s.groupBy(*keys).agg((F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def brier_and_log_loss(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    y, p = F.col("y").cast("double"), F.col("p")
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return df.where("y is not null").groupBy(*keys).agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))


def bucket(p: Column, n: int) -> Column:
    """Right-closed bins; the first holds 0 too. Scores are rounded so that edges fall into their bins."""
    return F.greatest(F.lit(0), F.ceil(F.round(p * n, 9)) - 1).cast("int")


def reliability(df: DataFrame, n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Rows, mean score and event rate of each bin, empty bins included."""
    held = df.where("y is not null")
    spine = held.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    spine = spine.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    filled = held.groupBy(*keys, bucket(F.col("p"), n).alias("bin")).agg(F.count("*").alias("n_rows"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("event_rate"))
    return spine.join(filled, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "mean_p", "event_rate")


def calibration_error(df: DataFrame, n: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    return reliability(df, n, keys).groupBy(*keys).agg((F.sum(F.col("n_rows") * F.abs(F.col("mean_p") - F.col("event_rate"))) / F.sum("n_rows")).alias("ece"))


def calibration_compare(df: DataFrame, bins: int = 8) -> DataFrame:
    """Of each ``series`` of scores: the threshold that is best on val rows, and on test rows the error of calibration and the metrics at it."""
    val, test = df.where("split = 'val'"), df.where("split = 'test'")
    best = best_threshold(threshold_scan(val, ["series"]), ["series"]).select("series", "threshold")
    cells = test.where("y is not null").join(best, "series").groupBy("series", "threshold").agg(*(c.alias(k) for k, c in counts(F.col("y"), F.col("p") >= F.col("threshold")).items()))
    return with_rates(cells).join(calibration_error(test, bins, ["series"]), "series")


def fold_summary(metrics: DataFrame, fold: str, columns: Sequence[str], choose: str = "balanced_accuracy") -> DataFrame:
    """Of each fold the best ``model`` (ties by name); then each metric's mean, population spread, least and most over the folds, and how often each model was best."""
    w = Window.partitionBy(fold).orderBy(F.desc(choose), "model")
    best = metrics.withColumn("_nth", F.row_number().over(w)).where("_nth = 1")
    long = best.select(fold, *columns).unpivot(fold, list(columns), "name", "v")
    spread = long.groupBy(F.lit("metric").alias("kind"), "name").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("most"))
    chosen = best.groupBy(F.lit("chosen").alias("kind"), F.col("model").alias("name")).agg(F.count("*").alias("n"))
    return spread.unionByName(chosen, allowMissingColumns=True)


def threshold_scan(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Confusion counts and rates at 19 grid thresholds and at every observed score (4 places).

    Thresholds join the stream of scores and take running sums from above, so
    the cost is one sort of the distinct scores.
    """
    scores = df.where("y is not null").withColumn("p", F.round("p", 4))
    s = by_score(scores, keys)
    grid = scores.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.lit(round(0.05 * i, 2)) for i in range(1, 20)))).alias("p"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("neg"))
    s = s.unionByName(grid).groupBy(*keys, "p").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    down, whole = Window.partitionBy(*keys).orderBy(F.desc("p")), Window.partitionBy(*keys)
    s = s.withColumn("tp", F.sum("pos").over(down)).withColumn("fp", F.sum("neg").over(down)).withColumn("fn", F.sum("pos").over(whole) - F.col("tp")).withColumn("tn", F.sum("neg").over(whole) - F.col("fp"))
    return with_rates(s.drop("pos", "neg").withColumnRenamed("p", "threshold"))


def best_threshold(scan: DataFrame, keys: Sequence[str], metric: str = "balanced_accuracy") -> DataFrame:
    """The best row; ties go to the lowest threshold."""
    w = Window.partitionBy(*keys).orderBy(F.desc(metric), "threshold")
    return scan.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def macro_f1(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """F1 of each class over the union of true and predicted labels, averaged; a class never hit has 0."""
    cells = df.groupBy(truth, pred).agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("hit"), F.col("n").alias("true_n"), F.lit(0).cast("long").alias("pred_n")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("true_n"), F.col("n").alias("pred_n")))).alias("x")).select("x.*")
    per = long.groupBy("label").agg(F.sum("hit").alias("hit"), F.sum("true_n").alias("true_n"), F.sum("pred_n").alias("pred_n"))
    return per.agg(F.avg(2 * F.col("hit") / (F.col("true_n") + F.col("pred_n"))).alias("macro_f1"), (F.sum("hit") / F.sum("true_n")).alias("accuracy"))


def regression(df: DataFrame, y: str, pred: str) -> DataFrame:
    e = F.col(y) - F.col(pred)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.sum(e * e) / F.nullif(F.var_pop(y) * F.count(y), F.lit(0.0))).alias("r2"))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], cuts: int = 255, weight: str | None = None) -> DataFrame:
    """keys and ``q``, the exact quantiles (linear between neighbours) of each group, without one group's values in one task.

    Approximate quantiles cut a group into buckets. Counts of distinct values
    are summed by bucket, and running sums over the buckets tell where a rank
    lies; values are ranked inside their bucket only. A row counts ``weight``
    times (a column of whole numbers), or once.
    """
    times = F.col(weight) if weight else F.lit(1)
    held = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"), times.cast("long").alias("_w"))
    # Written once: rows are placed by them twice below, and a second sketch of the same values may cut elsewhere, as it depends on the order in which tasks end.
    edges = staged(held.groupBy(*keys).agg(F.sum("_w").alias("_n"), F.percentile_approx("v", [k / (cuts + 1) for k in range(1, cuts + 1)], 4 * cuts).alias("_edges")), "quantile-edges")
    seen = held.groupBy(*keys, "v").agg(F.sum("_w").alias("_c"))
    # One row for each group; its size grows with the groups, so Spark chooses how to join it.
    seen = (seen.join(edges, list(keys)) if keys else seen.crossJoin(F.broadcast(edges))).withColumn("_b", F.size(F.filter("_edges", lambda x: x < F.col("v")))).drop("_edges")
    sums = seen.groupBy(*keys, "_b").agg(F.sum("_c").alias("_s"))
    sums = sums.withColumn("_e", F.coalesce(F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    ranked = seen.withColumn("_i", F.sum("_c").over(Window.partitionBy(*keys, "_b").orderBy("v"))).join(sums, [*keys, "_b"]).withColumn("_hi", F.col("_e") + F.col("_i")).withColumn("_lo", F.col("_hi") - F.col("_c"))
    parts = []
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("_n") - 1)
        for name, rank in (("a", F.floor(at)), ("b", F.ceil(at))):
            parts.append(F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_hi")), F.col("v"))).alias(f"_{name}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *parts)
    fraction = [F.lit(s) * (F.col("_n") - 1) - F.floor(F.lit(s) * (F.col("_n") - 1)) for s in shares]
    return found.select(*keys, F.array(*(F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * f for i, f in enumerate(fraction))).alias("q"))


def last_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, id_: str, out: str) -> DataFrame:
    """The first ``n`` rows of each group in an order that breaks all ties, with their place; taken in hash buckets first, so a hot group is dealt out."""
    few = df.withColumn("_b", F.pmod(F.xxhash64(id_), F.lit(256)))
    few = few.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*order))).where(F.col(out) <= n)
    return few.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n).drop("_b")


def assign_ranges(rows: DataFrame, x: str, ranges: DataFrame, bins: int = 1024) -> DataFrame:
    """Rows with every range (lo <= x < hi) that holds them, and the ranges' other columns.

    The span of all ranges is cut into bins of one width; a range is copied to
    the bins that it covers, and rows meet the ranges of their bin only, by an
    equi-join. Empty ranges, nulls and rows outside all ranges give nothing.
    """
    ranges = ranges.where("lo < hi")
    span = F.broadcast(ranges.agg(F.min("lo").alias("_lo"), F.greatest((F.max("hi") - F.min("lo")) / float(bins), F.lit(1e-300)).alias("_width")))
    bin_of = lambda c: F.floor((c - F.col("_lo")) / F.col("_width")).cast("long")
    copied = ranges.crossJoin(span).withColumn("_bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi"))))).drop("_lo", "_width")
    placed = rows.crossJoin(span).withColumn("_bin", bin_of(F.col(x))).drop("_lo", "_width")
    return placed.join(copied, "_bin").where((F.col("lo") <= F.col(x)) & (F.col(x) < F.col("hi"))).drop("_bin")


def distribution(df: DataFrame, keys: Sequence[str], value: str = "p") -> DataFrame:
    """Rows, mean, spread, ends and exact quantiles of each group."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("least"), F.max(value).alias("most"))
    out = out.join(exact_quantiles(df, keys, value, (0.05, 0.5, 0.95)), list(keys), "left")
    return out.select(*keys, "n_rows", "mean", "std", "least", "most", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))
