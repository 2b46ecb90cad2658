"""Queries on evaluation: labels of documents against a score made from their length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import evaluation as E
from tideline.plans.registry import load, query

SCORED = "scored AS (SELECT doc_id, lang, source, n_chars, quality AS y, round((n_chars % 1000) / 1000.0, 3)::DOUBLE AS p, CASE WHEN doc_id % 5 = 0 THEN 'test' WHEN doc_id % 5 = 1 THEN 'val' ELSE 'train' END AS split, CAST(floor(doc_id / 100) AS BIGINT) AS fold FROM documents JOIN labels USING (doc_id))"
CONF = "CAST(count(*) FILTER (y = 1 AND p >= {t}) AS BIGINT) AS tp, CAST(count(*) FILTER (y = 0 AND p >= {t}) AS BIGINT) AS fp, CAST(count(*) FILTER (y = 0 AND p < {t}) AS BIGINT) AS tn, CAST(count(*) FILTER (y = 1 AND p < {t}) AS BIGINT) AS fn"
RATES = "round(CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn)::DOUBLE END, 6) AS accuracy, round((CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END + CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp)::DOUBLE END) / 2, 6) AS balanced_accuracy, round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp)::DOUBLE END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END, 6) AS recall, round(CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp)::DOUBLE END, 6) AS specificity, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 6) AS f1, round((tp + fp) / (tp + fp + tn + fn)::DOUBLE, 6) AS positive_rate_pred, round((tp + fn) / (tp + fp + tn + fn)::DOUBLE, 6) AS positive_rate_true"


def scored(spark, d) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id", "lang", "source", "n_chars").join(load(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    m = F.col("doc_id") % 5
    return docs.withColumn("p", F.round((F.col("n_chars") % 1000) / 1000.0, 3)).withColumn("split", F.when(m == 0, "test").when(m == 1, "val").otherwise("train")).withColumn("fold", F.floor(F.col("doc_id") / 100).cast("long"))


@query(f"WITH {SCORED}, c AS (SELECT split, {CONF.format(t=0.5)} FROM scored GROUP BY 1) SELECT split, tp, fp, tn, fn, {RATES} FROM c")
def e01_confusion(spark, d):
    return E.confusion(scored(spark, d), ["split"], 0.5)


@query(f"WITH {SCORED}, r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS r FROM scored) SELECT lang, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6)::DOUBLE AS auc FROM r GROUP BY 1 HAVING sum(y) > 0 AND sum(y) < count(*)")
def e03_roc_auc(spark, d):
    return E.roc_auc(scored(spark, d), ["lang"]).select("lang", F.round("auc", 6).alias("auc"))


@query(f"WITH {SCORED} SELECT split, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(least(greatest(p, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6)))), 6) AS log_loss FROM scored GROUP BY 1")
def e04_brier_log_loss(spark, d):
    return E.brier_and_log_loss(scored(spark, d), ["split"]).select("split", F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


@query(f"WITH {SCORED}, s AS (SELECT p, sum(y) AS pos, count(*) AS n FROM scored GROUP BY 1), c AS (SELECT pos, sum(pos) OVER w AS tp, sum(n) OVER w AS n FROM s WINDOW w AS (ORDER BY p DESC)) SELECT round(sum(pos * tp / n::DOUBLE) / sum(pos), 6)::DOUBLE AS average_precision FROM c")
def e05_average_precision(spark, d):
    return E.average_precision(scored(spark, d), []).select(F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {SCORED}, b AS (SELECT CAST(greatest(0, ceil(round(p * 10, 9)) - 1) AS INTEGER) AS bin, count(*) AS n_rows, avg(p) AS mp, avg(y) AS er FROM scored GROUP BY 1), s AS (SELECT CAST(range AS INTEGER) AS bin FROM range(10)), e AS (SELECT sum(n_rows * abs(mp - er)) / sum(n_rows) AS ece FROM b) SELECT bin, coalesce(n_rows, 0) AS n_rows, round(mp, 6) AS mean_p, round(er, 6) AS event_rate, round(ece, 6) AS ece FROM s LEFT JOIN b USING (bin), e")
def e06_reliability(spark, d):
    s = scored(spark, d)
    return E.reliability(s).crossJoin(F.broadcast(E.calibration_error(s))).select("bin", "n_rows", F.round("mean_p", 6).alias("mean_p"), F.round("event_rate", 6).alias("event_rate"), F.round("ece", 6).alias("ece"))


@query(f"WITH {SCORED}, t AS (SELECT DISTINCT threshold FROM (SELECT round(p, 4) AS threshold FROM scored UNION ALL SELECT round(0.05 * range, 2)::DOUBLE FROM range(1, 20))), c AS (SELECT threshold, {CONF.format(t='threshold')} FROM t, scored GROUP BY 1) SELECT threshold, tp, fp, tn, fn, {RATES} FROM c")
def e07_e08_threshold_scan(spark, d):
    return E.threshold_scan(scored(spark, d))


@query(f"WITH {SCORED}, t AS (SELECT DISTINCT lang, threshold FROM (SELECT lang, round(p, 4) AS threshold FROM scored UNION ALL SELECT lang, round(0.05 * range, 2)::DOUBLE FROM range(1, 20), (SELECT DISTINCT lang FROM scored))), c AS (SELECT t.lang, threshold, {CONF.format(t='threshold')} FROM t JOIN scored USING (lang) GROUP BY 1, 2), r AS (SELECT lang, threshold, {RATES} FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY balanced_accuracy DESC, threshold) AS i FROM r) SELECT lang, threshold, balanced_accuracy FROM k WHERE i = 1")
def e07_best_threshold(spark, d):
    return E.best_threshold(E.threshold_scan(scored(spark, d), ["lang"]), ["lang"]).select("lang", "threshold", "balanced_accuracy")


@query(f"WITH {SCORED} SELECT y, count(*) AS n_rows, round(avg(p), 6) AS mean, round(stddev_pop(p), 6) AS std, min(p) AS least, max(p) AS most, round(quantile_cont(p, 0.05), 6) AS q05, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.95), 6) AS q95 FROM scored GROUP BY 1")
def e09_prob_distribution(spark, d):
    out = E.distribution(scored(spark, d), ["y"])
    return out.select("y", "n_rows", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "std", "q05", "q50", "q95")))


@query(f"WITH {SCORED} SELECT CASE WHEN p < 0.1 THEN 'a' WHEN p < 0.3 THEN 'b' WHEN p < 0.6 THEN 'c' ELSE 'd' END AS bin, y, count(*) AS n FROM scored GROUP BY 1, 2")
def e10_histogram(spark, d):
    return scored(spark, d).groupBy(S.band(F.col("p"), [0.1, 0.3, 0.6], ["a", "b", "c", "d"], "left").alias("bin"), "y").agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT round(avg(abs(n_chars - 1500 * p)), 4) AS mae, round(sqrt(avg((n_chars - 1500 * p) * (n_chars - 1500 * p))), 4) AS rmse, round(1 - sum((n_chars - 1500 * p) * (n_chars - 1500 * p)) / (var_pop(n_chars) * count(*)), 6) AS r2 FROM scored")
def e12_regression_metrics(spark, d):
    out = E.regression(scored(spark, d).withColumn("pred", 1500 * F.col("p")), "n_chars", "pred")
    return out.select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"), F.round("r2", 6).alias("r2"))


@query(f"WITH {SCORED}, x AS (SELECT lang AS t, CASE WHEN n_chars % 3 = 0 THEN 'en' ELSE lang END AS q FROM scored), l AS (SELECT t AS label FROM x UNION SELECT q FROM x), f AS (SELECT label, 2.0 * (SELECT count(*) FROM x WHERE t = label AND q = label) / ((SELECT count(*) FROM x WHERE t = label) + (SELECT count(*) FROM x WHERE q = label)) AS f1 FROM l) SELECT round(avg(f1), 6)::DOUBLE AS macro_f1, (SELECT round(avg(CASE WHEN t = q THEN 1.0 ELSE 0.0 END), 6)::DOUBLE FROM x) AS accuracy FROM f")
def e02_macro_f1(spark, d):
    s = scored(spark, d).withColumn("pred", F.when(F.col("n_chars") % 3 == 0, "en").otherwise(F.col("lang")))
    return E.macro_f1(s, "lang", "pred").select(F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query("WITH s AS (SELECT c.conv_id, c.turn, length(c.text) AS score, c.role FROM conversations c), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, turn) AS k FROM s) SELECT round(avg(hit), 6)::DOUBLE AS top2_accuracy FROM (SELECT conv_id, max(CASE WHEN k <= 2 AND role = 'assistant' THEN 1.0 ELSE 0.0 END) AS hit FROM r GROUP BY 1)")
def e11_topk_accuracy(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn")
    r = load(spark, d, "conversations").withColumn("score", F.length("text")).withColumn("k", F.row_number().over(w))
    hits = r.groupBy("conv_id").agg(F.max(((F.col("k") <= 2) & (F.col("role") == "assistant")).cast("double")).alias("hit"))
    return hits.agg(F.round(F.avg("hit"), 6).alias("top2_accuracy"))


@query(f"WITH {SCORED}, t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), c AS (SELECT threshold, fold, {CONF.format(t='threshold')} FROM t, scored GROUP BY 1, 2), b AS (SELECT *, (CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn)::DOUBLE END + CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp)::DOUBLE END) / 2 AS ba FROM c), g AS (SELECT threshold, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fn) AS BIGINT) AS fn, count(*) AS n_folds, avg(ba) AS mean_ba, min(ba) AS min_ba, arg_max(ba, fold) AS latest_ba FROM b GROUP BY 1) SELECT threshold, n_folds, fp, fn, round(mean_ba, 6) AS mean_ba, round(min_ba, 6) AS min_ba, round(latest_ba, 6) AS latest_ba, round((tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2, 6) AS pooled_ba FROM g")
def e13_pooled_metrics(spark, d):
    """A24: folds are summed first, then rated; and summarised as they are."""
    t = F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("threshold")
    s = scored(spark, d).select("fold", "y", "p", t)
    c = s.groupBy("threshold", "fold").agg(*(x.alias(k) for k, x in E.counts(F.col("y"), F.col("p") >= F.col("threshold")).items()))
    c = c.withColumn("ba", E.rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")))["balanced_accuracy"])
    g = c.groupBy("threshold").agg(*(F.sum(x).alias(x) for x in ("tp", "fp", "tn", "fn")), F.count("*").alias("n_folds"), F.avg("ba").alias("mean_ba"), F.min("ba").alias("min_ba"), F.max_by("ba", "fold").alias("latest_ba"))
    pooled = E.rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")))["balanced_accuracy"]
    return g.select("threshold", "n_folds", "fp", "fn", *(F.round(x, 6).alias(x) for x in ("mean_ba", "min_ba", "latest_ba")), F.round(pooled, 6).alias("pooled_ba"))


@query(f"WITH {SCORED}, t AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS threshold), c AS (SELECT threshold, {CONF.format(t='threshold')} FROM t, scored GROUP BY 1), r AS (SELECT threshold, fp, fn, (tp / (tp + fn)::DOUBLE + tn / (tn + fp)::DOUBLE) / 2 AS ba FROM c) SELECT r.threshold, r.fp < l.fp AND r.fn <= l.fn AND r.ba > l.ba AS promoted, CAST(r.fp - l.fp AS BIGINT) AS fp_change, round(r.ba - l.ba, 6) AS ba_change FROM r, r l WHERE l.threshold = 0.5")
def e14_j20_promotion_rule(spark, d):
    """Candidates against the locked threshold, which is one row."""
    t = F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.7))).alias("threshold")
    c = scored(spark, d).select("y", "p", t).groupBy("threshold").agg(*(x.alias(k) for k, x in E.counts(F.col("y"), F.col("p") >= F.col("threshold")).items()))
    r = c.withColumn("ba", E.rates(*(F.col(x) for x in ("tp", "fp", "tn", "fn")))["balanced_accuracy"])
    locked = r.where("threshold = 0.5").select(F.col("fp").alias("lfp"), F.col("fn").alias("lfn"), F.col("ba").alias("lba"))
    return r.crossJoin(F.broadcast(locked)).select("threshold", ((F.col("fp") < F.col("lfp")) & (F.col("fn") <= F.col("lfn")) & (F.col("ba") > F.col("lba"))).alias("promoted"), (F.col("fp") - F.col("lfp")).alias("fp_change"), F.round(F.col("ba") - F.col("lba"), 6).alias("ba_change"))


@query(f"WITH {SCORED}, s AS (SELECT 'lang:' || lang AS segment, y, p FROM scored UNION ALL SELECT 'source:' || source, y, p FROM scored UNION ALL SELECT CASE WHEN n_chars > 1500 THEN 'long' ELSE 'short' END, y, p FROM scored), c AS (SELECT segment, {CONF.format(t=0.5)} FROM s GROUP BY 1 HAVING count(*) >= 5) SELECT segment, tp, fp, tn, fn, {RATES} FROM c")
def e15_a27_segment_errors(spark, d):
    s = scored(spark, d)
    parts = F.array(F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("source:"), "source"), F.when(F.col("n_chars") > 1500, "long").otherwise("short"))
    return E.confusion(s.select(F.explode(parts).alias("segment"), "y", "p"), ["segment"], 0.5).where("tp + fp + tn + fn >= 5")


@query(f"WITH {SCORED} SELECT doc_id, CASE WHEN y = 0 THEN 'fp' ELSE 'fn' END AS kind, round(abs(p - 0.5), 6) AS margin FROM scored WHERE (y = 1) <> (p >= 0.5)")
def e16_false_cases(spark, d):
    wrong = scored(spark, d).where((F.col("y") == 1) != (F.col("p") >= 0.5))
    return wrong.select("doc_id", F.when(F.col("y") == 0, "fp").otherwise("fn").alias("kind"), F.round(F.abs(F.col("p") - 0.5), 6).alias("margin"))


@query(f"WITH {SCORED}, h AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS k FROM scored), r AS (SELECT lang, avg(p) AS recent_mean, stddev_pop(p) AS recent_std, avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) AS recent_rate FROM h WHERE k <= 20 GROUP BY 1), t AS (SELECT lang, quantile_cont(p, 0.1) AS q10, quantile_cont(p, 0.9) AS q90 FROM h GROUP BY 1), l AS (SELECT lang, p FROM h WHERE k = 1) SELECT lang, l.p AS latest, round(recent_mean, 6) AS recent_mean, round(recent_std, 6) AS recent_std, round(recent_rate, 6)::DOUBLE AS recent_rate, l.p < q10 OR l.p > q90 AS latest_outside, CASE WHEN l.p < q10 OR l.p > q90 THEN 'watch' ELSE 'calm' END AS label FROM r JOIN t USING (lang) JOIN l USING (lang)")
def e18_e19_f24_watch_checks(spark, d):
    """The last rows of a group are taken in hash buckets first and its quantiles by bucket, as there are few groups."""
    s = scored(spark, d)
    last = E.last_of_group(s, ["lang"], [F.desc("doc_id")], 20, "doc_id", "k").groupBy("lang").agg(F.max(F.when(F.col("k") == 1, F.col("p"))).alias("latest"), F.avg("p").alias("recent_mean"), F.stddev_pop("p").alias("recent_std"), F.avg((F.col("p") >= 0.5).cast("double")).alias("recent_rate"))
    g = last.join(E.exact_quantiles(s, ["lang"], "p", [0.1, 0.9]), "lang")
    out = (F.col("latest") < F.col("q")[0]) | (F.col("latest") > F.col("q")[1])
    return g.select("lang", "latest", *(F.round(c, 6).alias(c) for c in ("recent_mean", "recent_std", "recent_rate")), out.alias("latest_outside"), F.when(out, "watch").otherwise("calm").alias("label"))


@query(f"WITH {SCORED}, c AS (SELECT split, (avg(CASE WHEN y = 1 THEN CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END END)) / 2 AS ba, avg(abs(p - y)) AS mae, stddev_pop(p) AS std FROM scored GROUP BY 1) SELECT split, round(ba - 0.25 * mae / nullif(std, 0), 6)::DOUBLE AS composite FROM c")
def e20_composite_score(spark, d):
    y, hit = F.col("y"), (F.col("p") >= 0.5).cast("double")
    c = scored(spark, d).groupBy("split").agg(((F.avg(F.when(y == 1, hit)) + F.avg(F.when(y == 0, 1 - hit))) / 2).alias("ba"), F.avg(F.abs(F.col("p") - y)).alias("mae"), F.stddev_pop("p").alias("std"))
    return c.select("split", F.round(F.col("ba") - 0.25 * F.col("mae") / F.nullif(F.col("std"), F.lit(0.0)), 6).alias("composite"))


@query(f"WITH {SCORED} SELECT doc_id, greatest(p, 1 - p) AS confidence, CASE WHEN y = 1 THEN p ELSE 1 - p END AS p_true, (p >= 0.5) = (y = 1) AS correct, CASE WHEN p < 0.25 THEN 'low' WHEN p < 0.5 THEN 'watch' ELSE 'high' END AS band, CASE WHEN p < 0.4 THEN 'clear' WHEN p < 0.5 THEN 'watch_low' WHEN p < 0.6 THEN 'watch_high' ELSE 'act' END AS policy FROM scored")
def e22_f23_confidence_and_bands(spark, d):
    p, y = F.col("p"), F.col("y")
    return scored(spark, d).select("doc_id", F.greatest(p, 1 - p).alias("confidence"), F.when(y == 1, p).otherwise(1 - p).alias("p_true"), ((p >= 0.5) == (y == 1)).alias("correct"), S.probability_band(p, 0.5).alias("band"), S.policy_band(p, 0.5, 0.4, 0.6).alias("policy"))


@query(f"WITH {SCORED}, u AS (SELECT doc_id, unnest(['p', 'y', 'n_chars']) AS metric, unnest([p, y, n_chars]) AS value FROM scored) SELECT metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM u GROUP BY 1")
def u07_unpivot_metrics(spark, d):
    long = scored(spark, d).select("doc_id", F.col("p").cast("double").alias("p"), F.col("y").cast("double").alias("y"), F.col("n_chars").cast("double").alias("n_chars")).unpivot("doc_id", ["p", "y", "n_chars"], "metric", "value")
    return long.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"))


@query(f"WITH {SCORED}, x AS (SELECT max(doc_id) + 1 AS top FROM scored), f AS (SELECT range AS fold_no, (range + 2) * top // 10 AS lo, (range + 3) * top // 10 AS mid, CASE WHEN range = 7 THEN top ELSE (range + 4) * top // 10 END AS hi FROM range(8), x) SELECT fold_no, CASE WHEN doc_id < lo THEN 'train' WHEN doc_id < mid THEN 'val' ELSE 'test' END AS role, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM scored, f WHERE doc_id < hi GROUP BY 1, 2")
def j17_l11_l13_fold_ranges(spark, d):
    """Eight expanding folds over tenths of all ids, as ranges by role that rows meet in bins."""
    s = scored(spark, d)
    tenth = lambda n: F.floor((F.col("id") + n) * F.col("top") / 10)
    folds = spark.range(8).crossJoin(F.broadcast(s.agg((F.max("doc_id") + 1).alias("top")))).select(F.col("id").alias("fold_no"), tenth(2).alias("a"), tenth(3).alias("b"), F.when(F.col("id") == 7, F.col("top")).otherwise(tenth(4)).alias("c"))
    roles = F.inline(F.array(*(F.struct(F.lit(r).alias("role"), lo.cast("long").alias("lo"), hi.cast("long").alias("hi")) for r, lo, hi in (("train", F.lit(0), F.col("a")), ("val", F.col("a"), F.col("b")), ("test", F.col("b"), F.col("c"))))))
    return E.assign_ranges(s, "doc_id", folds.select("fold_no", roles)).groupBy("fold_no", "role").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("positives"))


@query(f"""WITH {SCORED}, m AS (SELECT unnest(['plain', 'steep', 'flat']) AS model, unnest([1.0, 2.0, 0.5])::DOUBLE AS power), c AS (SELECT fold, model, {CONF.format(t='0.5').replace('p >=', 'power(p, power) >=').replace('p <', 'power(p, power) <')} FROM scored, m GROUP BY 1, 2), r AS (SELECT fold, model, {RATES} FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY balanced_accuracy DESC, model) AS i FROM r), b AS (SELECT * FROM k WHERE i = 1),
 u AS (SELECT unnest(['accuracy', 'balanced_accuracy', 'f1']) AS name, unnest([accuracy, balanced_accuracy, f1]) AS v FROM b) SELECT 'metric' AS kind, name, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS least, max(v) AS most FROM u GROUP BY 1, 2 UNION ALL SELECT 'chosen', model, count(*), NULL, NULL, NULL, NULL FROM b GROUP BY 1, 2""")
def a24_fold_summary(spark, d):
    """The best of three models in each fold, and how their metrics and choices spread over the folds."""
    models = F.inline(F.array(*(F.struct(F.lit(n).alias("model"), F.lit(x).alias("power")) for n, x in (("plain", 1.0), ("steep", 2.0), ("flat", 0.5)))))
    rows = scored(spark, d).select("fold", "y", "p", models).withColumn("p", F.pow("p", "power"))
    return E.fold_summary(E.confusion(rows, ["fold", "model"], 0.5), "fold", ["accuracy", "balanced_accuracy", "f1"])


SERIES = "z AS (SELECT split, y, unnest(['raw', 'squared', 'shrunk']) AS series, unnest([p, p * p, 0.25 + p / 2])::DOUBLE AS q FROM scored)"


@query(f"""WITH {SCORED}, {SERIES}, t AS (SELECT DISTINCT series, threshold FROM (SELECT series, round(q, 4) AS threshold FROM z WHERE split = 'val' UNION ALL SELECT series, round(0.05 * range, 2)::DOUBLE FROM range(1, 20), (SELECT DISTINCT series FROM z WHERE split = 'val'))),
 v AS (SELECT t.series, threshold, {CONF.format(t='threshold')} FROM t JOIN (SELECT series, y, round(q, 4) AS p FROM z WHERE split = 'val') USING (series) GROUP BY 1, 2), r AS (SELECT series, threshold, {RATES} FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY balanced_accuracy DESC, threshold) AS i FROM r), b AS (SELECT series, threshold FROM k WHERE i = 1),
 e AS (SELECT series, CAST(greatest(0, ceil(round(q * 8, 9)) - 1) AS INTEGER) AS bin, count(*) AS n, avg(q) AS mq, avg(y) AS rate FROM z WHERE split = 'test' GROUP BY 1, 2), ec AS (SELECT series, sum(n * abs(mq - rate)) / sum(n) AS ece FROM e GROUP BY 1),
 c AS (SELECT series, threshold, {CONF.format(t='threshold').replace('p >=', 'q >=').replace('p <', 'q <')} FROM z JOIN b USING (series) WHERE split = 'test' GROUP BY 1, 2) SELECT series, threshold, round(ece, 6)::DOUBLE AS ece, tp, fp, tn, fn, {RATES} FROM c JOIN ec USING (series)""")
def e17_calibration_compare(spark, d):
    """Series of scores for the same rows: error of calibration on test rows, and metrics there at the threshold that is best on val rows."""
    p = F.col("p")
    series = F.inline(F.array(*(F.struct(F.lit(n).alias("series"), x.alias("q")) for n, x in (("raw", p), ("squared", p * p), ("shrunk", 0.25 + p / 2)))))
    out = E.calibration_compare(scored(spark, d).select("split", "y", "p", series).drop("p").withColumnRenamed("q", "p"))
    return out.withColumn("ece", F.round("ece", 6))


@query(f"WITH {SCORED}, a AS (SELECT doc_id, split, p AS p_a FROM scored WHERE lang <> 'de'), b AS (SELECT doc_id, split, 1 - p AS p_b FROM scored WHERE lang <> 'fr') SELECT doc_id, split, p_a, p_b FROM a FULL JOIN b USING (doc_id, split)")
def j19_merge_predictions(spark, d):
    s = scored(spark, d)
    a = s.where("lang <> 'de'").select("doc_id", "split", F.col("p").alias("p_a"))
    return a.join(s.where("lang <> 'fr'").select("doc_id", "split", (1 - F.col("p")).alias("p_b")), ["doc_id", "split"], "outer")


@query(f"WITH {SCORED}, k AS (SELECT source, doc_id, p, row_number() OVER (PARTITION BY source, y ORDER BY p DESC, doc_id) AS i, count(*) OVER (PARTITION BY source, y) AS n FROM scored) SELECT source, doc_id, n > 1 AS overlaps FROM k WHERE i = 1")
def u10_overlapping_predictions(spark, d):
    best = F.max_by(F.struct("doc_id"), F.struct("p", (-F.col("doc_id")).alias("first"))).alias("best")
    return scored(spark, d).groupBy("source", "y").agg(best, F.count("*").alias("n")).select("source", "best.doc_id", (F.col("n") > 1).alias("overlaps"))


@query(f"WITH {SCORED} SELECT split, count(*) AS n, round(avg(y), 6) AS event_rate, round(avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate_at_half, round(avg(CASE WHEN p >= 0.3 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS rate_at_threshold FROM scored GROUP BY 1")
def e21_diagnostics(spark, d):
    rate = lambda t: F.round(F.avg((F.col("p") >= t).cast("double")), 6)
    return scored(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("event_rate"), rate(0.5).alias("rate_at_half"), rate(0.3).alias("rate_at_threshold"))


@query("WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), o AS (SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS back FROM d), f AS (SELECT range AS fold FROM range(3)) SELECT fold, day, CASE WHEN back < fold * 4 + 2 THEN 'test' WHEN back < fold * 4 + 5 THEN 'val' ELSE 'train' END AS role FROM o, f WHERE back >= fold * 4")
def l12_walk_forward_dates(spark, d):
    """The last folds by unique dates, backwards: two days of test, three of validation, and all before to train."""
    days = load(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    back = F.row_number().over(Window.orderBy(F.desc("day"))) - 1  # unique dates are few
    folds = F.broadcast(spark.range(3).withColumnRenamed("id", "fold"))
    role = F.when(F.col("back") < F.col("fold") * 4 + 2, "test").when(F.col("back") < F.col("fold") * 4 + 5, "val").otherwise("train")
    return days.withColumn("back", back).join(folds, F.col("back") >= F.col("fold") * 4).select("fold", "day", role.alias("role"))


@query(f"WITH {SCORED}, c AS (SELECT lang, (avg(CASE WHEN y = 1 THEN CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN p < 0.5 THEN 1.0 ELSE 0.0 END END)) / 2 AS ba, count(DISTINCT y) AS k FROM scored GROUP BY 1) SELECT lang, CASE WHEN k < 2 THEN 'single_class' WHEN ba > 0.98 THEN 'near_perfect' WHEN ba < 0.5 THEN 'below_majority' ELSE 'plain' END AS flag FROM c")
def l19_proxy_flags(spark, d):
    y, hit = F.col("y"), (F.col("p") >= 0.5).cast("double")
    c = scored(spark, d).groupBy("lang").agg(((F.avg(F.when(y == 1, hit)) + F.avg(F.when(y == 0, 1 - hit))) / 2).alias("ba"), F.count_distinct("y").alias("k"))
    return c.select("lang", F.when(F.col("k") < 2, "single_class").when(F.col("ba") > 0.98, "near_perfect").when(F.col("ba") < 0.5, "below_majority").otherwise("plain").alias("flag"))


@query(f"WITH {SCORED} SELECT s.doc_id, s.p, d.n_chars FROM scored s JOIN documents d USING (doc_id)")
def j18_align_by_id(spark, d):
    """Predictions put beside their documents; an id without a document is an error."""
    s, docs = scored(spark, d).select("doc_id", "p"), load(spark, d, "documents").select("doc_id", "n_chars")
    sure = F.assert_true(F.col("n_chars").isNotNull(), F.lit("a prediction has no document"))
    return s.join(docs, "doc_id", "left").withColumn("ok", sure).where("ok is null").select("doc_id", "p", "n_chars")
