"""Queries on similarity and models: embeddings, and documents with a quality label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import evaluation as E
from tideline.operators import models as M
from tideline.operators import roles as R
from tideline.operators import similarity as V
from tideline.plans.registry import load, query
from tideline.sources.shared import staged

NUMBERS = ["n_chars", "n_words", "n_lines", "symbol_rate", "upper_rate"]
KNN = "q AS (SELECT * FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT q.vec_id AS source_id, e.vec_id AS neighbor_id, q.label AS own, e.label AS other, list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]) * list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS similarity FROM q JOIN embeddings e ON e.vec_id <> q.vec_id), k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY round(similarity, 12) DESC, neighbor_id) AS neighbor_rank FROM s)"


def neighbors(spark, d) -> DataFrame:
    e = load(spark, d, "embeddings")
    return V.cosine_knn(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", 5)


@query(f"WITH {KNN} SELECT source_id, neighbor_rank, neighbor_id, round(similarity, 6) AS similarity FROM k WHERE neighbor_rank <= 5")
def l03_cosine_knn(spark, d):
    """The stated queries (ids divisible by 50) against all rows."""
    return neighbors(spark, d).select("source_id", "neighbor_rank", "neighbor_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {KNN.replace(' WHERE vec_id % 50 = 0', '')} SELECT source_id, round(avg(CASE WHEN own = other THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS purity, round(abs(any_value(own) - avg(other)), 6) AS gap FROM k WHERE neighbor_rank <= 5 GROUP BY 1")
def l05_l06_neighbor_purity_and_gap(spark, d):
    """Of every row, what its neighbours' labels say about its own."""
    e = load(spark, d, "embeddings")
    n = staged(V.cosine_knn_all(e, "vec_id", "embedding", 5), "neighbors")  # purity and gap both read it
    e = e.select("vec_id", "label")
    both = V.neighbor_purity(n, e, "vec_id", "label").join(V.neighbor_gap(n, e, "vec_id", "label"), "source_id")
    return both.select("source_id", F.round("purity", 6).alias("purity"), F.round("gap", 6).alias("gap"))


@query()
def l02_l04_svd_space(spark, d):
    """Neighbours in the space of the eight first singular vectors; its axes have no SQL, so tests hold it against NumPy."""
    e = load(spark, d, "embeddings")
    space = V.svd_embed(e, "vec_id", "embedding", 8)
    return V.cosine_knn(space.where("vec_id % 50 = 0"), space, "vec_id", "coordinates", 5).select("source_id", "neighbor_rank", "neighbor_id", F.round("similarity", 6).alias("similarity"))


def labelled(spark, d) -> DataFrame:
    docs = load(spark, d, "documents").join(load(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    rates = {"symbol_rate": r"[^\p{L}\p{N}\s]", "upper_rate": r"\p{Lu}"}
    share = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    numbers = docs.select(
        F.col("doc_id").alias("id"), "lang", F.col("quality").cast("double").alias("label"), F.when(share < 7, "train").when(share < 8, "val").otherwise("test").alias("split"),
        F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", r"\s+")).cast("double").alias("n_words"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"), *(((F.length("text") - F.length(F.regexp_replace("text", p, ""))) / n).alias(k) for k, p in rates.items()),
    )
    return staged(numbers, "labelled")  # every fit and every prediction reads it


@query("WITH c AS (SELECT quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1) SELECT label::DOUBLE AS label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6)::DOUBLE AS weight FROM c")
def l09_class_weights(spark, d):
    labels = load(spark, d, "labels").join(load(spark, d, "documents").select("doc_id"), "doc_id").select(F.col("quality").cast("double").alias("label"))
    return M.class_weights(labels).groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("weight"), 6).alias("weight"))


@query()
def l01_l07_l10_compare_and_select(spark, d):
    return M.fit_compare_select(labelled(spark, d), NUMBERS, ["lang"])[0].select("model", "split", "balanced_accuracy", "f1", "precision", "recall")


@query()
def l14_l20_calibrated_history(spark, d):
    """Scores of all labelled documents: raw, Platt's, isotonic."""
    df = labelled(spark, d)
    model = M.fit_compare_select(df, NUMBERS, ["lang"])[2]
    return M.calibrate(M.predict(model, df)).select("id", "split", "y", "p", "platt", "isotonic")


@query()
def l14_e17_calibration_compare(spark, d):
    """Raw, Platt's and isotonic scores against each other on test rows; e17_calibration_compare holds the comparison against SQL."""
    scores = l14_l20_calibrated_history(spark, d)
    series = F.inline(F.array(*(F.struct(F.lit(n).alias("series"), F.col(c).alias("q")) for n, c in (("raw", "p"), ("platt", "platt"), ("isotonic", "isotonic")))))
    return E.calibration_compare(scores.select("split", "y", series).withColumnRenamed("q", "p").where("p is not null"))


@query()
def l15_l16_drivers(spark, d):
    df = labelled(spark, d)
    model = M.fit_compare_select(df, NUMBERS, ["lang"])[2]
    drivers = M.feature_drivers(model, df).select(F.lit("importance").alias("kind"), "feature", F.col("importance").alias("value"))
    dropped = M.permutation_importance(model, df.where("split = 'test'"), NUMBERS)
    parts = F.inline(F.array(F.struct(F.lit("permutation").alias("kind"), F.col("drop").alias("value")), F.struct(F.lit("permutation_spread").alias("kind"), F.col("spread").alias("value"))))
    return drivers.unionByName(dropped.select("feature", parts).select("kind", "feature", "value"))


@query()
def l17_ablation(spark, d):
    groups = R.group_features(NUMBERS, {"size": ["n_"], "shape": ["rate"]})
    return M.ablation(labelled(spark, d), R.ablation_sets(groups))


@query()
def l11_rolling_backtest(spark, d):
    df = labelled(spark, d)
    top = df.agg(F.max("id")).first()[0] or 0
    folds = [(top * x, top * (x + 0.1), top * (x + 0.3)) for x in (0.3, 0.5, 0.7)]
    return M.rolling_backtest(df, "id", folds, NUMBERS)


@query()
def l18_seed_robustness(spark, d):
    return M.seed_robustness(labelled(spark, d), NUMBERS, [1, 2, 3])


@query()
def l08_regressors(spark, d):
    """Ridge and forest on a document's length, with the mean as the floor: error on test rows."""
    return M.compare_regressors(labelled(spark, d).withColumn("label", F.col("n_words")), ["n_lines", "symbol_rate", "upper_rate"])


@query()
def l08_l10_select_regressor(spark, d):
    """The regressor that is best on val by mean absolute error, then R2, on test rows beside the mean."""
    return M.fit_select_regressor(labelled(spark, d).withColumn("label", F.col("n_words")), ["n_lines", "symbol_rate", "upper_rate"])[0]
