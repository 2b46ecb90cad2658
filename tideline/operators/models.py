"""Models on Spark ML: features, fits, choice by validation, calibration, drivers and forward tests.

Frames hold ``label`` (double), numeric and categorical columns, and a column
that tells the split. Metrics are tables from ``evaluation``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import evaluation as E


def at_once(spark: SparkSession, tasks: Sequence[Callable], most: int = 8) -> list:
    """What the tasks give, run side by side from driver threads: their jobs are small, so one after another they would leave executors idle."""
    if not tasks:
        return []
    with ThreadPool(min(most, len(tasks))) as pool:
        return pool.map(lambda f: inheritable_thread_target(spark)(f)(), tasks)


def rating(metrics) -> tuple[float, ...]:
    """By which kinds are chosen, of a row of a confusion table: macro F1, then balanced accuracy, then accuracy. No row rates lowest."""
    if not metrics:
        return (-1.0,) * 3
    wrong = metrics["fp"] + metrics["fn"]
    of_class = [2 * n / (2 * n + wrong) if n else 0.0 for n in (metrics["tp"], metrics["tn"])]
    return sum(of_class) / 2, metrics["balanced_accuracy"], metrics["accuracy"]


def feature_stages(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Median imputing and scaling of numbers; modes are left to a category of their own, unseen ones too."""
    filled = [f"{c}__filled" for c in numeric]
    stages = [Imputer(strategy="median", inputCols=list(numeric), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="numbers", handleInvalid="keep"), StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True)]
    parts = ["scaled"]
    if categorical:
        indexed, hot = [f"{c}__index" for c in categorical], [f"{c}__hot" for c in categorical]
        stages += [StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep"), OneHotEncoder(inputCols=indexed, outputCols=hot, handleInvalid="keep")]
        parts += hot
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")]


def classifiers(seed: int = 7) -> dict:
    return {
        "logistic": LogisticRegression(weightCol="weight", regParam=0.01, maxIter=40),
        "forest": RandomForestClassifier(weightCol="weight", numTrees=20, maxDepth=5, seed=seed),
        "boosted": GBTClassifier(weightCol="weight", maxIter=10, maxDepth=3, seed=seed),
    }


def regressors(seed: int = 7) -> dict:
    return {"ridge": LinearRegression(regParam=0.1, elasticNetParam=0.0), "forest": RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed)}


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows weighed by n / (classes x rows of their class)."""
    c = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = c.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    w = c.crossJoin(F.broadcast(total)).select(label, (F.col("_all") / (F.col("_classes") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(w), label)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with y (int) and p."""
    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).withColumn("y", F.col("label").cast("int"))


def fit_compare_select(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], split: str = "split") -> tuple[DataFrame, str, PipelineModel]:
    """Fit all kinds on train, choose on val by macro F1, then balanced accuracy, then accuracy, refit on both, and test once.

    Gives the metrics of every kind (and of the majority) by split, the chosen
    kind, and its model. Features are fitted once and kinds side by side; a tie
    in all three goes to the first kind.
    """
    spark = df.sparkSession
    stages = feature_stages(numeric, categorical)
    train = class_weights(df.where(F.col(split) == "train"))
    share = train.agg(F.avg("label")).first()[0] or 0.0
    plain = df.withColumn("p", F.lit(float(share >= 0.5))).withColumn("y", F.col("label").cast("int"))
    tables = {"majority": E.confusion(plain, [split], 0.5)}
    features = Pipeline(stages=stages).fit(train)
    prepared, ready = features.transform(train), features.transform(df)

    def rated(name: str, kind) -> tuple[str, DataFrame, tuple]:
        metrics = E.confusion(predict(kind.fit(prepared), ready), [split], 0.5)
        return name, metrics, rating(metrics.where(F.col(split) == "val").first())

    best = ("majority", rating(tables["majority"].where(F.col(split) == "val").first()))
    for name, metrics, found in at_once(spark, [lambda n=n, k=k: rated(n, k) for n, k in classifiers().items()]):
        tables[name] = metrics
        if best[0] == "majority" or found > best[1]:
            best = (name, found)
    name = best[0]
    both = class_weights(df.where(F.col(split) != "test"))
    model = Pipeline(stages=[*stages, classifiers()[name]]).fit(both)
    tables[f"chosen:{name}"] = E.confusion(predict(model, df.where(F.col(split) == "test")), [split], 0.5)
    out = None
    for key, table in tables.items():
        table = table.withColumn("model", F.lit(key))
        out = table if out is None else out.unionByName(table)
    return out, name, model


def fit_select_regressor(df: DataFrame, numeric: Sequence[str], split: str = "split") -> tuple[DataFrame, str]:
    """Fit all regressors on train, choose on val by mean absolute error and then by R2, refit on both, and test once; ``mean`` is the floor."""
    stages = feature_stages(numeric)
    train, val, both, test = (df.where(c) for c in (F.col(split) == "train", F.col(split) == "val", F.col(split) != "test", F.col(split) == "test"))

    def rated(name: str, kind) -> tuple:
        row = E.regression(Pipeline(stages=[*stages, kind]).fit(train).transform(val), "label", "prediction").first()
        return (row["mae"] if row["mae"] is not None else float("inf"), -(row["r2"] or 0.0)), name

    name = min(at_once(df.sparkSession, [lambda n=n, k=k: rated(n, k) for n, k in regressors().items()]))[1]
    mean = both.agg(F.avg("label")).first()[0] or 0.0
    floor = E.regression(test.withColumn("prediction", F.lit(float(mean))), "label", "prediction").withColumn("model", F.lit("mean"))
    chosen = E.regression(Pipeline(stages=[*stages, regressors()[name]]).fit(both).transform(test), "label", "prediction")
    return floor.unionByName(chosen.withColumn("model", F.lit(f"chosen:{name}"))), name


def calibrate(scored: DataFrame, split: str = "split") -> DataFrame:
    """Rows with raw, Platt's and isotonic scores, both fitted on val; null where val has one class."""
    val = scored.where(F.col(split) == "val").select(F.col("y").cast("double").alias("label"), "p")
    if val.select("label").distinct().count() < 2:
        return scored.withColumn("platt", F.lit(None).cast("double")).withColumn("isotonic", F.lit(None).cast("double"))
    platt = Pipeline(stages=[VectorAssembler(inputCols=["p"], outputCol="_x"), LogisticRegression(featuresCol="_x", probabilityCol="_prob", rawPredictionCol="_raw", predictionCol="_pred")]).fit(val)
    iso = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="isotonic").fit(val)
    out = platt.transform(scored).withColumn("platt", vector_to_array("_prob")[1]).drop("_x", "_prob", "_raw", "_pred")
    return iso.transform(out)


def feature_drivers(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Importances, or absolute coefficients, by feature name."""
    fitted = model.stages[-1]
    values = fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else abs(fitted.coefficients.toArray())
    attributes = model.transform(df.limit(0)).schema["features"].metadata.get("ml_attr", {}).get("attrs", {})
    names = {a["idx"]: a.get("name", f"feature_{a['idx']}") for part in attributes.values() for a in part}
    return df.sparkSession.createDataFrame([(names.get(i, f"feature_{i}"), float(v)) for i, v in enumerate(values)], "feature string, importance double")


def shuffled_copies(df: DataFrame, columns: Sequence[str], repeats: int, seed: int = 7, bucket_rows: int = 4_000) -> DataFrame:
    """The rows once for each column and repeat, with that column's values dealt anew among the rows of a hash bucket of the id.

    One pass: a task holds a bucket, whose size does not grow with the table.
    Adds ``feature`` and ``repeat``. The order of a bucket is that of the ids.
    """
    buckets = max(1, df.count() // bucket_rows)
    schema = T.StructType([*df.schema.fields, T.StructField("feature", T.StringType()), T.StructField("repeat", T.IntegerType())])

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["_b"].iloc[0])
        part = part.drop(columns="_b").sort_values("id")
        out = []
        for i, c in enumerate(columns):
            for r in range(repeats):
                order = np.random.default_rng([seed, number, i, r]).permutation(len(part))
                out.append(part.assign(**{c: part[c].to_numpy()[order], "feature": c, "repeat": r}))
        return pd.concat(out)

    return df.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(buckets))).groupBy("_b").applyInPandas(deal, schema)


def permutation_importance(model: PipelineModel, df: DataFrame, columns: Sequence[str], repeats: int = 5, seed: int = 7) -> DataFrame:
    """feature, drop and spread: how much balanced accuracy falls when a column is shuffled, mean and deviation over the repeats.

    All columns and repeats are dealt and scored in one pass.
    """
    base = E.confusion(predict(model, df), [], 0.5).select(F.col("balanced_accuracy").alias("base"))
    scored = E.confusion(predict(model, shuffled_copies(df, columns, repeats, seed)), ["feature", "repeat"], 0.5)
    fall = F.col("base") - F.col("balanced_accuracy")
    return scored.crossJoin(F.broadcast(base)).groupBy("feature").agg(F.avg(fall).alias("drop"), F.stddev_pop(fall).alias("spread"))


def ablation(df: DataFrame, sets: Mapping[str, Sequence[str]], split: str = "split") -> DataFrame:
    """Balanced accuracy on test of a logistic model for each set of columns."""
    train, test, out = class_weights(df.where(F.col(split) != "test")), df.where(F.col(split) == "test"), None
    for name, columns in sets.items():
        if columns:
            model = Pipeline(stages=[*feature_stages(columns), classifiers()["logistic"]]).fit(train)
            t = E.confusion(predict(model, test), [], 0.5).select(F.lit(name).alias("columns"), "balanced_accuracy")
            out = t if out is None else out.unionByName(t)
    return out


def rolling_backtest(df: DataFrame, order: str, folds: Sequence[tuple[float, float, float]], numeric: Sequence[str], kinds: Sequence[str] = ("logistic", "forest")) -> DataFrame:
    """For each fold of (train end, val end, test end) on the order column, the test metrics of the kind that is best on val.

    Kinds are fitted on what lies before the train end and chosen up to the val
    end as in fit_compare_select (a tie goes to the first); the chosen one is
    fitted again on all before the val end. Folds, and the kinds of a fold, run
    side by side, and a fold's kinds share its features.
    """
    spark, x = df.sparkSession, F.col(order)
    stages = feature_stages(numeric)

    def run(number: int, a: float, b: float, c: float) -> DataFrame:
        first, val, both = class_weights(df.where(x < a)), df.where((x >= a) & (x < b)), class_weights(df.where(x < b))
        features = Pipeline(stages=stages).fit(first)
        prepared, ready = features.transform(first), features.transform(val)
        rated = at_once(spark, [lambda n=n: rating(E.confusion(predict(classifiers()[n].fit(prepared), ready), [], 0.5).first()) for n in kinds])
        best = kinds[max(range(len(kinds)), key=lambda i: (rated[i], -i))]
        model = Pipeline(stages=[*stages, classifiers()[best]]).fit(both)
        return E.confusion(predict(model, df.where((x >= b) & (x < c))), [], 0.5).withColumn("fold", F.lit(number)).withColumn("model", F.lit(best))

    out = None
    for t in at_once(spark, [lambda f=f: run(*f) for f in [(n, *fold) for n, fold in enumerate(folds)]]):
        out = t if out is None else out.unionByName(t)
    return out


def seed_robustness(df: DataFrame, numeric: Sequence[str], seeds: Sequence[int], split: str = "split") -> DataFrame:
    """Balanced accuracy on test of a forest over the seeds; features are fitted once, forests side by side."""
    train, test = class_weights(df.where(F.col(split) != "test")), df.where(F.col(split) == "test")
    features = Pipeline(stages=feature_stages(numeric)).fit(train)
    prepared, ready, out = features.transform(train), features.transform(test), None
    for seed, model in zip(seeds, at_once(df.sparkSession, [lambda s=s: classifiers(s)["forest"].fit(prepared) for s in seeds]), strict=True):
        t = E.confusion(predict(model, ready), [], 0.5).select(F.lit(seed).alias("seed"), "balanced_accuracy")
        out = t if out is None else out.unionByName(t)
    return out.agg(F.count("*").alias("n_seeds"), F.avg("balanced_accuracy").alias("mean"), F.stddev_pop("balanced_accuracy").alias("std"))


def compare_regressors(df: DataFrame, numeric: Sequence[str], split: str = "split") -> DataFrame:
    """Errors on test of a mean and of all regressors, fitted on what is not test."""
    train, test = df.where(F.col(split) != "test"), df.where(F.col(split) == "test")
    mean = train.agg(F.avg("label")).first()[0] or 0.0
    out = E.regression(test.withColumn("prediction", F.lit(float(mean))), "label", "prediction").withColumn("model", F.lit("mean"))
    for name, kind in regressors().items():
        scored = Pipeline(stages=[*feature_stages(numeric), kind]).fit(train).transform(test)
        out = out.unionByName(E.regression(scored, "label", "prediction").withColumn("model", F.lit(name)))
    return out
