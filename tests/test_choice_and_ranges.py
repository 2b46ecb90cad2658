"""Choice of models, shuffled columns, range joins, variants and overrides against plain calculations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from tideline.operators import evaluation as E
from tideline.operators import models as M
from tideline.operators import planning as P


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x, z = rng.normal(size=900), rng.normal(size=900)
    y = (x + 0.3 * rng.normal(size=900) > 0.4).astype(float)
    split = rng.choice(["train", "val", "test"], 900, p=[0.6, 0.2, 0.2])
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(900), "x": x, "z": z, "label": y, "split": split}))


def test_rating_takes_macro_f1_first():
    row = lambda tp, fp, tn, fn, ba, acc: {"tp": tp, "fp": fp, "tn": tn, "fn": fn, "balanced_accuracy": ba, "accuracy": acc}
    a, b = row(8, 2, 8, 2, 0.8, 0.8), row(9, 5, 5, 1, 0.95, 0.9)
    assert M.rating(a) > M.rating(b) and np.isclose(M.rating(a)[0], 0.8)
    assert M.rating(row(0, 0, 0, 0, 0.0, 0.0))[0] == 0.0 and M.rating(None) < M.rating(b)


def test_permutation_importance_is_that_of_numpy(spark, sample):
    model = Pipeline(stages=[*M.feature_stages(["x", "z"]), M.classifiers()["logistic"]]).fit(M.class_weights(sample))
    got = {r["feature"]: (r["drop"], r["spread"]) for r in M.permutation_importance(model, sample, ["x", "z"], repeats=4, seed=3).collect()}
    pdf = sample.toPandas().sort_values("id")

    def rated(frame):
        p = M.predict(model, spark.createDataFrame(frame)).select("id", "y", "p").toPandas()
        hit = p["p"] >= 0.5
        return round((hit[p["y"] == 1].mean() + (~hit[p["y"] == 0]).mean()) / 2, 6)

    base = rated(pdf)
    for i, c in enumerate(["x", "z"]):
        drops = [base - rated(pdf.assign(**{c: pdf[c].to_numpy()[np.random.default_rng([3, 0, i, r]).permutation(len(pdf))]})) for r in range(4)]
        assert np.allclose(got[c], (np.mean(drops), np.std(drops)))
    assert got["x"][0] > 0.2 > abs(got["z"][0])


def test_shuffled_copies_keep_each_columns_values(sample):
    dealt = M.shuffled_copies(sample, ["x"], 2, bucket_rows=100).toPandas()
    assert len(dealt) == 1800
    for _, part in dealt.groupby("repeat"):
        assert np.allclose(np.sort(part["x"]), np.sort(sample.toPandas()["x"])) and sorted(part["id"]) == list(range(900))


def test_regressor_is_chosen_on_val(spark, sample):
    df = sample.withColumn("label", 3 * F.col("x") + 1)
    table, name = M.fit_select_regressor(df, ["x", "z"])
    rows = {r["model"]: r for r in table.collect()}
    assert name == "ridge" and rows["chosen:ridge"]["mae"] < 0.2 * rows["mean"]["mae"] and rows["chosen:ridge"]["r2"] > 0.9


def test_ranges_by_bins(spark):
    rng = np.random.default_rng(2)
    ranges = [(i, int(a), int(a + w)) for i, (a, w) in enumerate(zip(rng.integers(-50, 1000, 2000), rng.integers(0, 90, 2000), strict=True))]
    xs = [*rng.integers(-100, 1200, 300).tolist(), None, -50, 1000]
    rows = spark.createDataFrame([(n, x) for n, x in enumerate(xs)], "n long, x long")
    df = E.assign_ranges(rows, "x", spark.createDataFrame(ranges, "fold long, lo long, hi long"), bins=64)
    assert sorted((r["n"], r["fold"]) for r in df.collect()) == sorted((n, f) for n, x in enumerate(xs) if x is not None for f, lo, hi in ranges if lo <= x < hi)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin Inner, ((lo" not in plan and "CartesianProduct" not in plan
    assert E.assign_ranges(rows, "x", spark.createDataFrame([(1, 5, 5)], "fold long, lo long, hi long")).count() == 0


def test_last_rows_of_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4990, "hot").otherwise("cold").alias("g"))
    got = E.last_of_group(df, ["g"], [F.desc("id")], 3, "id", "k").collect()
    assert {(r["g"], r["id"], r["k"]) for r in got} == {("hot", 4989 - i, i + 1) for i in range(3)} | {("cold", 4999 - i, i + 1) for i in range(3)}


def test_variants_fall_back_to_the_category(spark):
    rows = [(i, "a", "m", 100.0 + i) for i in range(5)] + [(10, "b", "m", 102.0), (11, "c", "alone", 103.0), (12, "a", "m", None), (13, "a", "m", 0.0)] + [(20 + i, "w", "w", 60.0 + 10 * i) for i in range(9)]
    got = {(r["id"], r["variant"]): r for r in P.portion_variants(spark.createDataFrame(rows, "id long, s string, c string, x double"), "id", "s", "c", "x").collect()}
    assert {i for i, v in got if v == "observed"} == {r[0] for r in rows}
    assert not any(i in (11, 12, 13) and v != "observed" for i, v in got)
    assert got[28, "lighter"]["scope"] == "signature" and np.isclose(got[28, "lighter"]["multiplier"], 0.88)
    assert all(0.88 <= r["multiplier"] <= 1.12 and abs(r["multiplier"] - 1) >= 0.035 for (i, v), r in got.items() if v != "observed")
    scopes = {r["scope"] for (i, v), r in got.items() if i == 10}
    assert scopes <= {None, "category"}


def test_overrides_replace_what_they_supply(spark):
    context = spark.createDataFrame([(1, 5.0, 7.0), (2, 6.0, None), (3, None, 1.0)], "k long, a double, b double")
    given = spark.createDataFrame([(1, 9.0, None), (3, None, None)], "k long, a double, b double")
    assert sorted(map(tuple, P.override_context(context, given, ["k"]).collect())) == [(1, 9.0, 7.0, True), (2, 6.0, None, False), (3, None, 1.0, False)]
