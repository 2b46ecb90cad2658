"""Semantics that SQL does not make obvious, on hand-written rows."""

import datetime as dt

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import scalars as S
from tideline.operators import baskets as B
from tideline.operators import evaluation as E
from tideline.operators import similarity as V
from tideline.operators import timeseries as TS
from tideline.sources import exports as X


def series(spark, values):
    rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "e string, t date, v double")


def test_ema_carries_and_fades(spark):
    out = TS.carried_ema(series(spark, [None, 1.0, None, None, 4.0, None, 6.0]), "e", "t", "v", [3]).orderBy("t").collect()
    assert [None if r.ema_3 is None else round(r.ema_3, 6) for r in out] == [None, 1, 1, 1, 3.4, 3.4, 5.133333]


def test_interpolation_stops_at_its_limit(spark):
    out = TS.interpolate(series(spark, [None, None, 1.0, *[None] * 10, 12.0, *[None] * 10]), "e", "t", "v").orderBy("t").collect()
    assert [r.v_filled for r in out] == [None, None, 1, 2, 3, 4, 5, 6, 7, 8, 9, None, None, 12, *[12] * 8, None, None]


def test_streak(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([True, True, False, True, None, True])], "e string, t int, f boolean")
    assert [r.s for r in TS.streak(df, "e", "t", F.col("f"), "s").orderBy("t").collect()] == [1, 2, 0, 1, 0, 1]


def test_asof_takes_equal_times_and_minds_its_tolerance(spark):
    at = lambda h, m: dt.datetime(2024, 1, 1, h, m)
    left = spark.createDataFrame([(i, "a", t) for i, t in enumerate([at(10, 0), at(11, 59), at(14, 0), at(14, 1), at(9, 59)])], "id long, e string, t timestamp_ntz")
    right = spark.createDataFrame([(10, "a", at(10, 0), "x"), (11, "a", at(12, 0), "y")], "id long, e string, t timestamp_ntz, v string")
    out = TS.asof_backward(left, right, "e", "t", "id", ["v"], 7200).orderBy("id").collect()
    assert [r.asof_v for r in out] == ["x", "x", "y", None, None]


def test_split_sizes(spark):
    for n, want in ((1, (1, 0, 0)), (9, (9, 0, 0)), (10, (7, 1, 2)), (29, (20, 4, 5)), (30, (24, 3, 3)), (100, (80, 10, 10))):
        got = {r.split: r["count"] for r in TS.temporal_split(series(spark, [1.0] * n), "e", "t").groupBy("split").count().collect()}
        assert tuple(got.get(k, 0) for k in ("train", "val", "test")) == want


def test_calibration_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (0.10001,), (1.0,)], "p double")
    assert [r.b for r in df.select(E.bucket(F.col("p"), 10).alias("b")).collect()] == [0, 0, 1, 9]


def test_equal_thresholds_give_the_lowest(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.2)], "y int, p double")
    assert E.best_threshold(E.threshold_scan(df), []).first().threshold == 0.25


def test_kv_text(spark):
    row = spark.createDataFrame([("[a=1, b={x,y}, c=[1,2], d=z]",)], "t string").select(X.parse_kv_entries(F.col("t")).alias("m")).first()
    assert row.m == {"a": "1", "b": "{x,y}", "c": "[1,2]", "d": "z"}


def test_wallclock_drops_the_zone(spark):
    df = spark.createDataFrame([("2024-05-01T10:00:00+02:00[Europe/Paris]",), ("2024-05-01 10:00:00Z",), ("no time",)], "t string")
    assert [r.x for r in df.select(S.wallclock(F.col("t")).alias("x")).collect()] == [dt.datetime(2024, 5, 1, 10), dt.datetime(2024, 5, 1, 10), None]


def test_device_csv_skips_banner_and_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("com.device.weight,6\nday,kg\n2024-01-01,80.5\nbad,81\n")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("day", T.StringType()), T.StructField("kg", T.DoubleType())])
    assert [tuple(r) for r in X.read_device_csv(spark, f"{tmp_path}/*.csv", schema).orderBy("day").collect()] == [("2024-01-01", 80.5), ("bad", 81.0)]


def test_review_batches_need_all_kinds(spark, tmp_path):
    from pyspark.sql import types as T

    for folder, kinds in (("b1", ("items", "lines")), ("b2", ("items",))):
        (tmp_path / folder).mkdir()
        for k in kinds:
            (tmp_path / folder / f"{k}.json").write_text('{"k": "x"}\n')
    rows = X.read_review_batches(spark, str(tmp_path), ["items", "lines"], T.StructType([T.StructField("k", T.StringType())])).collect()
    assert {(r.folder, r.kind) for r in rows} == {("b1", "items"), ("b1", "lines")}


def test_checked_join_refuses_double_keys(spark):
    import pytest

    left, dim = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="not unique"):
        B.checked_join(left, dim, ["k"]).collect()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 5)), min_size=1, max_size=25))
def test_auc_equals_pair_counting(spark, rows):
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    out = E.roc_auc(spark.createDataFrame([(y, p / 5) for y, p in rows], "y int, p double"), []).collect()
    assert not pairs and not out or abs(out[0].auc - np.mean(pairs)) < 1e-9


def test_svd_axes_span_numpys(spark):
    x = np.random.default_rng(0).normal(size=(40, 6))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")
    got = np.array([r.coordinates for r in V.svd_embed(df, "id", "v", 3).orderBy("id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-8)


def test_knn_blocks_agree_with_one_product(spark):
    x = np.random.default_rng(1).normal(size=(50, 4))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "id long, v array<double>")
    got = V.cosine_knn(df, df, "id", "v", 3, block=7).toPandas().sort_values(["source_id", "neighbor_rank"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T - 9 * np.eye(50)
    want = np.argsort(-s, axis=1)[:, :3]
    assert (got["neighbor_id"].to_numpy().reshape(50, 3) == want).all()
    assert isinstance(got, pd.DataFrame)


def test_balls_skip_cells_and_lose_nothing(spark):
    """Clusters, equal vectors, zero vectors and rows without one: as one matrix product gives, though most cells are never met."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([c + 0.05 * r.normal(size=(40, 16)) for c in centres] + [np.tile(centres[0], (5, 1)), np.zeros((3, 16))])
    df = spark.createDataFrame([*((i, list(map(float, v))) for i, v in enumerate(x)), (900, None)], "id long, v array<double>")
    near, work = V.ball_search(df.where("id % 3 = 0 or id >= 480"), df, "id", "v", 4, pivots=16, block=16, rows_a_pivot=20)
    n = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    s = np.round(n @ n.T, 12) + 0.0
    want = {}
    for i in [i for i in range(len(x)) if i % 3 == 0 or i >= 480]:
        others = np.array([j for j in range(len(x)) if j != i])
        want[i] = others[np.lexsort((others, -s[i, others]))[:4]].tolist()
    got = near.toPandas().sort_values(["source_id", "neighbor_rank"]).groupby("source_id")["neighbor_id"].agg(list).to_dict()
    # Equal vectors may differ in the last bit of their products, so similarities are held against each other, not names.
    assert got.keys() == want.keys()
    assert all(np.allclose(s[i, got[i]], s[i, want[i]], atol=1e-11) and len(set(got[i])) == 4 for i in want)
    met = work.where("source_id < 480").agg({"n_visited": "avg", "n_cells": "max"}).first()
    assert met["avg(n_visited)"] < 0.4 * met["max(n_cells)"]
    assert V.cosine_knn(df, df.where("id < 0"), "id", "v", 4).count() == 0


def test_late_rows_are_dropped_by_the_stream(spark, tmp_path):
    """Files come one by one; a row for a slot that the watermark has passed changes nothing, and open slots are not written."""
    from datetime import datetime

    from tideline.streaming import slots

    def write(number, rows):
        spark.createDataFrame([(1, datetime(2024, 1, 1, h, m), v) for h, m, v in rows], "entity_id long, ts timestamp, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{number}")

    write(0, [(8, 1, 1.0), (8, 5, 3.0), (8, 20, 5.0)])
    write(1, [(12, 0, 7.0)])
    write(2, [(8, 2, 100.0), (12, 5, 9.0)])
    for n in range(3):  # one stream over the folders in order
        source = spark.readStream.schema("entity_id long, ts timestamp, value double").parquet(f"{tmp_path}/in/[0-{n}]")
        slots.slot_rollup(source).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    got = sorted((r.slot.hour, r.slot.minute, r.level, r.amount, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(8, 0, 2.0, 4.0, 2), (8, 15, 5.0, 5.0, 1)]


def test_exact_quantiles_and_running_sums(spark):
    import random

    import numpy as np

    from tideline.operators import evaluation as E

    rng = random.Random(2)
    rows = [(g, rng.choice([0.5, rng.random(), round(rng.random(), 1)]), rng.randrange(2)) for g in ("a", "b") for _ in range(700)] + [("c", 0.25, 1)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    for r in E.exact_quantiles(df, ["g"], "p", [0.05, 0.5, 0.9], cuts=15).collect():
        assert np.allclose(r.q, np.quantile([p for g, p, _ in rows if g == r.g], [0.05, 0.5, 0.9]))
    whole = E.exact_quantiles(df, [], "p", [0.5]).first()
    assert np.isclose(whole.q[0], np.quantile([p for _, p, _ in rows], 0.5))
    for r in E.roc_auc(df, ["g"]).collect():
        pos, neg = ([p for g, p, y in rows if g == r.g and y == k] for k in (1, 0))
        assert np.isclose(r.auc, np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_candidate_pools_keep_the_best(spark):
    from tideline.operators import scenarios as C

    t = spark.createDataFrame([(i, "s" if i < 9 else "r", f"k{i % 2}", i % 3 == 0, float(i % 7)) for i in range(12)], "template_id long, slot string, kind string, is_core boolean, score double")
    pool = C.candidate_pool(t, spark.createDataFrame([("s", "k0"), ("r", "k1"), ("q", "none")], "slot string, kind string"), "slot", "kind", k=2, least_first=5, least_second=5).collect()
    got = {(r.slot, r.tier, r.place): r.template_id for r in pool}
    assert got == {("s", 1, 1): 6, ("s", 1, 2): 5, ("r", 2, 1): 5, ("r", 2, 2): 11, ("q", 3, 1): 6, ("q", 3, 2): 3}


def test_calibration_and_ridge_equal_numpy(spark):
    """Platt's scores are those of a logistic fit on the val rows' scores; isotonic ones rise; ridge has its closed form (Spark divides the penalty by the label's spread)."""
    import random

    import numpy as np
    from pyspark.ml.feature import VectorAssembler

    from tideline.operators import models as M

    rng = random.Random(4)
    rows = [(i, "val" if i % 2 else "test", int(rng.random() < x), x) for i in range(400) for x in (rng.random(),)]
    out = M.calibrate(spark.createDataFrame(rows, "id long, split string, y int, p double")).select("p", "platt", "isotonic").toPandas().sort_values("p")
    x, y = (np.array([r[k] for r in rows if r[1] == "val"], float) for k in (3, 2))
    w = np.zeros(2)
    for _ in range(50):
        q = 1 / (1 + np.exp(-(w[0] + w[1] * x)))
        a = np.stack([np.ones_like(x), x])
        w += np.linalg.solve((a * (q * (1 - q))) @ a.T, a @ (y - q))
    assert np.allclose(out.platt, 1 / (1 + np.exp(-(w[0] + w[1] * out.p))), atol=1e-3)
    assert (np.diff(out.isotonic) >= -1e-9).all()
    z = np.random.default_rng(1).normal(size=(60, 2))
    t = z @ [2.0, -1.0] + 0.5
    fit = M.regressors()["ridge"].setParams(featuresCol="f", standardization=False).fit(VectorAssembler(inputCols=["a", "b"], outputCol="f").transform(spark.createDataFrame([(float(p), float(q), float(v)) for (p, q), v in zip(z, t)], "a double, b double, label double")))
    c = z - z.mean(0)
    assert np.allclose(fit.coefficients.toArray(), np.linalg.solve(c.T @ c / 60 + 0.1 / t.std(ddof=1) * np.eye(2), c.T @ (t - t.mean()) / 60), atol=0.02)


def test_backtest_chooses_on_validation_rows(spark):
    from tideline.operators import models as M

    rows = [(i, float(i % 2), float(i % 2) + 0.1 * (i % 7)) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, label double, x double")
    out = M.rolling_backtest(df, "id", [(100, 140, 200), (140, 180, 240)], ["x"], kinds=("logistic",)).collect()
    assert [(r.fold, r.model, r.tp + r.fp + r.tn + r.fn) for r in sorted(out, key=lambda r: r.fold)] == [(0, "logistic", 60), (1, "logistic", 60)]


def test_fixed_scores_of_the_additive_rules(spark):
    from tideline.functions import scalars as S

    rows = [("Fried", "burger", 1, 0, 2, 950.0, 31.0, None), (None, "salad", 0, 1, 1, 400.0, None, 4.0), ("x", None, None, None, None, None, None, None)]
    c = F.col
    scores = S.additive_scores(c("prep"), c("kind"), c("desserts"), c("drinks"), c("n"))
    got = spark.createDataFrame(rows, "prep string, kind string, desserts int, drinks int, n int, kcal double, protein double, fibre double").select(*(F.round(v, 6).alias(k) for k, v in scores.items()), S.density_style(c("kcal")).alias("d"), S.satiety_style(c("protein"), c("fibre")).alias("s"), S.coherence_score(c("n"), [c("desserts"), c("drinks")]).alias("h"))
    assert [tuple(r) for r in got.collect()] == [(0.75, 0.15, 0.95, "high", "high", 0.8), (0.45, 0.65, 0.4, "light", "moderate", 0.8), (0.45, 0.4, 0.4, None, None, 0.5)]
