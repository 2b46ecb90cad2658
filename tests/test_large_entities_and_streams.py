"""Entities in several chunks give what one chunk gives; streams in several batches give what one table gives; plans with odd days."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators import planning as P
from tideline.operators import timeseries as TS
from tideline.streaming import slots
from tideline.streaming.history import History, watch_payload


@pytest.fixture(scope="module")
def series(spark):
    """One entity with nearly all rows, one with a few, one with none but nulls."""
    rng = random.Random(4)
    rows = [("big", i, None if i < 40 or 900 < i < 1300 or rng.random() < 0.6 else round(rng.gauss(0, 3), 3)) for i in range(3000)]
    rows += [("small", i, float(i) if i % 3 else None) for i in range(20)] + [("none", i, None) for i in range(400)] + [("late", i, 1.5 if i == 390 else None) for i in range(400)]
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(e, start + timedelta(minutes=i), v) for e, i, v in rows], "e string, t timestamp, v double")


def table(df, *columns):
    return {(r["e"], r["t"]): tuple(None if r[c] is None or math.isnan(r[c]) else round(r[c], 9) for c in columns) for r in df.collect()}


def test_averages_by_chunk(series):
    cut = TS.carried_ema(series, "e", "t", "v", [3, 7], rows=50)
    assert cut.count() == series.count()
    assert table(cut, "ema_3", "ema_7") == table(TS.carried_ema(series, "e", "t", "v", [3, 7]), "ema_3", "ema_7")
    for e, part in series.toPandas().groupby("e"):
        part = part.sort_values("t")
        want = part["v"].ewm(span=7, adjust=False, ignore_na=False).mean()
        got = table(cut.where(F.col("e") == e), "ema_7")
        assert [got[e, t.to_pydatetime()][0] for t in part["t"]] == [None if pd.isna(x) else round(x, 9) for x in want]


def test_no_task_walks_a_large_entity(series):
    chunks, many = TS.time_chunks(series, "e", "t", 50)
    sizes = chunks.groupBy("e", "_chunk").count().toPandas()
    assert many and sizes[sizes["e"] == "big"]["count"].max() < 100 and set(sizes[sizes["e"] == "small"]["_chunk"]) == {0}


def test_fills_by_chunk(series):
    assert table(TS.interpolate(series, "e", "t", "v", rows=50), "v_filled") == table(TS.interpolate(series, "e", "t", "v"), "v_filled")
    got = table(TS.interpolate(series, "e", "t", "v", rows=50), "v_filled")
    for e, part in series.toPandas().groupby("e"):
        part = part.sort_values("t")
        want = part["v"].interpolate(limit=8)
        assert [got[e, t.to_pydatetime()][0] for t in part["t"]] == [None if pd.isna(x) else round(x, 9) for x in want]
    assert table(TS.forward_fill(series, "e", "t", "v", "f", rows=50), "f") == table(TS.forward_fill(series, "e", "t", "v", "f"), "f")


def test_asof_by_chunk(spark):
    rng = random.Random(9)
    start = datetime(2024, 1, 1)
    make = lambda n, base: [(base + i, "big" if rng.random() < 0.9 else "x", start + timedelta(seconds=rng.randrange(4000) * 10), float(i)) for i in range(n)]
    left = spark.createDataFrame([r[:3] for r in make(800, 0)], "id long, e string, t timestamp")
    right = spark.createDataFrame(make(60, 10_000), "id long, e string, t timestamp, v double")
    answers = [sorted(map(tuple, TS.asof_backward(left, right, "e", "t", "id", ["v"], 7200, rows=r).collect()), key=repr) for r in (50, 1 << 30)]
    assert answers[0] == answers[1] and any(x[3] is not None for x in answers[0]) and any(x[3] is None for x in answers[0])


def test_finished_stream_has_all_slots(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 8, m), float(m)) for m in (1, 5, 20)] + [(2, datetime(2024, 1, 1, 12, 59), 4.0), (None, datetime(2024, 1, 1, 12, 50), None)]
    spark.createDataFrame(rows, "entity_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("entity_id long, ts timestamp, value double").parquet(f"{tmp_path}/in")
    got, late = slots.finished_slots(source, f"{tmp_path}/out")
    assert sorted(((r.entity_id, r.slot.hour, r.slot.minute, r.amount, r.n) for r in got.collect()), key=repr) == sorted([(1, 8, 0, 6.0, 2), (1, 8, 15, 20.0, 1), (2, 12, 45, 4.0, 1), (None, 12, 45, None, 1)], key=repr)
    assert late == 0


def test_late_rows_are_counted(spark, tmp_path):
    schema = "entity_id long, ts timestamp, value double"
    for hour, minute in [(8, 0), (12, 0), (12, 1), (8, 3)]:
        spark.createDataFrame([(1, datetime(2024, 1, 1, hour, minute), 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got, late = slots.finished_slots(source, f"{tmp_path}/out")
    assert late == 1 and sorted((r.slot.hour, r.n) for r in got.collect()) == [(8, 1), (12, 2)]  # Spark drops by the watermark of the batch before


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "entity_id long, ts timestamp, value double").write.parquet(f"{tmp_path}/in")
    got, late = slots.finished_slots(spark.readStream.schema("entity_id long, ts timestamp, value double").parquet(f"{tmp_path}/in"), f"{tmp_path}/out")
    assert got.count() == 0 and late == 0


def test_history_by_batches_is_that_of_all_rows(spark, tmp_path):
    rng = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = sorted((rng.choice(["a", "a", "a", "b"]), start + timedelta(minutes=rng.randrange(3000)), i, rng.choice([None, round(rng.random(), 2)])) for i in range(400)) + [("c", start, 1000, 0.5)]
    rows.sort(key=lambda r: (r[1], r[2]))
    schema = "entity_id string, ts timestamp, id long, score double"
    kept, once = (History(spark, f"file://{tmp_path}/{n}", T.StringType(), window=10, fold=2) for n in ("batches", "once"))
    for number in range(5):
        part = spark.createDataFrame(rows[number * 90 : (number + 1) * 90], schema)
        kept.add(part, number)
        if number in (1, 2):  # sent again, before and after it is added up
            kept.add(part, number)
    once.add(spark.createDataFrame(rows, schema), 0)
    view = lambda h: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in h.payload((0.4, 0.6)).collect())
    assert view(kept) == view(once) and len(view(kept)) == 3
    pdf = pd.DataFrame(rows, columns=["e", "ts", "id", "score"]).dropna()
    for r in kept.payload((0.4, 0.6)).collect():
        s = pdf[pdf["e"] == r["entity_id"]]["score"]
        rate = (s >= 0.5).astype(float).rolling(10).mean().dropna()
        assert np.isclose(r["latest"], s.iloc[-1]) and np.isclose(r["q10"], s.quantile(0.1)) and np.isclose(r["recent_mean"], s.tail(10).mean())
        assert (r["rate_q90"] is None) if rate.empty else np.isclose(r["rate_q90"], rate.quantile(0.9))
        assert r["zone_status"] == ("watch" if 0.4 <= s.iloc[-1] <= 0.6 else "ok")


def test_nothing_to_watch(spark, tmp_path):
    assert History(spark, f"file://{tmp_path}/none", T.LongType()).payload((0.0, 1.0)).count() == 0
    assert callable(watch_payload)


def test_plans_need_templates_and_give_all_reasons(spark):
    t = spark.createDataFrame([(1, 10, datetime(2024, 3, 1).date(), 100.0, 2, 1), (1, 11, datetime(2024, 3, 2).date(), 300.0, 4, 2), (1, 12, datetime(2024, 3, 3).date(), 200.0, 3, 2)], "e long, template_id long, day date, amount double, size long, kinds long")
    t = t.withColumns({"support": F.lit(0.2), "usual_amount": F.lit(200.0), "usual_size": F.lit(3.0), "is_core": F.col("template_id") < 12})
    start = spark.createDataFrame([(datetime(2024, 6, 7).date(),)], "start date")
    entities = spark.createDataFrame([(1,), (2,)], "e long")
    chosen = P.plan_slots(t, entities, start, "e")
    rows = {(r["e"], r["strategy"], r["horizon"], r["slot_no"]): r for r in chosen.collect()}
    assert len(rows) == 2 * 5 * 15 and all(r["template_id"] is None for k, r in rows.items() if k[0] == 2)
    line = [rows[1, "amount", 7, i] for i in range(7)]
    assert [r["rank"] for r in line] == [1, 2, 3, 1, 2, 3, 1] and [r["planned_day_of_week"] for r in line][:2] == ["Friday", "Saturday"]
    few = {r["slot_no"]: r["template_id"] for r in P.plan_slots(t, entities, start, "e", least_day=1, least_season=5, least_core=1).where("e = 1 and strategy = 'balanced' and horizon = 3").collect()}
    assert few == {0: 10, 1: 11, 2: 11}  # a weekday, then a weekend: of 11 and 12 only 11 is in the band
    facts = P.under_stress(t).join(t.select("template_id", "amount", "is_core", F.lit("s").alias("signature"), (F.col("template_id") > 10).alias("has_x")), "template_id")
    judged = {(r["e"], r["strategy"], r["horizon"]): r for r in P.rejection_reasons(P.plan_summary(chosen, facts, "e", ["has_x"]), ["has_x"]).collect()}
    assert judged[2, "mix", 3]["reasons"] == ["incomplete_horizon", "missing_x"] and not judged[2, "mix", 3]["promoted"]
    assert judged[1, "mix", 3]["reasons"][:4] == ["missing_x", "outside_core_band", "signature_repeat_above_limit", "signature_repeated_inside_recent_window"]
    assert "template_repeat_above_limit" in judged[1, "mix", 7]["reasons"] and "fragility_above_ceiling" not in judged[1, "mix", 3]["reasons"]
