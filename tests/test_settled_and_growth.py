"""Queries on tables whose sums, ties or missing rows told the query and its SQL apart, and steps whose work must not outgrow the input."""

import re
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.llm import packing
from tideline.operators import evaluation as E
from tideline.operators import models as M
from tideline.operators import planning as P
from tideline.operators import similarity as V
from tideline.operators import timeseries as TS
from tideline.plans import registry

START = datetime(2024, 1, 1, 8)


def both(spark, folder, name):
    """The query's rows and those of its SQL over the folder's tables, as dictionaries."""
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for table in folder.iterdir():
        con.execute(f"create view {table.stem} as select * from '{table}/*.parquet'")
    answer = con.execute(registry.ORACLE[name])
    names = [x[0] for x in answer.description]
    want = [dict(zip(names, row, strict=True)) for row in answer.fetchall()]
    got = [row.asDict() for row in registry.QUERIES[name](spark, str(folder)).collect()]
    key = lambda r: sorted((k, repr(v)) for k, v in r.items())
    return sorted(got, key=key), sorted(want, key=key)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Totals 0.6 and 0.6 (0.6000000000000001 in another order of the rows), 0.7 and 0.2 (apart by 0.49999999999999994), and the first again."""
    folder = tmp_path_factory.mktemp("settled")
    days = [(0.1, 0.2, 0.3), (0.3, 0.2, 0.1), (0.7,), (0.2,), (0.1, 0.2, 0.3)]
    rows = [(10 * d + i, 1, START + timedelta(days=d, minutes=i), v) for d, values in enumerate(days) for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, value double").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_targets_of_settled_totals(spark, events):
    got, want = both(spark, events, "flagship_daily_targets")
    assert got == want
    assert [r["is_drop"] for r in sorted(got, key=lambda r: r["day"])] == [False, False, True, False]


def test_profile_counts_drops_of_settled_totals(spark, events):
    got, want = both(spark, events, "s25_profile_table")
    assert got == want and got[0]["n_drops"] == 1


def test_equal_totals_share_a_rank_and_have_no_z(spark, events):
    got, want = both(spark, events, "w19_w20_rank_and_zscore")
    assert got == want
    got.sort(key=lambda r: r["day"])
    assert [r["percentile_rank"] for r in got] == [0.8, 0.8, 1.0, 0.2, 0.8] and [r["z"] for r in got[:3]] == [None] * 3


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Five orders of one customer, two of an amount of 0.6 by other orders of their lines, and a customer without any."""
    folder = tmp_path_factory.mktemp("orders")
    lines = {1: (0.1,), 2: (0.2,), 3: (0.3,), 4: (0.3, 0.2, 0.1), 5: (0.1, 0.2, 0.3)}
    spark.createDataFrame([(1,), (2,)], "c_custkey long").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(k, 1, "1-URGENT", START + timedelta(days=k)) for k in lines], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate timestamp_ntz").write.parquet(f"{folder}/orders.parquet")
    rows = [(k, 20.0 + 10 * i, v, "A") for k, values in lines.items() for i, v in enumerate(values)]
    spark.createDataFrame(rows, "l_orderkey long, l_quantity double, l_extendedprice double, l_returnflag string").coalesce(1).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def test_a_plan_without_templates_has_no_scores(spark, orders):
    got, want = both(spark, orders, "r07_reject_plans")
    assert got == want and len(got) == 30
    empty = [r for r in got if r["o_custkey"] == 2]
    assert len(empty) == 15 and all((r["n_filled"], r["robust"], r["fragility"], r["fit"]) == (0, None, None, None) for r in empty)
    assert {r["reasons"] for r in empty} == {"incomplete_horizon;missing_small;missing_large"}


def test_equal_amounts_meet_a_pressure_alike(spark, orders):
    got, want = both(spark, orders, "r11_r12_rerank")
    assert got == want
    assert {r["template_id"]: r["adjusted"] for r in got}[4] == {r["template_id"]: r["adjusted"] for r in got}[5]


@pytest.fixture(scope="module")
def sparse(spark):
    """A gap of a year beside a single slot, a slot without a value, and rows without an entity."""
    rows = [(1, START, 1.0), (1, START + timedelta(minutes=30), None), (1, START + timedelta(days=365), 2.0), (2, START, 3.0), (None, START, 4.0), (None, START + timedelta(minutes=15), 5.0), (3, None, 6.0)]
    return spark.createDataFrame(rows, "e long, slot timestamp_ntz, v double")


def test_steps_between_rows_are_made_without_a_join(sparse):
    grid = TS.slot_spine(sparse, "e", "slot")
    assert "Join" not in grid._jdf.queryExecution().executedPlan().toString()
    got = {(r["e"], r["slot"]): r["v"] for r in grid.collect()}
    assert len(got) == 365 * 96 + 1 + 1 + 2
    assert {k: v for k, v in got.items() if v is not None} == {(1, START): 1.0, (1, START + timedelta(days=365)): 2.0, (2, START): 3.0}
    days = TS.spine(sparse.selectExpr("e", "cast(slot as date) as day", "v").where("v in (1, 2, 3)"), "e", "day")
    assert days.count() == 366 + 1 and days.where("v is not null").count() == 3 and dict(days.dtypes)["day"] == "date"


def test_held_values_reach_the_next_row(sparse):
    got = {(r["e"], r["slot"]): r["v"] for r in TS.slot_spine(sparse, "e", "slot", held=["v"]).collect()}
    at = lambda **x: got[1, START + timedelta(**x)]
    assert (at(minutes=15), at(minutes=30), at(minutes=45), at(days=365)) == (1.0, None, None, 2.0) and got[None, START] is None


def test_fill_moves_hours_and_not_slots(spark, events):
    got, want = both(spark, events, "j07_ffill_align")
    assert got == want and len(got) == 4 * 96 + 1
    plan = registry.QUERIES["j07_ffill_align"](spark, str(events))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.index("Generate") < plan.index("Exchange")  # printed from the last step to the first


def test_personal_data_is_learned_from_all_documents(spark, monkeypatch):
    from tideline.llm import pii

    seen = []
    rows = pii.learning_rows
    monkeypatch.setattr(pii, "learning_rows", lambda docs: seen.append(docs) or rows(docs))
    texts = ["write to ann.lee@mail%d.example.com or call +49 151 234 56%03d", "host 10.0.%d.7 has no %03d mail", "plain words only"]
    docs = spark.range(60_000).selectExpr("id as doc_id").withColumn("text", F.lit(None).cast("string"))
    few = spark.createDataFrame([(60_000 + i, t % ((i, i) if "%" in t else ())) for i in range(150) for t in texts[i % 3 : i % 3 + 1]], "doc_id long, text string")
    model = pii.learn(docs.unionByName(few), rounds=2)
    assert model.trees and seen[0].where("text is not null").count() == 150 and seen[0].count() == 60_150


@pytest.mark.parametrize(("pairs", "equal"), [(49, 0), (51, 0), (55, 0), (0, 300)])
def test_packing_is_searched_alike_however_many_lengths_and_pieces(pairs, equal, caplog):
    """Fourteen pieces that only the exhaustive search puts into four sequences, beside rows of two or three pieces that fill one: 98 to 110 lengths fit beside the largest, or there are 614 pieces."""
    pieces = Counter(17 * x for x in [30, 30, 27, 25, 21, 20, 16, 16, 15, 11, 10, 8, 5, 5])
    for a in range(75 - pairs, 75):
        pieces.update([870, a, 150 - a])
    pieces.update({1019: equal, 1: equal} if equal else {})
    plan = packing.complete_bins(pieces, 1020)
    assert sum((Counter({x: k * n for x, k in Counter(f).items()}) for f, n in plan), Counter()) == pieces and all(sum(f) <= 1020 for f, _ in plan)
    assert sum(n for _, n in plan) == 4 + pairs + equal and not caplog.records


def test_pieces_of_length_one_need_no_deep_search():
    assert packing.dominates((600, 600), (1,) * 1200) and packing.dominates((9, 9, 5), (9, 9, 2, 3)) and not packing.dominates((9, 9, 5), (9, 7, 7))


def test_plans_of_gathered_and_dealt_out_templates_are_the_same(spark):
    """Entities with no, few and many templates, one row of entities twice, ties of scores, and dates on both sides of a weekend and a season."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("template_id") * 7 % 366).cast("int"))
    t = spark.range(1, 700).select(F.when(F.col("id") < 500, 1).when(F.col("id") < 520, 2).otherwise(F.col("id") % 40 + 3).cast("long").alias("e"), F.col("id").alias("template_id"))
    t = t.select("*", day.alias("day"), (F.col("template_id") % 23 * 10.0).alias("amount"), (F.col("template_id") % 5 + 1).alias("size"), (F.col("template_id") % 3 + 1).alias("kinds"), F.lit(0.2).alias("support"), F.lit(90.0).alias("usual_amount"), F.lit(3.0).alias("usual_size"), (F.col("template_id") % 3 > 0).alias("is_core"))
    start, entities = spark.createDataFrame([(datetime(2024, 2, 27).date(),)], "start date"), spark.sql("select id as e from range(1, 50) union all select 2L union all select null")
    found = {g: sorted(map(repr, P.plan_slots(t, entities, start, "e", gathered=g).collect())) for g in (0, 100, 4096)}
    assert found[0] == found[100] == found[4096] and len(found[0]) == 51 * 5 * 15
    plan = P.plan_slots(t, entities, start, "e")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") <= 6  # ranks take no sort of all templates by strategy


def test_component_scores_are_worked_out_once(spark):
    t = spark.createDataFrame([(1, 90.0, 3, 2, 0.2, 100.0, 3.0)], "template_id long, amount double, size long, kinds long, support double, usual_amount double, usual_size double")
    for scored in (P.with_scores(t), P.under_stress(t)):
        assert scored._jdf.queryExecution().optimizedPlan().toString().count("Project") == 2


def test_class_weights_send_no_rows_to_the_driver(spark, tmp_path):
    """A small file of many rows joins the weights by class: what is broadcast is a row for each class, and the rows stay in their tasks."""
    spark.range(4000).selectExpr("id", "cast(id % 2 as double) as label").repartition(4).write.parquet(f"{tmp_path}/rows")
    weighted = M.class_weights(spark.read.parquet(f"{tmp_path}/rows").where("id < 3001"))
    assert {r["label"]: round(r["weight"], 6) for r in weighted.collect()} == {0.0: round(3001 / 2 / 1501, 6), 1.0: round(3001 / 2 / 1500, 6)}
    plan = weighted._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan


def test_neighbour_search_takes_large_batches_in_parts(spark):
    """A worker's arrays of rows by pivots or cells have one size, however many rows Arrow hands over at once."""

    class Taken:
        where = select = lambda self, *_: self
        mapInPandas = lambda self, f, _: f

    x = np.random.default_rng(3).normal(size=(5000, 4))
    placed = list(V._placed(Taken(), "id", "v", np.eye(4))(iter([pd.DataFrame({"id": np.arange(5000), "v": list(x)}), pd.DataFrame({"id": [], "v": []})])))
    assert max(map(len, placed)) <= 512 and pd.concat(placed)["id"].tolist() == list(range(5000))
    assert pd.concat(placed)["pivot"].tolist() == x.argmax(1).tolist()


def test_plans_are_summed_where_templates_are_gathered(spark, orders):
    """The rows of plan_summary over plan_slots: entities twice, null, with no, few and many templates, ids of templates that come again in an entity and in others, missing amounts and flags, and dates on both sides of a weekend and a season."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("template_id") * 7 % 366).cast("int"))
    t = spark.range(1, 700).select(F.when(F.col("id") < 500, 1).when(F.col("id") < 520, 2).otherwise(F.col("id") % 40 + 3).cast("long").alias("e"), F.col("id").alias("template_id"))
    t = t.unionByName(t.where("template_id % 9 = 0")).unionByName(t.where("template_id % 50 < 2").withColumn("e", F.lit(4).cast("long"))).unionByName(t.where("template_id % 50 = 7").withColumn("e", F.lit(None).cast("long")))
    t = t.select("*", day.alias("day"), F.when(F.col("template_id") % 31 > 0, F.col("template_id") % 23 * 10.0).alias("amount"), (F.col("template_id") % 5 + 1).alias("size"), (F.col("template_id") % 3 + 1).alias("kinds"), F.lit(0.2).alias("support"), (F.col("e") * 9.0).alias("usual_amount"), F.lit(3.0).alias("usual_size"))
    t = t.select("*", F.when(F.col("template_id") % 11 > 0, F.col("template_id") % 3 > 0).alias("is_core"), F.when(F.col("template_id") % 13 > 0, (F.col("template_id") % 4).cast("string")).alias("signature"), F.when(F.col("template_id") % 17 > 0, F.col("template_id") % 5 > 0).alias("has_x"))
    start, entities = spark.createDataFrame([(datetime(2024, 2, 27).date(),)], "start date"), spark.sql("select id as e from range(1, 50) union all select 2L union all select 4L union all select null")
    facts = P.under_stress(t).join(t.select("template_id", "signature", "amount", "is_core", "has_x"), "template_id")

    def rows(plans):
        return sorted(repr([round(x, 9) if isinstance(x, float) else x for x in r]) for r in P.rejection_reasons(plans, ["has_x"]).collect())

    least = {"least_day": 3, "least_season": 2, "least_core": 2}
    want = rows(P.plan_summary(P.plan_slots(t, entities, start, "e", **least), facts, "e", ["has_x"]))
    assert len(want) == 50 * 15 and all(rows(P.summed_plans(t, entities, start, "e", ["has_x"], gathered=g, **least)) == want for g in (30, 4096))
    plan = registry.QUERIES["r07_reject_plans"](spark, str(orders))._jdf.queryExecution().executedPlan().toString()
    shuffled_by = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert shuffled_by and not any("template_id" in k or "strategy" in k for k in shuffled_by)  # no row for a date is shuffled or joined


def test_quantiles_place_their_rows_by_one_sketch(spark):
    """Sketches of the same values may differ from run to run, so a plan that holds two of them may miss a rank."""
    found = E.exact_quantiles(spark.range(1001).selectExpr("id % 2 as g", "cast(id as double) as x"), ["g"], "x", [0.5])
    assert "percentile_approx" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["g"]: r["q"][0] for r in found.collect()} == {0: 500.0, 1: 500.0}


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    """Vectors in clusters, with ties, a zero vector, one that is missing and one id that comes twice."""
    folder = tmp_path_factory.mktemp("vectors")
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 6))[np.arange(700) % 12] + 0.1 * rng.normal(size=(700, 6))
    x[40:50], x[60] = x[40], 0
    rows = [(i, x[i].tolist() if i != 70 else None, i % 4) for i in range(700)] + [(90, x[90].tolist(), 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(f"{folder}/embeddings.parquet")
    return folder


def test_every_row_has_its_purity_and_gap(spark, vectors):
    got = {r["source_id"] for r in registry.QUERIES["l05_l06_neighbor_purity_and_gap"](spark, str(vectors)).collect()}
    assert got == set(range(700)) - {70}
    assert "% 50" not in registry.ORACLE["l05_l06_neighbor_purity_and_gap"] and "% 50" in registry.ORACLE["l03_cosine_knn"]


def test_neighbours_of_all_rows_are_those_of_the_search_by_queries(spark, vectors):
    t = spark.read.parquet(f"{vectors}/embeddings.parquet")
    rows = lambda df: sorted((r["source_id"], r["neighbor_rank"], r["neighbor_id"], round(r["similarity"], 9)) for r in df.collect())
    want = rows(V.cosine_knn(t, t, "vec_id", "embedding", 5, pivots=8))
    found = V.cosine_knn_all(t, "vec_id", "embedding", 5, pivots=8, block=64, rows_a_pivot=50)
    assert rows(found) == want and "Exchange hashpartitioning(cell" not in found._jdf.queryExecution().executedPlan().toString()
    floats = t.withColumn("embedding", F.col("embedding").cast("array<float>"))
    assert rows(V.cosine_knn_all(floats, "vec_id", "embedding", 5, pivots=8, block=64, rows_a_pivot=50)) == rows(V.cosine_knn(floats, floats, "vec_id", "embedding", 5))
    assert rows(V.cosine_knn_all(t, "vec_id", "embedding", 5)) == want and V.cosine_knn_all(t.where("vec_id < 0"), "vec_id", "embedding", 5).count() == 0
