"""The pipeline's stages on the smallest tables and on odd rows, each held against what it must keep and drop."""

import random
import zlib
from collections import Counter

import brute
import corpus_pipeline
import pytest
from tideline.llm import common, decontamination
from tideline.llm.jaccard_join import near_duplicates

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def staged(spark, small):
    """Rows after each stage, from the one before."""
    docs, held = common.table(spark, small, "documents"), {}
    held["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage_table(spark, stage(spark, docs, small), name)
        held[name] = docs.collect()
    return held


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_stages_keep_columns(staged):
    for name in list(STAGES)[:-1]:
        assert list(staged[name][0].asDict()) == list(staged["documents"][0].asDict())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_language_stage_drops_what_no_profile_knows(staged):
    kept, all_docs = texts(staged["language_id"]), texts(staged["documents"])
    learned = [r for r in staged["documents"] if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None and r.text is not None]
    profiles = brute.profiles([(r.lang, r.text) for r in learned], 400)
    for i, t in all_docs.items():
        distances = brute.out_of_place(t, profiles, 400)
        best = min(sorted(distances), key=distances.get) if distances else None
        assert (i in kept) == (best is not None and any(g in profiles[best] for g in brute._ranked(brute.grams(t), 400)))


def test_line_stage_drops_recurring_lines(staged):
    before, after = texts(staged["language_id"]), texts(staged["line_dedup"])
    gone = brute.dropped(before)
    for i, t in before.items():
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[i])
        assert after.get(i) == (None if gone[i] and not left.split() else left)
    assert all(r.n_chars == len(r.text) for r in staged["line_dedup"] if gone[r.doc_id])


def test_near_duplicate_stage_keeps_one_of_each_group(spark, staged):
    before = spark.createDataFrame([(r.doc_id, r.text) for r in staged["line_dedup"]], "doc_id long, text string")
    assert set(texts(staged["near_duplicates"])) == {r.doc_id for r in near_duplicates(before).collect() if r.doc_id == r.component_id}


def test_benchmark_stage_drops_leaks(spark, small, staged):
    before = texts(staged["near_duplicates"])
    items = {r.item_id: r.text for r in common.table(spark, small, "benchmark").collect()}
    found = brute.leaks(before, items, decontamination.canonical, decontamination.LeakRule())
    assert set(texts(staged["decontamination"])) == {i for i in before if not found[i]} and any(found.values())


def test_packing_stage_packs_all_that_is_left(staged):
    assert {r.doc_id for r in staged["packing"]} == set(texts(staged["decontamination"]))


def test_odd_rows_pass_all_stages(spark, small):
    """Nulls in any column, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["that", "with", "house", "reading", "other", "summer"]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, f"{prose(40)}\n{prose(30)}", "en", "s", 10, "x", "y", "z") for i in range(30)]
    rows += [(40, None, None, None, None, None, None, None), (41, "", "en", "s", 0, "", "", ""), (42, "\n \t\n", "en", None, 3, "x", "y", "z"), (43, prose(30_000), "en", "s", 9, "x", "y", "z"), (44, "a" * 200_000, "en", "s", 9, "x", "y", "z"), (None, prose(60), "en", "s", 9, "x", "y", "z")]
    rows += [rows[3], rows[3], (5, prose(50), "en", "other", 9, "x", "y", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, language string, dedup string, _parts string")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stage_table(spark, stage(spark, docs, small), name)
        if name != "packing":
            assert docs.columns == columns
            left = Counter(r.doc_id for r in docs.collect())
            assert left[3] == 3 and left[5] == 2 and left[43] == 1 and left[None] == 1 and not left[40] + left[41] + left[42]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(left)


def test_empty_documents_pass_through(spark, small):
    docs = common.table(spark, small, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        assert docs.count() == 0
        if "text" not in docs.columns:
            break
