"""The registered text queries on the smallest tables: against SQL where there is some, else against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import pytest

from tideline.llm import common, decontamination, langid, line_dedup, packing, pii, quality, queries, tokens, toxicity

COLUMNS = {
    "op1_line_dedup": {"doc_id": "bigint"},
    "op2_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op6_warc": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op8_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9_token_counts": {"source": "string", "lang": "string", "tokenizer": "string", "n_docs": "bigint", "n_tokens": "bigint"},
    "op10_benchmark_decontamination": {"doc_id": "bigint", "contaminated": "boolean", "item_ids": "array<bigint>"},
}


@pytest.fixture(scope="module")
def rows(spark, small):
    """Rows of a query on the smallest tables, run once."""
    held = {}

    def run(name):
        if name not in held:
            df = queries.QUERIES[name](spark, small)
            types = dict(df.dtypes)
            assert {k: types.get(k) for k in COLUMNS[name]} == COLUMNS[name]
            held[name] = df.collect()
        return held[name]

    return run


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in common.table(spark, small, "documents").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(rows, small, name):
    duck = duckdb.connect()
    for t in ("documents", "pages"):
        duck.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    answer = duck.execute(queries.ORACLE[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == sorted(rows(name)[0].asDict())
    assert sorted(answer.fetchall()) == sorted(tuple(r[c] for c in names) for r in rows(name))


def test_lines_equal_brute_force(rows, texts):
    gone = brute.dropped(texts)
    for r in rows("op1_line_dedup"):
        parts = (texts[r.doc_id] or "").split("\n")
        left = "\n".join(x for i, x in enumerate(parts) if i not in gone[r.doc_id])
        assert r.n_dropped == len(gone[r.doc_id])
        assert r.text_md5 == (None if texts[r.doc_id] is None else hashlib.md5(left.encode()).hexdigest())


def test_quality_base_and_verdicts(rows, texts):
    for r in rows("op2_quality_rules"):
        base = brute.base_statistics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0]) and not (r.base_failed and r.kept)
    assert any(r.kept for r in rows("op2_quality_rules"))


def test_quality_rules_are_an_ordered_list(spark, small, texts):
    """The conditional expression says what the first matching rule says."""
    docs, labels = common.table(spark, small, "documents").select("doc_id", "text"), common.table(spark, small, "labels")
    stats = common.stage_table(spark, quality.with_statistics(docs), "stats")
    rules = quality.learn_rules(stats.select("doc_id", "stats"), labels)
    for r in quality.judge(stats, rules).select("doc_id", "stats", "rule", "kept", "base_failed").collect():
        matching = [i for i, rule in enumerate(rules.rules) if all((r.stats[c.name] > c.cut) == c.above for c in rule)]
        assert r.rule == min(matching, default=None) and r.kept == (not matching and not r.base_failed)


def test_toxicity_scores_equal_brute_force(rows, spark, small, texts):
    """With every word held against every term by its edit distance."""
    model = toxicity.learn(common.table(spark, small, "documents").select("doc_id", "text"), common.table(spark, small, "labels"))
    matcher = brute.Matcher(model.lexicon, toxicity.edits_of_length)
    for r in rows("op3_toxicity"):
        want = brute.toxicity(model, matcher, texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-6) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.5)


def test_languages_equal_brute_force(rows, spark, small, texts):
    langs = {r.doc_id: r.lang for r in common.table(spark, small, "documents").collect()}
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2 and langs[i] is not None and texts[i] is not None]
    profiles = brute.profiles([(langs[i], texts[i]) for i in learned], 400)
    for r in rows("op7_language_id"):
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        distances = brute.out_of_place(texts[r.doc_id], profiles, 400)
        assert r.lang_pred == (min(sorted(distances), key=distances.get) if distances else langid.UNKNOWN)


def test_spans_keep_the_base(rows, texts):
    for r in rows("op5_pii"):
        base = brute.spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",") if r.spans else [])


def test_packing_is_whole_and_close_to_the_bound(rows, texts):
    from tokenizers import Tokenizer

    plain, pieces = Tokenizer.from_file(tokens.vocabulary()), defaultdict(list)
    for r in rows("op8_best_fit_packing"):
        pieces[r.doc_id].append(r)
    for i, t in texts.items():
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert sum(r.length for r in own) == len(ids) and [r.piece for r in own] == list(range(len(own)))
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    sequences = defaultdict(list)
    for r in rows("op8_best_fit_packing"):
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 1024
    counts = np.bincount([n for own in sequences.values() for _, n in own], minlength=1025)
    assert len(sequences) <= packing.lower_bound(counts, 1024) + 1


def test_token_counts_equal_a_recount(rows, spark, small, texts):
    from tokenizers import Tokenizer

    plain, totals, seen = Tokenizer.from_file(tokens.vocabulary()), Counter(), set()
    for r in sorted(common.table(spark, small, "documents").collect(), key=lambda r: r.doc_id):
        if r.text is None or r.text not in seen:
            seen.add(r.text)
            lines = "\n".join(dict.fromkeys((r.text or "").split("\n")))
            totals[r.source, r.lang, "docs"] += 1
            totals[r.source, r.lang, "tokens"] += len(plain.encode(lines, add_special_tokens=False).ids)
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in rows("op9_token_counts") if r.n_docs} == {k[:2]: (totals[(*k[:2], "docs")], totals[(*k[:2], "tokens")]) for k in totals}


def test_leaks_equal_brute_force(rows, spark, small, texts):
    items = {r.item_id: r.text for r in common.table(spark, small, "benchmark").collect()}
    want = brute.leaks(texts, items, decontamination.canonical, decontamination.LeakRule())
    assert {r.doc_id: (r.contaminated, r.item_ids) for r in rows("op10_benchmark_decontamination")} == {i: (bool(want[i]), sorted(want[i])) for i in texts}


# ---- personal data off the base --------------------------------------------

NOISE = ["chapter 3 of 12", "in 2020-05-17 at 10:30", "version 4.5.6", "1,234,567 units", "look at page.Then", "room 12-14", "score 3 - 2 - 1", "item 4411-22"]


def prose(rng, n):
    return " ".join(rng.choice(["lorna", "mive", "sarto", "kelu", "tando", "ripe", "gomel", "vast"]) + rng.choice("abcdeiou") for _ in range(n))


def luhn_number(rng, right=True):
    d = [rng.randrange(10) for _ in range(15)]
    total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d))
    check = -total % 10
    return "".join(map(str, d)) + str(check if right else (check + 5) % 10)


def personal(rng, kind):
    if kind == "email":
        return f"{rng.choice(['ann', 'bo', 'cy'])}.{rng.choice(['lee', 'ray'])}{rng.randrange(99)}@{rng.choice(['mail', 'post'])}{rng.randrange(9)}.example.com"
    if kind == "ip":
        return ".".join(str(rng.randrange(1, 255)) for _ in range(4))
    if kind == "card":
        return luhn_number(rng)
    return f"+{rng.randrange(1, 9)} ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"


def hidden(rng, kind, v):
    """A form that the base patterns don't match."""
    if kind == "email":
        return v.replace("@", rng.choice([" [at] ", "(at)"])).replace(".", " [dot] ") if rng.random() < 0.5 else v.replace("@", " at ").replace("example.com", "example dot com")
    if kind == "ip":
        return v.replace(".", rng.choice(["[.]", " dot "]))
    if kind == "card":
        return rng.choice(["/", ".", "_"]).join(v[i : i + 4] for i in range(0, 16, 4))
    return "00" + v[1:].replace("(", "").replace(")", "")


def test_hidden_forms_are_found_through_the_trees(spark):
    """Learned from plain forms in other documents; look-alikes and noise are left alone."""
    rng = random.Random(31)
    learning = [f"{prose(rng, 20)} {personal(rng, pii.KINDS[i % 4])} {prose(rng, 8)} {rng.choice(NOISE)} {prose(rng, 20)}" for i in range(800)]
    model = pii.learn(spark.createDataFrame(list(enumerate(learning)), "doc_id long, text string"))
    assert set(model.thresholds) == set(pii.KINDS)
    texts, where = [], []
    for i in range(400):
        kind, head = pii.KINDS[i % 4], prose(rng, 15) + " "
        value = hidden(rng, kind, personal(rng, kind)) if i % 8 < 4 else {"card": ".".join(luhn_number(rng, False)[k : k + 4] for k in range(0, 16, 4)), "ip": "300[.]4[.]999[.]1"}.get(kind, rng.choice(NOISE))
        texts.append(head + value + " " + prose(rng, 15))
        where.append((kind, len(head), len(head) + len(value)) if i % 8 < 4 else None)
    found = pii.detect(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model)
    right = wrong = 0
    for r in found.select("doc_id", "base_spans", "spans").collect():
        added = {tuple(x) for x in r.spans} - {tuple(x)[:3] for x in r.base_spans}
        for kind, start, end in added:
            target = where[r.doc_id]
            good = target is not None and kind == target[0] and start <= target[1] and end >= target[2]
            right, wrong = right + good, wrong + (not good)
    assert right >= 0.8 * 200 and right >= 0.95 * (right + wrong)
    probes = {"host 10[.]0[.]0[.]1 is down": "ip:5:19", "we met at noon.Then left": "", "isbn 978 3161 484100 4 here": "", 'token = "ede43f42c939b6405768150aa"': "", "ratio 10, 20, 30, 40 of it": ""}
    got = pii.detect(spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string"), model).select("text", pii.joined("spans").alias("s")).collect()
    assert {r.text: r.s for r in got} == probes


# ---- rule by rule ----------------------------------------------------------


def one_item(spark, item, *docs):
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return [r.contaminated for r in decontamination.mark_leaks(frame, spark.createDataFrame([(0, item)], "item_id long, text string")).orderBy("doc_id").collect()]


def test_short_items_other_case_and_longer_values(spark):
    assert one_item(spark, "What is the capital of France?", "So: What is the capital of France? I asked.", "what is the capital of france", "What is the price of France today") == [True, True, False]
    item = "Each morning the old baker Olga sells 25 rolls and walks 5km to the far market where Pavel buys half of the rest for 3 dollars."
    longer = item.replace("Olga", "Mary Ann").replace("25", "twenty five").replace("5km", "12 km")
    assert one_item(spark, item, longer, item.upper(), item.lower(), prose(random.Random(1), 80)) == [True, True, True, False]
    assert one_item(spark, "Yes.", "Yes.", "no") == [False, False]


def test_many_items_of_one_template(spark):
    """Items that differ in their values only, and windows that very many items share."""
    items = [(i, f"A farmer sells {i + 2} apples to {n} every day and then walks {i + 5} km home along the river road.") for i, n in enumerate(["Olga", "Pavel"] * 40)]
    items += [(100 + i, f"Solve the following problem step by step and give a short answer now: {prose(random.Random(i), 14)}") for i in range(60)]
    docs = [(0, "x y z. A farmer sells 99 apples to Ivo every day and then walks 7 km home along the river road."), (1, "Solve the following problem step by step and give a short answer now: what else"), (2, items[90][1])]
    got = {r.doc_id: r.item_ids for r in decontamination.mark_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got[0] == list(range(80)) and got[2] == [items[90][0]]


@pytest.mark.parametrize("sharing", [5, 33, 600])
def test_a_passage_that_many_items_share(spark, sharing):
    """However many items have a passage, a text that quotes it is found, and unlike items change nothing."""
    passage = prose(random.Random(99), 24)
    items = [(i, f"{passage}. {prose(random.Random(i), 28)}") for i in range(sharing)]
    unlike = [(10_000 + i, prose(random.Random(50_000 + i), 30)) for i in range(40)]
    docs = spark.createDataFrame([(0, f"{prose(random.Random(7), 60)} {passage} {prose(random.Random(8), 60)}"), (1, prose(random.Random(90_001), 120)), (2, " ".join(passage.split()[:12]))], "doc_id long, text string")
    for bench in (items, items + unlike):
        got = {r.doc_id: r.item_ids for r in decontamination.mark_leaks(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
        assert got == {0: list(range(sharing)), 1: [], 2: []}
    found = decontamination.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(r.item_id for r in found) == list(range(sharing)) and all(r.matched > 0 for r in found)


def test_numeric_and_short_lines(spark):
    texts = {1: "12 5 8 9\nRead more\nuser 7 of 9 logged in", 2: "7 44 1 3\nRead more\nuser 8 of 9 logged in", 3: "2020 1999 3 3\nother\n12 5 8 9"}
    gone = defaultdict(set)
    for r in line_dedup.dropped_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        gone[r.doc_id].add(r.line)
    assert gone == {2: {1, 2}, 3: {2}}


@pytest.mark.parametrize("unlike", [0, 300])
def test_fields_do_not_depend_on_the_leafs_other_lines(spark, unlike):
    """Families of two and of twelve, beside many other lines with the same opening and length."""
    rng = random.Random(5)
    texts = {i: f"It was seen that {rng.choice('abc')}{i}x the member {prose(rng, 1)} posted in this forum today" for i in range(12)}
    texts = {i: f"It was seen that the member {n} posted in this forum today" for i, n in enumerate(["ada", "bob", "cleo", "dan", "eva", "fay", "gus", "hal", "ida", "jon", "kay", "lee"])}
    texts |= {20: "It was seen that our good old crown of gold was sold", 21: "It was seen that our good old crown of tin was sold"}
    texts |= {100 + i: f"It was seen {prose(rng, 9)}" for i in range(unlike)}
    gone = {r.doc_id for r in line_dedup.dropped_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert gone == {*range(1, 12), 21}
