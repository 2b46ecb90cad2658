"""The text operators against brute force, round trips and planted cases."""

import hashlib
import io
import random
import re
import string
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import common, components, decontamination, jaccard_join, langid, line_dedup, packing, pii, quality, queries, rollups, tokens, toxicity, warc

WORDS = [a + b for a in ("ta", "lo", "mi", "ser", "ka", "ne") for b in ("ra", "no", "vel", "ti", "go", "lum")]
DOC = "doc_id long, text string, lang string, source string, n_chars long, language string, base string, dedup string"


def words(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(string.ascii_lowercase) for _ in range(n))


def frame(spark, texts):
    """Documents with extra columns whose names clash with those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in (texts.items() if isinstance(texts, dict) else enumerate(texts))], DOC)


ODD = [None, "", " \n\t", "word", "word " * 3, "\n\n\n", "a" * 5000, "ü🙂 ñ " * 50]


# ---- near duplicates -------------------------------------------------------


def brute_components(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            if k and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    base = [words(rng, n) for n in (8, 40, 90, 200)]
    texts = [*ODD, "One two", "ONE  two", "one two three four five", "One Two Three Four Five"]
    for b in base:
        for _ in range(14):
            w = b.split()
            for _ in range(rng.randrange(0, 1 + len(w) // 30)):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(" ".join(w))
    hot = words(rng, 30)
    texts += [f"{words(rng, rng.randrange(3, 60))} {hot} {words(rng, 20)}" for _ in range(30)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(frame(spark, dict(rows))).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_over_small_nodes(spark):
    rng = random.Random(6)
    b = words(rng, 80).split()
    rows = []
    for i in range(40):
        w = list(b)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(80)] = words(rng, 1)
        rows.append((i, " ".join(w)))
    _, links = jaccard_join.similar_links(frame(spark, dict(rows)), node_docs=6)
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == {d: c for d, (_, c) in brute_components(rows).items()}


def test_near_duplicates_of_no_and_repeated_rows(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    df = frame(spark, {3: "a b c d e f", 1: "a b c d e f"})
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(df.unionByName(df)).collect()) == [(1, 2, 1), (1, 2, 1), (3, 2, 1), (3, 2, 1)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 51), 0), **dict.fromkeys(range(101, 140), 100)}


# ---- tokens, packing, rollups ----------------------------------------------


@pytest.fixture(scope="module")
def plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_segment_ids_equal_the_tokenizers(plain_tokenizer):
    rng = random.Random(1)
    coder = tokens.SegmentEncoder(tokens.vocabulary())
    texts = [x or "" for x in ODD] + ["  a  b \n c\n\n d  ", "don't it's 's <|endoftext|> ok", " lead", "x  y  z", "1 22 333 $4 %%% x_y"]
    texts += ["".join(rng.choice("ab  \n\t.,'é1") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        assert coder.ids(t).tolist() == plain_tokenizer.encode(t, add_special_tokens=False).ids


def test_packing_is_whole_and_gapless(spark, plain_tokenizer):
    rng = random.Random(2)
    texts = [*ODD, words(rng, 1500), *(words(rng, rng.randrange(1, 300)) for _ in range(60))]
    rows = packing.pack(frame(spark, texts)).toPandas()
    for i, t in enumerate(texts):
        ids = np.array([*plain_tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length <= 1024).all() and (own.length[1:] == 1024).all()
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        assert own.ids_crc32.tolist() == [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(own.start, own.length)]
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own.offset.tolist() == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
    assert rows.sequence_id.nunique() <= -(-rows.length.sum() // 1024) + 1


def test_packing_of_no_rows(spark):
    assert packing.pack(spark.createDataFrame([], DOC)).count() == 0


def least_bins(lengths, capacity):
    """Fewest bins by trying all ways."""
    best = len(lengths)

    def go(rest, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not rest:
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + rest[0] <= capacity and bins[i] not in bins[:i]:
                go(rest[1:], [*bins[:i], bins[i] + rest[0], *bins[i + 1 :]])
        go(rest[1:], [*bins, rest[0]])

    go(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(12))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = random.Random(seed)
    lengths = [rng.randrange(1, 31) for _ in range(10)]
    plan = packing.complete_bins(Counter(lengths), 30)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 30
        for x in filling:
            used[x] += times
    assert used == Counter(lengths)
    assert sum(n for _, n in plan) == least_bins(lengths, 30)
    assert packing.lower_bound(np.bincount(lengths, minlength=31), 30) <= sum(n for _, n in plan)


def test_branching_beats_best_fit():
    """Best fit takes four sequences here, and dominated fillings are left out."""
    lengths = [44, 24, 24, 22, 21, 17, 8, 8, 6, 6]
    assert sum(n for _, n in packing.complete_bins(Counter(lengths), 60)) == 3
    assert packing.dominates((8, 8), (8, 6)) and packing.dominates((9, 5), (5, 4, 4)) and not packing.dominates((9, 5), (7, 7))
    counts = np.bincount(lengths, minlength=61)
    ways = packing.fillings(counts, 16)
    assert all(not packing.dominates(a, b) for a in ways for b in ways if a != b)


@pytest.mark.parametrize("seed", range(6))
def test_random_packings_come_near_the_bound(seed):
    rng = random.Random(100 + seed)
    lengths = Counter(rng.randrange(1, 1025) for _ in range(3000))
    plan = packing.complete_bins(lengths, 1024)
    used = Counter()
    for filling, times in plan:
        assert sum(filling) <= 1024
        for x in filling:
            used[x] += times
    assert used == lengths
    assert sum(n for _, n in plan) <= 1.01 * packing.lower_bound(np.array([lengths[i] for i in range(1025)]), 1024) + 1


def test_repeated_rows_count_once_and_compaction_changes_nothing(spark, plain_tokenizer):
    line = "same line\nsame line\nother line"
    df = spark.createDataFrame([(1, line, "en", "s"), (1, line, "en", "s"), (2, "a b c", "en", "s"), (1, "a b c", "de", "t"), (3, None, None, None), (3, None, None, None)], "doc_id long, text string, lang string, source string")
    store = rollups.maintain_counts(df)
    count = lambda t: len(plain_tokenizer.encode(t, add_special_tokens=False).ids)
    want = {("s", "en"): (1, count("same line\nother line")), ("t", "de"): (1, count("a b c")), (None, None): (2, 0)}
    totals = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert totals == want
    store.compact()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()} == want
    assert rollups.maintain_counts(df.limit(0), store=store) is store and not store.commit("1-insert", df)
    more = spark.createDataFrame([("t", "de", "byte_bpe_50k", -1, -count("a b c"))], "source string, lang string, tokenizer string, docs int, tokens long")
    assert store.commit("4-delete", more)
    store.compact()
    assert {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()} == {**want, ("t", "de"): (0, 0)}


def test_rollups_are_signed_and_idempotent(spark, plain_tokenizer):
    rng = random.Random(3)
    a, b = words(rng, 30), "same line\nsame line\nother line"
    texts = [a, a, b, None, "", a]
    df = frame(spark, texts)
    store = rollups.maintain_counts(df)
    count = lambda t: len(plain_tokenizer.encode(t or "", add_special_tokens=False).ids)
    total = store.totals().first()
    assert (total.source, total.lang, total.n_docs) == ("s", "en", 4)
    assert total.n_tokens == count(a) + count("same line\nother line")
    before = [tuple(r) for r in store.totals().collect()]
    again = spark.createDataFrame([("s", "en", "byte_bpe_50k", 1, 10**6)], "source string, lang string, tokenizer string, docs int, tokens long")
    assert not store.commit("1-insert", again)
    assert [tuple(r) for r in store.totals().collect()] == before
    assert store.commit("4-more", again) and store.totals().first().n_tokens == total.n_tokens + 10**6
    assert rollups.maintain_counts(spark.createDataFrame([], DOC)).totals().count() == 0


# ---- archives --------------------------------------------------------------


def test_archives_give_back_every_page(spark):
    pages = [(1, "http://a", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (9, None, "<p>é</p>"), (3, "x y", None), (4, "", ""), (5, "http://c", "z" * 50_000), (5, "http://c", "z" * 50_000), (7, "u", "one"), (7, "u", "other"), (8, "v", "other")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    archives = warc.write_archives(df, archive_bytes=300)
    records = warc.read_records(warc.locate_records(archives), archives)
    got = sorted(tuple(r) for r in records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(i, last.get(h or "", 0))
    want = [(i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), "response" if last[h or ""] == i else "revisit", None if last[h or ""] == i else last[h or ""]) for i, _, h in pages]
    assert got == sorted(want)
    assert warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_small_payloads_are_never_revisits(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x")], "page_id long, url string, html string")
    archives = warc.write_archives(df, least_revisit=2)
    records = warc.read_records(warc.locate_records(archives), archives)
    assert {r.record_type for r in records.collect()} == {"response"}


def test_directory_with_zip64_fields():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        with z.open(zipfile.ZipInfo("a/b.bin"), "w", force_zip64=True) as m:
            m.write(b"hello")
        z.writestr("c.txt", "there")
    members = warc.read_directory(data, len(data.getvalue()))
    start = warc.member_start(data, members["a/b.bin"])
    assert data.getvalue()[start : start + members["a/b.bin"].size] == b"hello"
    # The same directory behind a ZIP64 end record and locator, with the plain end record's values marked as elsewhere.
    raw = data.getvalue()
    at = raw.rfind(warc.END)
    count, length, begin = struct.unpack("<HII", raw[at + 10 : at + 20])
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, length, begin)
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, at, 1)
    big = raw[:at] + end64 + locator + warc.END + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.read_directory(io.BytesIO(big), len(big)) == members
    with pytest.raises(ValueError, match="not a ZIP"):
        warc.read_directory(io.BytesIO(b"x" * 100), 100)


# ---- languages and toxicity ------------------------------------------------


def test_language_profiles(spark, small):
    docs = common.table(spark, small, "documents")
    profiles = langid.learn_profiles(langid.learning_rows(docs))
    got = langid.identify(docs, profiles).select("doc_id", "lang", "language.*").toPandas()
    held = got[[zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]]
    assert (held.lang == held.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()
    odd = langid.identify(frame(spark, [*ODD, "12 34 !!"]), profiles).select("doc_id", "language.lang_pred").collect()
    und = {r.doc_id for r in odd if r.lang_pred == "und"}
    assert und == {0, 1, 2, 5, 8}
    nothing = langid.learn_profiles(spark.createDataFrame([], DOC))
    assert {r.lang_pred for r in langid.identify(frame(spark, ["text"]), nothing).select("language.lang_pred").collect()} == {"und"}
    assert "language" not in [c for c in langid.accepted(docs, profiles).columns]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_automata_find_all_terms_in_reach():
    rng = random.Random(4)
    terms = {"".join(rng.choice("abcde") for _ in range(rng.randrange(3, 13))): rng.random() + 0.1 for _ in range(60)}
    lexicon = toxicity.FuzzyLexicon(terms)
    for _ in range(1500):
        word = list(rng.choice(list(terms)))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "c", "e"])
        word = "".join(word)
        near = [(distance(word, t), -w) for t, w in terms.items() if 0 < toxicity.edits_of_length(len(t)) >= distance(word, t)]
        want = min(near, default=None)
        assert lexicon.match(word) == ((-want[1], want[0]) if want else (0.0, 0))


def test_misspelt_stems_and_forms_of_stems_are_found():
    lexicon = toxicity.Lexicon({"idiot": 4.0, "idiotic": 3.0}, {"idio": 3.5, "moron": 5.0})
    assert [lexicon.weigh_word(w) for w in ("ediot", "iddiot", "idjotic")] == [(4.0, 1), (4.0, 1), (3.0, 1)]
    assert [lexicon.weigh_word(w) for w in ("morronish", "maronically", "moderate", "table")] == [(5.0, 1), (5.0, 1), (0.0, 0), (0.0, 0)]


def test_stems_are_found_at_the_beginning_of_all_words_in_reach():
    rng = random.Random(16)
    stems = {"".join(rng.choice("abcde") for _ in range(rng.randrange(4, 12))): rng.random() + 0.1 for _ in range(40)}
    lexicon = toxicity.FuzzyLexicon(stems, beginning=True)
    for _ in range(800):
        word = list(rng.choice(list(stems)) + "".join(rng.choice("abcde") for _ in range(rng.randrange(5))))
        for _ in range(rng.randrange(0, 4)):
            k = rng.randrange(len(word) + 1)
            word[k : k + rng.randrange(0, 2)] = rng.choice(["", "a", "c", "e"])
        word = "".join(word)
        reach = [(min(distance(word[:n], t) for n in range(len(word) + 1)), -w, t) for t, w in stems.items()]
        want = min(((d, w) for d, w, t in reach if d <= toxicity.edits_of_length(len(t)) > 0), default=None)
        assert lexicon.match(word) == ((-want[1], want[0]) if want else (0.0, 0))


def test_misspellings_of_rare_terms_are_found(spark):
    """Terms in few of the toxic texts each, and more of them than 150."""
    rng = random.Random(17)
    terms = ["".join(rng.choice(string.ascii_lowercase) for _ in range(10)) for _ in range(300)]
    rows = [(i, f"{words(rng, 10)} {' '.join(rng.sample(terms, 8)) if i % 2 else ''}", i % 2, str(i)) for i in range(1200)]
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "doc_id long, text string, toxic int, digest string"))
    assert len(set(terms) & set(lexicon.terms)) > 150
    assert all(lexicon.weigh_word(t[:4] + "ü" + t[5:])[1] == 1 for t in terms if t in lexicon.terms)


def test_copies_shift_no_gains(spark):
    """A lexicon of texts with many copies, some under both labels, is that of the distinct texts."""
    rng = random.Random(18)
    rows = [(f"{words(rng, 10)} {'nitwit' if i % 2 and i % 5 else ''}", i % 2, str(i)) for i in range(200)]
    rows += [(*rows[0][:1], 1, rows[0][2])]
    copied = rows + [rows[1]] * 900 + [rows[0]] * 100
    learned = [toxicity.learn_lexicon(spark.createDataFrame(x, "text string, toxic int, digest string").withColumn("doc_id", F.monotonically_increasing_id())) for x in (rows, copied)]
    assert learned[0].terms == learned[1].terms and "nitwit" in learned[0].terms
    bad, good = 101, 100
    assert learned[1].terms["nitwit"] == pytest.approx(np.log((80 + 0.5) / (bad + 1)) - np.log(0.5 / (good + 1)))


def test_toxicity_learns_words_and_misspellings(spark):
    rng = random.Random(7)
    texts, labels = {}, []
    for i in range(400):
        toxic = i % 4 == 0
        w = words(rng, 40).split()
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "dimwitted"]))
        texts[i] = " ".join(w)
        labels.append((i, 1, int(toxic)))
    docs, marks = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    held = [i for i in texts if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == (i % 4 == 0) for i in held]) > 0.97
    extra = frame(spark, [*ODD, "you blockhaed dimwited nitwitt you blokhead", "plain words only"])
    scored = {r.doc_id: r.toxicity for r in toxicity.score(extra, model).collect()}
    assert scored[8] > 0.5 > scored[9] and all(0 <= x <= 1 for x in scored.values())
    none = toxicity.learn(spark.createDataFrame([], DOC), marks)
    assert toxicity.score(extra, none).count() == 10


def test_misspellings_raise_and_quotes_lower_the_score_after_learning(spark):
    """Clean documents quote the terms too, as in reports of abuse."""
    rng = random.Random(19)
    texts, labels = {}, []
    for i in range(600):
        w, term = words(rng, 30).split(), rng.choice(["blockhead", "nitwit", "dimwitted"])
        if i % 4 == 0:
            w[10:10] = [term, "you", term]
        elif i % 60 == 5:
            w[10:10] = ["they", "wrote", f'"{term}"', "in", "the", "report"]
        texts[i] = " ".join(w)
        labels.append((i, 1, int(i % 4 == 0)))
    model = toxicity.learn(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert all(x >= 0 for x in model.weights[:3]) and model.weights[3] <= 0
    base = words(rng, 12)
    cases = [f"{base} {words(rng, 12)}", f"{base} you blockhaed and nitwitt {words(rng, 12)}", f"{base} you blockhead and nitwit {words(rng, 12)}", f'{base} they wrote "blockhead" in the report {words(rng, 12)}', f"{base} you blockhead {words(rng, 12)}"]
    clean, misspelt, plain, quoted, unquoted = (r.toxicity for r in toxicity.score(frame(spark, cases), model).orderBy("doc_id").collect())
    assert misspelt > 0.5 > clean and misspelt == pytest.approx(plain, abs=0.2)
    assert quoted < unquoted and quoted < 0.5


def test_misspellings_near_clean_words_of_other_terms_keep_their_weight(spark):
    """Clean rows have words near one term; that term's misspellings lose their trust, another's don't."""
    lexicon = toxicity.Lexicon({"worthless": 7.0, "grumpyish": 4.0})
    rows = [(f"plain grumqyish text {i}" if i % 3 else f"plain text {i}", 0, str(i)) for i in range(60)] + [(f"you grumpyish one {i}", 1, f"t{i}") for i in range(20)]
    lexicon.reliability = toxicity.learn_reliability(spark.createDataFrame(rows, "text string, toxic int, digest string"), lexicon)
    assert set(lexicon.reliability) == {(1, 4.0)} and lexicon.trust(4.0, 1) < 0.05 and lexicon.trust(7.0, 1) == 1 == lexicon.trust(4.0, 0)
    assert lexicon.features("a wothless thing")[1] == 7.0 and lexicon.features("a grumqyish thing")[1] < 0.2
    assert lexicon.features('he wrote "wothless" here')[1] == 0
    assert toxicity.learn_reliability(spark.createDataFrame([], "text string, toxic int, digest string"), lexicon) == {}


def test_words_of_near_copies_are_no_terms(spark):
    rng = random.Random(20)
    copied = words(rng, 40).split()
    rows = [(words(rng, 20), 0, str(i)) for i in range(150)]
    rows += [(" ".join([*copied[:k], words(rng, 1), *copied[k + 1 :]]), 1, f"c{k}") for k in range(40)]
    rows += [(f"{words(rng, 10)} nitwit {words(rng, 10)}", 1, f"n{i}") for i in range(20)]
    assert set(toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int, digest string")).terms) == {"nitwit"}


def test_quoted_terms_weigh_apart():
    lexicon = toxicity.Lexicon({"nitwit": 3.0})
    plain, quoted = lexicon.features("he is a nitwit for sure"), lexicon.features('he wrote "a nitwit" once')
    assert plain[0] > 0 == plain[3] and quoted[0] == 0 < quoted[3]


# ---- lines and benchmark ---------------------------------------------------


def test_recurring_lines_stay_once(spark):
    rng = random.Random(8)
    boiler, passage = "Subscribe to our weekly letter", words(rng, 60)
    texts = {i: "\n".join([words(rng, 80), boiler, words(rng, 80), *([passage] if i in (3, 5) else [])]) for i in range(10)}
    texts[20], texts[21], texts[22] = None, "", "\n\n"
    out = {r.doc_id: r for r in line_dedup.deduplicate_lines(frame(spark, texts)).collect()}
    assert boiler in out[0].text and not any(boiler in out[i].text for i in range(1, 10))
    assert passage in out[3].text and passage not in out[5].text
    assert out[5].dedup.n_dropped == 2 and out[0].text == texts[0] and [out[i].text for i in (20, 21, 22)] == [None, "", "\n\n"]
    assert out[4].text == "\n".join(x for x in texts[4].split("\n") if x != boiler)
    assert line_dedup.deduplicate_lines(spark.createDataFrame([], DOC)).count() == 0


def test_fields_vary_within_a_template(spark):
    rng = random.Random(9)
    names = [f"user{w}" for w in words(rng, 12).split()]
    texts = {i: "\n".join([words(rng, 50), f"Posted in general by {names[i]} of the forum today at {i}:30", f"Page {i} of 99 pages", words(rng, 50)]) for i in range(12)}
    gone = defaultdict(set)
    for r in line_dedup.dropped_lines(frame(spark, texts)).collect():
        gone[r.doc_id].add(r.line)
    assert not gone[0] and all(gone[i] == {1, 2} for i in range(1, 12))


@pytest.mark.parametrize("shared", [60, 80])
def test_a_shared_passage_stays_once_whatever_the_overlap(spark, tmp_path, shared):
    """Pairs at 0.43 and 0.67 of their words, which the near-duplicate rule does not link."""
    rng = random.Random(15)
    passage = words(rng, shared)
    docs = frame(spark, {i: "\n".join([words(rng, 100 - shared), passage]) for i in (1, 2)})
    assert jaccard_join.near_duplicates(docs).where("component_id <> doc_id").count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n_dropped for r in queries.op1_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1}
    staged = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, str(tmp_path)).collect()}
    assert passage in staged[1] and passage not in staged[2]


def test_leaks_with_other_values(spark):
    item = "A farmer named Olga sells 12 apples and 7 pears each day to Pavel, who pays 3 dollars for every bag of 5 km delivery on time."
    other = item.replace("Olga", "Mara").replace("Pavel", "Igor").replace("12", "40").replace("7 pears", "9 pears")
    broken = "A farmer named Olga gave Olga and the seller Olga ten pears, and later Olga saw that Olga had left."
    bench = spark.createDataFrame([(0, item), (1, broken), (2, None), (3, "too short")], "item_id long, text string")
    rng = random.Random(11)
    texts = [f"{words(rng, 20)}. {item} {words(rng, 20)}", f"{words(rng, 20)}. {other} {words(rng, 9)}", words(rng, 200), item.upper(), *ODD, broken.replace("Olga", "Ivo", 1)]
    got = {r.doc_id: (r.contaminated, r.item_ids) for r in decontamination.mark_leaks(frame(spark, texts), bench).collect()}
    assert got[0] == (True, [0]) and got[1] == (True, [0]) and got[2] == (False, [])
    assert not any(got[i][0] for i in range(4, 12)) and not got[12][0]
    kept = {r.doc_id for r in decontamination.decontaminate(frame(spark, texts), bench).collect()}
    assert kept == {i for i, (c, _) in got.items() if not c}
    assert decontamination.mark_leaks(frame(spark, texts), bench.limit(0)).where("contaminated").count() == 0


# ---- quality and personal data ---------------------------------------------


def brute_base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = defaultdict(list)
    for j in range(len(w) - 2):
        at[tuple(w[j : j + 3])].append(j)
    covered = {k for v in at.values() if len(v) > 1 for j in v for k in (j, j + 1, j + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_base_statistics_equal_brute_force(spark):
    rng = random.Random(12)
    texts = [*ODD, "a b c a b c", "a a a a", "x\nx\ny\n\n \nx", "# $ % <|> &*", *("".join(rng.choice("ab \n# é") for _ in range(rng.randrange(90))) for _ in range(60))]
    got = {r.doc_id: tuple(r.base) for r in quality.base_statistics(frame(spark, texts)).select("doc_id", "base").collect()}
    assert got == {i: brute_base(t) for i, t in enumerate(texts)}


def test_decision_lists_learn_thresholds(spark):
    rng = random.Random(13)
    texts = {i: words(rng, 120) if i % 3 else " ".join(w + "%%%" for w in words(rng, 120).split()) for i in range(300)}
    docs, labels = frame(spark, texts), spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in texts], "doc_id long, quality int, toxic int")
    stats = quality.with_statistics(docs)
    rules = quality.learn_rules(stats.select("doc_id", "stats"), labels)
    kept = {r.doc_id: r.kept for r in quality.judge(stats, rules).collect()}
    assert kept == {i: i % 3 > 0 for i in texts} and len(rules.rules) == 1
    assert quality.learn_rules(stats.select("doc_id", "stats"), labels.limit(0)).rules == ()
    assert quality.judge(quality.with_statistics(frame(spark, ODD)), rules).count() == len(ODD)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m.group()))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(14)
    pieces = ["a@b.co", "x@y", "a@b.c_d@e.f.", "@", "1.2.3.4", "300.1.1.1", "001.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+1 (132) 555-1352", "+12", "🙂é", " ", "\n", "-", "..", "99", "+"]
    texts = [*ODD, "a@b" * 3000, "1.2." * 4000, "1" * 20_000, *("".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25))) for _ in range(150)), " ".join(["q@w.er 10.0.0.1"] * 700)]
    df = pii.with_base_spans(frame(spark, texts)).select("doc_id", pii.joined("base_spans").alias("s"))
    assert {r.doc_id: r.s for r in df.collect()} == {i: brute_spans(t) for i, t in enumerate(texts)}


def test_detection_keeps_base_spans_and_redacts(spark, small):
    """With a model that selects every proposal; of proposals that meet, one stays."""
    everything = pii.Boosted((0.5,), (1.0,), dict.fromkeys(pii.KINDS, 0.0))
    for r in pii.detect(common.table(spark, small, "documents"), everything).select("base_spans", "spans").collect():
        base, found = [tuple(x)[:3] for x in r.base_spans], [tuple(x) for x in r.spans]
        assert set(base) <= set(found)
        added = sorted((a, b) for k, a, b in found if (k, a, b) not in base)
        assert all(x[1] <= y[0] for x, y in zip(added, added[1:])) and not any(a < y and x < b for a, b in added for _, x, y in base)
    plain = pii.Boosted((), (), {})
    out = pii.redact(frame(spark, ["mail me@x.org or +1 (132) 555-1352 now", None, "none"]), plain).orderBy("doc_id").collect()
    assert [r.text for r in out] == ["mail [EMAIL] or [PHONE] now", None, "none"]


def test_boosted_trees_are_the_fitted_ones(spark):
    """Trees as conditional expressions give what the fitted model's margin is."""
    m = pii.Boosted(((0, 1.5, 1.0, (1, 10.0, -1.0, 0.5)), 0.25), (1.0, 2.0), {"email": 0.0})
    rows = [{"kind_no": a, "chars": b} for a, b in ((1.0, 99.0), (2.0, 5.0), (2.0, 50.0))]
    df = spark.createDataFrame([tuple({**dict.fromkeys(pii.FEATURES, 0.0), **r}.values()) for r in rows], ", ".join(f"{f} double" for f in pii.FEATURES))
    assert [r[0] for r in df.select(m.margin(F.struct(*pii.FEATURES))).collect()] == [1.5, -0.5, 1.0]


def test_a_kinds_margin_is_not_paid_for_by_easy_proposals():
    """Many right ones at the top, wrong ones below; too few; and margins under even odds."""
    easy, wrong = (4.0, 900, 900, 900.0, 900.0), (1.0, 5, 30, 5.0, 30.0)
    assert pii.lowest_margin([easy, wrong], 0.95, 20, 25) == 2.5
    assert pii.lowest_margin([easy, (2.0, 40, 40, 40.0, 40.0), wrong], 0.95, 20, 25) == 1.5
    assert pii.lowest_margin([(4.0, 19, 19, 19.0, 19.0)], 0.95, 20, 25) is None
    assert pii.lowest_margin([easy, (-0.5, 900, 900, 900.0, 900.0)], 0.95, 20, 25) == 2.0
    assert pii.lowest_margin([], 0.95, 20, 25) is None


def test_additions_pass_their_kinds_check(spark):
    """Even a model that selects everything adds no parts of secrets, no cards that fail Luhn, no addresses above 255."""
    everything = pii.Boosted((0.5,), (1.0,), dict.fromkeys(pii.KINDS, 0.0))
    cases = {"card 4111.1111.1111.1111 ok": "card:5:24", "card 4111.1111.1111.1112 no": "", 'token = "ede43f42c939b6405768150aa"': "", "isbn 978 3161 484100 4": "", "x5d190bd7c06284de91015a36974748794293dd8a": "", "on 10[.]0[.]0[.]1 now": "ip:3:17", "on 10[.]0[.]300[.]1 now": "", "1 dot 2 dot 3 dot 4": "ip:0:19", "2001:db8:0:0:1:2:3:4 up": "ip:0:20"}
    out = pii.detect(frame(spark, list(cases)), everything).select("text", pii.joined(F.filter("spans", lambda x: x["kind"] != "phone")).alias("s"))
    assert {r.text: r.s for r in out.collect()} == cases


def test_base32_digest():
    assert warc.base32_sha1(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and len(hashlib.sha1(b"").digest()) == 20
