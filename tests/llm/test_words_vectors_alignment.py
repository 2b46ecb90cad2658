"""Spelling variants, nearest neighbours and tokenizer alignment against plain loops, and their odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tideline.llm import alignment, neighbours, packing, queries, spelling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_words(rows) -> dict[str, int]:
    c = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            c[run] += 1
    return {w: n for w, n in c.items() if len(w) >= 6 and n >= 5}


def brute_variants(rows) -> set[tuple]:
    words = brute_words(rows)
    shorter = defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            shorter[x].add(w)
    near = {w: {y for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))} for y in shorter[x] if one_edit(w, y)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda y: (-words[y], y), default=None)
        if best and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def variants(df) -> set[tuple]:
    rows = [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_of_the_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = brute_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert variants(queries.op11_spelling_variants(spark, small)) == want
    assert any(x[1] for x in want)


@pytest.mark.parametrize("most", [3, 7, 1 << 14])
def test_variants_with_planted_words_and_hot_keys(spark, most):
    planted = {"colour": 300, "color": 9, "colours": 40, "colouur": 5, "coulour": 5, "xolour": 6, "colouz": 7, "aaaaaa": 25, "aaaaaaa": 5, "straße": 6, "strasse": 30, "straßen": 6, "àéîõüÿ": 30, "àéîõüx": 6, "ÀÉÎÕÜX": 5, "prefixa": 50, "prefixb": 8, "prefixc": 8, "qrefixa": 8, "prefix": 260}
    rows = [(i, f"{w}, " * n) for i, (w, n) in enumerate(planted.items(), 1)] + [(None, "Prefixa prefixa"), (99, None), (98, ""), (97, "ab cd 12"), (96, "z" * 30_000 + " " + "y" * 7)]
    want = brute_variants([(i, t) for i, t in rows if i is not None])
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, word string")
    got = variants(spelling.group_variants(docs.where("doc_id is not null"), most=most))
    assert got == want
    forms = {x[0]: x[1] for x in got}
    assert forms["xolour"] == "colour" and forms["prefixb"] == "prefix" and forms["strasse"] is None


def test_variants_of_nothing(spark):
    assert spelling.group_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_index_finds_all_random_words():
    rng = np.random.default_rng(5)
    words = sorted({"".join(rng.choice(list("abcé"), rng.integers(6, 10))) for _ in range(1500)})
    found = set()
    for forward in (True, False):
        q, w = spelling.near_words(words, words, forward)
        pairs = list(zip(q.tolist(), w.tolist(), strict=True))
        assert len(pairs) == len(set(pairs)) and not found & set(pairs)
        found |= set(pairs)
    assert found == {(i, j) for i, a in enumerate(words) for j, b in enumerate(words) if abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def brute_nearest(rows, asked, k=5):
    out = {}
    for q, v in asked:
        best = {}
        for i, x in rows:
            if i != q:
                s = float(np.dot(v, x) / np.sqrt(np.dot(v, v) * np.dot(x, x)))
                best[i] = max(best.get(i, -2.0), s)
        out[q] = sorted(best.items(), key=lambda y: (-round(y[1], 12), y[0]))[:k]
    return out


def test_neighbours_of_the_table(spark, small):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = brute_nearest(rows, [x for x in rows if x[0] % 50 == 0])
    got = defaultdict(list)
    for r in queries.op12_nearest_neighbours(spark, small).orderBy("query_id", "rank").collect():
        assert abs(r["score"] - dict(brute_nearest(rows, [next(x for x in rows if x[0] == r["query_id"])], len(rows))[r["query_id"]])[r["vec_id"]]) < 1e-12
        got[r["query_id"]].append(r["vec_id"])
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    assert sum(len({i for i, _ in want[q]} & set(got[q])) for q in want) >= 0.9 * 5 * len(want)


def test_neighbours_with_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(1000 + i, base[0].tolist()) for i in range(300)] + [(2000, (2 * base[0]).tolist()), (2001, (base[1] * 1e160).tolist())]
    odd = [(None, base[3].tolist()), (50, None), (100, [0.0] * 8), (150, [1.0, float("nan")] + [0.0] * 6), (3000, [float("inf")] * 8), (3001, [None] + [1.0] * 7), (3002, [1.0]), (3003, [])]
    rows = [x for x in rows if x[0] not in (50, 100, 150)]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows + odd], "vec_id long, embedding array<double>, score double")
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 50 = 0"), neighbours.Settings(block=64, chunk=3, recall=1.0, per_cell=4)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    scaled = [(i, np.array(v) / np.abs(v).max()) for i, v in rows]
    want = brute_nearest(scaled, [x for x in scaled if x[0] % 50 == 0])
    assert got.keys() == want.keys()
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004] and [i for i, _ in got[2000]][:2] == [0, 1000]
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [1.0, 1.0]), (7, [0.0, 1.0]), (8, [0.0, 2.0])], "vec_id long, embedding array<float>")
    got = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in neighbours.nearest(df, df.where("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 7, round(0.5**0.5, 9)), (2, 8, 0.0)]
    assert neighbours.nearest(df.limit(0), df).count() == 0
    assert neighbours.nearest(df, df.limit(0)).count() == 0


def brute_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    a_bytes = alignment.byte_table(a_coder.get_vocab(), 50_257)
    b_bytes = alignment.piece_table(b_coder)
    counts, found = Counter(), []
    for i, text in rows:
        groups, links, n_links, a, b = [], Counter(), 0, [], []
        if text:
            whole, a, b = (" " + text).encode(), a_coder.encode(" " + text, add_special_tokens=False).ids, b_coder.encode(text)
            if b"".join(a_bytes[x] for x in a) != whole or b"".join(b_bytes[x] for x in b) != whole:
                a, b = [], []
        ends_a, ends_b = (np.cumsum([len(t[x]) for x in ids]).astype(int).tolist() for t, ids in ((a_bytes, a), (b_bytes, b)))
        own_a, own_b, at = [], [], 0
        shared = set(ends_a) & set(ends_b)
        for x, end in zip(a, ends_a, strict=True):
            own_a.append(x)
            if end in shared:
                while at < len(b) and ends_b[at] <= end:
                    own_b.append(b[at])
                    at += 1
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                n_links += len(own_a) * len(own_b)
                links.update((p, q) for p in own_a for q in own_b)
                own_a, own_b = [], []
        counts.update(links.keys())
        found.append((i, len(a), len(b), len(groups), n_links, links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return sorted((i, a, b, g, n, sum(m for k, m in links.items() if counts[k] == most[k[0]]), sum(m * counts[k] for k, m in links.items()), digest) for i, a, b, g, n, links, digest in found)


ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_the_table(spark, small):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(tuple(r[c] for c in ALIGNED) for r in queries.op13_tokenizer_alignment(spark, small).collect()) == brute_alignment(rows)


@pytest.mark.parametrize("hot_pairs", [0, 5, 1 << 17])
def test_alignment_of_odd_texts(spark, hot_pairs):
    texts = [None, "", " ", "  two  spaces ", "\n\tlines\r\n\n  and\ttabs   x", "a<|endoftext|>b <s> </s> <unk>", "▁ literal mark", "日本語のテキスト and English", "emoji 👩‍👩‍👧 ½ ﬁ", "\x00\x01 control", "word", "word", "internationalisation " * 300, "x" * 20_000, "naïve café coöperate", "a   b c"]
    rows = list(enumerate(texts)) + [(3, "  two  spaces ")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, pairs int").repartition(3)
    got = alignment.align_tokenizers(df, *alignment.paths(), hot_pairs=hot_pairs)
    assert sorted(tuple(r[c] for c in ALIGNED) for r in got.collect()) == brute_alignment(rows)
    assert alignment.align_tokenizers(df.limit(0), *alignment.paths()).count() == 0


def test_long_windows_are_counted(spark):
    coder = alignment.Aligner(*alignment.paths())
    key = coder.encode(["supercalifragilistic"])[0][0]
    shown, n_a, n_b, groups, links, pairs, times = coder.window(key)
    other = coder.windows_of([key])[0]
    assert (shown, n_a, n_b, groups, links) == other[:5]
    assert dict(zip(*(np.frombuffer(x, "<i8").tolist() for x in (pairs, times)), strict=True)) == Counter(np.frombuffer(other[5], "<i8").tolist())


def fewest(pieces: list[int], capacity: int) -> int:
    """Exact, over all subsets: sequences and what the last one holds."""
    best = [(0, capacity)] + [(99, 0)] * ((1 << len(pieces)) - 1)
    for mask in range(len(best)):
        n, held = best[mask]
        for i, x in enumerate(pieces):
            if not mask >> i & 1:
                after = (n, held + x) if held + x <= capacity else (n + 1, x)
                best[mask | 1 << i] = min(best[mask | 1 << i], after)
    return best[-1][0]


def test_packing_finds_the_fewest_or_says_so(caplog):
    rng = np.random.default_rng(12)
    for _ in range(700):
        capacity = int(rng.integers(20, 70))
        pieces = rng.integers(3, max(5, capacity * 2 // 3), rng.integers(6, 11)).tolist()
        caplog.clear()
        plan = packing.complete_bins(Counter(pieces), capacity)
        assert sorted(x for f, n in plan for x in f * n) == sorted(pieces) and all(sum(f) <= capacity for f, _ in plan)
        assert sum(n for _, n in plan) == fewest(pieces, capacity) or caplog.records
        assert not caplog.records
    hard = [30, 30, 27, 25, 21, 20, 16, 16, 15, 11, 10, 8, 5, 5]
    assert sum(n for _, n in packing.complete_bins(Counter(hard), 60)) == 4
    caplog.clear()
    assert sum(n for _, n in packing.complete_bins({400: 3000, 350: 1}, 1024, nodes=5)) >= 1500 and caplog.records
