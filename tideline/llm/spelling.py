"""Spelling variants: words one edit apart, found with bidirectional FM-indexes.

Words that are one insertion, deletion or replacement apart agree in one half
of either: the search matches a half exactly from the middle to the word's
delimiter, turns, and extends across the other half allowing one error.

A half has three code points at least, so words that meet by their first half
share their first three, and by their second half their last three. That deals
words out: an index is made of the words whose keys fall into one bucket, and
they are its queries. Keys with more than ``most`` words are cut into a grid of
index shards by query chunks, so no task holds more than about ``most`` of either.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import drop_table, drop_tables, stage_table

LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END, GAP = 0, 1  # codes of the text's end and of the delimiter; letters follow
BLOCK = 32
MOST_WORDS = 1 << 14
QUERIES = 1 << 13  # patterns that are walked together
NEAR = "word string, n_near long, best_n long, best string"


def corpus_words(docs: DataFrame, least_length: int = 6, least: int = 5, typo: int = 199) -> DataFrame:
    """word and n: runs of letters, A-Z lowered, of at least some code points that occur often enough.

    Runs whose crc32 with their document's id is divisible by ``typo`` lose one
    code point, so the corpus has known misspellings. Null texts have no words;
    rows with one doc_id are counted each; with a null doc_id no run is changed.
    Runs too short to leave a word are not looked at.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(text, F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.col("doc_id").cast("string").alias("d"), run.alias("run"))
    h = F.crc32(F.concat("d", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    changed = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(h % typo == 0, changed).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


@dataclass
class Ranks:
    """One direction's index: the Burrows-Wheeler transform, and before each block of it how many letters are below each code."""

    suffixes: np.ndarray
    blocks: np.ndarray
    below: np.ndarray
    total: np.ndarray

    @classmethod
    def of(cls, text: np.ndarray, letters: int) -> Ranks:
        suffixes = suffix_array(text)
        bwt = text[suffixes - 1].astype(np.uint8 if letters < 255 else np.int32)
        n = len(text) // BLOCK + 1
        blocks = np.full(n * BLOCK, letters, bwt.dtype)
        blocks[: len(bwt)] = bwt
        counts = np.bincount(np.arange(len(bwt)) // BLOCK * letters + bwt, minlength=n * letters).reshape(n, letters)
        below = np.zeros((n, letters + 1), np.int64)
        below[1:, 1:] = np.cumsum(np.cumsum(counts, axis=1), axis=0)[:-1]
        return cls(suffixes, blocks.reshape(n, BLOCK), below, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=letters))]))

    def count_below(self, code: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Letters below a code in the transform before a place."""
        block = end // BLOCK
        inside = (self.blocks[block] < code[:, None]) & (np.arange(BLOCK) < (end % BLOCK)[:, None])
        return self.below[block, code] + inside.sum(axis=1)

    def all_below(self, end: np.ndarray) -> np.ndarray:
        """As count_below, of all codes."""
        block, letters = end // BLOCK, self.below.shape[1] - 1
        row, col = np.nonzero(np.arange(BLOCK) < (end % BLOCK)[:, None])
        counts = np.bincount(row * letters + self.blocks[block[row], col], minlength=len(end) * letters).reshape(len(end), letters)
        out = self.below[block]
        out[:, 1:] += np.cumsum(counts, axis=1)
        return out

    def step(self, low, size, other, code):
        """The interval with a letter more on this direction's side; ``other`` is the low end in the other direction's index."""
        a, b = self.count_below(code, low), self.count_below(code, low + size)
        a1, b1 = self.count_below(code + 1, low), self.count_below(code + 1, low + size)
        return self.total[code] + a1 - a, (b1 - b) - (a1 - a), other + b - a

    def steps(self, low, size, other):
        """All letters (no delimiter) that extend the intervals: row, code, low, size, other."""
        a, b = self.all_below(low), self.all_below(low + size)
        width = np.diff(b, axis=1) - np.diff(a, axis=1)
        width[:, : GAP + 1] = 0
        row, code = np.nonzero(width)
        return row, code, self.total[code] + a[row, code + 1] - a[row, code], width[row, code], other[row] + b[row, code] - a[row, code]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By doubling: the text's end is unique and smallest."""
    rank, k, n = text.astype(np.int64), 1, len(text)
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) > 0]))
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class WordIndex:
    """A bidirectional FM-index over delimited words, searched for words that are one edit away."""

    def __init__(self, words: list[str], alphabet: np.ndarray):
        self.alphabet = alphabet
        flat, ends = coded(words, alphabet)
        self.words = len(words)
        # A delimiter stands before each word and behind the last one.
        text = np.full(len(flat) + len(words) + 2, GAP, np.int64)
        text[np.arange(len(flat)) + np.repeat(np.arange(len(words)), np.diff(ends)) + 1] = flat
        text[-1] = END
        letters = len(alphabet) + 2
        self.left = Ranks.of(text, letters)  # extends to the left
        self.right = Ranks.of(np.concatenate([text[-2::-1], [END]]), letters)
        self.word_at = np.zeros(len(text), np.int64)
        self.word_at[ends[:-1] + np.arange(len(words))] = np.arange(len(words))
        self.size = len(text)

    def near(self, flat: np.ndarray, ends: np.ndarray, forward: bool) -> tuple[np.ndarray, np.ndarray]:
        """Patterns and words one edit apart that share the patterns' first halves (forward) or else their second halves."""
        found = [self._search(flat, ends[i : i + QUERIES + 1], i, forward) for i in range(0, len(ends) - 1, QUERIES)]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _search(self, flat, ends, base, forward):
        begin, length = ends[:-1], np.diff(ends)
        half = length // 2
        inner, outer = (self.left, self.right) if forward else (self.right, self.left)
        # The exact half is read from the middle outwards, the other one from the middle to its own end; both end with a delimiter.
        exact, rest = (half, length - half) if forward else (length - half, half)

        def letter(q, t, n, to_right):
            at = np.minimum(t, n - 1)
            at = begin[q] + half[q] + at if to_right else begin[q] + half[q] - 1 - at
            return np.where(t < n, flat[np.clip(at, 0, len(flat) - 1)], GAP)

        q = np.arange(len(length))
        low, size, other = np.zeros(len(q), np.int64), np.full(len(q), self.size), np.zeros(len(q), np.int64)
        for t in range(int(exact.max()) + 1):
            on = t <= exact[q]
            done = [x[~on] for x in (q, low, size, other)]
            now = [x[on] for x in (q, low, size, other)]
            now[1], now[2], now[3] = inner.step(now[1], now[2], now[3], letter(now[0], np.full(len(now[0]), t), exact[now[0]], not forward))
            keep = now[2] > 0
            q, low, size, other = (np.concatenate([x, y[keep]]) for x, y in zip(done, now, strict=True))
        low, other = other, low  # turn round: from here on the other direction's intervals are narrowed
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(rest.max()) + 1 if len(q) else 0):
            code = letter(q, np.full(len(q), t), rest[q], forward)
            row, x, x_low, x_size, x_other = outer.steps(low, size, other)
            replaced = (x != code[row]) & (code[row] != GAP)
            cut = code != GAP
            one = [np.concatenate(z) for z in (
                (q[row], q[row][replaced], q[cut]), (np.full(len(row), t), np.full(replaced.sum(), t + 1), np.full(cut.sum(), t + 1)),
                (x_low, x_low[replaced], low[cut]), (x_size, x_size[replaced], size[cut]), (x_other, x_other[replaced], other[cut]),
            )]  # fmt: skip  an inserted, a replaced, a deleted letter
            hits.append(self._finish(one, rest, lambda q, t: letter(q, t, rest[q], forward), outer, forward))
            on = np.flatnonzero(t < rest[q])
            q, low, size, other, code = q[on], low[on], size[on], other[on], code[on]
            low, size, other = outer.step(low, size, other, code)
            q, low, size, other = (v[size > 0] for v in (q, low, size, other))
            if not len(q):
                break
        query, word = (np.concatenate([h[i] for h in hits]) if hits else np.empty(0, np.int64) for i in (0, 1))
        pair = np.unique((query + base) * np.int64(self.words) + word)
        return pair // self.words, pair % self.words

    def _finish(self, states, rest, letter, outer, forward):
        """Match what is left of the patterns exactly, to the delimiter; the words that were met."""
        q, t, low, size, other = states
        queries, words = [], []
        while len(q):
            low, size, other = outer.step(low, size, other, letter(q, t))
            keep = size > 0
            q, t, low, size, other = q[keep], t[keep] + 1, low[keep], size[keep], other[keep]
            over = t > rest[q]
            at = (other if forward else low)[over]  # rank among the suffixes of the text that begin with the delimiter
            queries.append(q[over])
            words.append(self.word_at[self.left.suffixes[at]])
            q, t, low, size, other = (v[~over] for v in (q, t, low, size, other))
        return (np.concatenate(queries), np.concatenate(words)) if queries else (np.empty(0, np.int64), np.empty(0, np.int64))


def points(words: Iterable[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)


def coded(words: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all words' letters, and where each word ends."""
    return np.searchsorted(alphabet, points(words)) + GAP + 1, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


def near_words(words: list[str], queries: list[str], forward: bool) -> tuple[np.ndarray, np.ndarray]:
    """Queries and words (by place) that are one edit apart and share the query's first half; or, if not forward, its second half but not its first."""
    alphabet = np.unique(points([*words, *queries]))
    query, word = WordIndex(words, alphabet).near(*coded(queries, alphabet), forward)
    keep = np.array([queries[q] != words[w] and (forward or not words[w].startswith(queries[q][: len(queries[q]) // 2])) for q, w in zip(query.tolist(), word.tolist(), strict=True)], bool)
    return query[keep], word[keep]


def _best_in_bucket(table):
    """Of each query its near words in this bucket: how many, and the commonest (ties: the smallest)."""
    import pyarrow as pa

    role, words, n = table["role"].to_numpy(), table["word"].to_pylist(), table["n"].to_numpy()
    forward = table["first"][0].as_py()
    indexed, asked = np.flatnonzero(role != 1), np.flatnonzero(role != 0)
    best: dict[int, tuple[int, str]] = {}
    count: dict[int, int] = {}
    if len(indexed) and len(asked):
        query, word = near_words([words[i] for i in indexed], [words[i] for i in asked], forward)
        for q, w in zip(asked[query].tolist(), indexed[word].tolist(), strict=True):
            count[q] = count.get(q, 0) + 1
            x = (-int(n[w]), words[w])
            if q not in best or x < best[q]:
                best[q] = x
    keys = list(best)
    return pa.table([pa.array([words[q] for q in keys], pa.string()), pa.array([count[q] for q in keys], pa.int64()), pa.array([-best[q][0] for q in keys], pa.int64()), pa.array([best[q][1] for q in keys], pa.string())], names=["word", "n_near", "best_n", "best"])


def near_summary(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """word, n_near, best_n and best of all words (a staged table of word and n) that have near ones."""
    buckets = max(1, -(-2 * words.count() // most))
    sides = words.select("word", "n", F.explode(F.array(F.struct(F.lit(True).alias("first"), F.substring("word", 1, 3).alias("key")), F.struct(F.lit(False).alias("first"), F.substring("word", -3, 3).alias("key")))).alias("s")).select("word", "n", "s.*")
    large = sides.groupBy("first", "key").agg(F.ceil(F.count("*") / most).cast("int").alias("shards")).where(F.col("shards") > 1)
    dealt = sides.join(large, ["first", "key"], "left")
    own = F.pmod(F.xxhash64("word"), "shards").cast("int")
    every = F.sequence(F.lit(0), F.col("shards") - 1)
    role = lambda i, j, r: F.struct(i.alias("i"), j.alias("j"), F.lit(r).alias("role"))
    places = F.when(F.col("shards").isNull(), F.array(role(F.lit(0), F.lit(0), 2))).otherwise(F.concat(F.transform(every, lambda j: role(own, j, 0)), F.transform(every, lambda i: role(i, own, 1))))
    placed = dealt.select("word", "n", "first", "key", "shards", F.explode(places).alias("p"))
    bucket = F.when(F.col("shards").isNull(), F.pmod(F.xxhash64("key"), F.lit(buckets))).otherwise(F.xxhash64("key", "p.i", "p.j"))
    rows = placed.select("word", "n", "first", bucket.alias("bucket"), F.col("p.role").alias("role"))
    found = rows.groupBy("first", "bucket").applyInArrow(_best_in_bucket, NEAR)
    smallest = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), smallest).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def follow(forms: DataFrame) -> DataFrame:
    """word and root: what is reached from each word by its forms. Paths are halved in each round, and forms grow commoner, so rounds are few."""
    spark = forms.sparkSession
    now = stage_table(spark, forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = stage_table(spark, now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_table(spark, now)
        now = after
        if not now.where("moved").head(1):
            return now


def group_variants(docs: DataFrame, ratio: int = 5, most: int = MOST_WORDS) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words of the corpus (corpus_words).

    Two words are near if one inserted, deleted or replaced code point makes one
    of the other. A word's form is its commonest near word (ties: the smallest),
    if that is ``ratio`` times as common; its root is where forms lead. Empty
    tables and texts without words give no rows.
    """
    spark = docs.sparkSession
    words = stage_table(spark, corpus_words(docs), "words")
    near = words.join(near_summary(words, most), "word", "left")
    is_form = F.col("best_n") >= ratio * F.col("n")
    formed = stage_table(spark, near.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "forms")
    roots = follow(formed.where(F.col("form").isNotNull()))
    out = stage_table(spark, formed.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"), "variants")
    drop_tables(spark, words, formed, roots)
    return out
