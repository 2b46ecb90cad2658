"""Alignment of two tokenizers' ids over the same texts, with whitespace tokens as anchors.

Both tokenizers encode the whole text after a space. Where tokens of both end
and the next ones begin with a space, the text is cut into windows of ids.
Windows recur, so what a window gives (its groups, links and id pairs) is kept
by its two tuples of ids.
"""

from __future__ import annotations

import contextlib
import gc
import hashlib
import os
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import drop_tables, slices, stage_table
from tideline.llm.tokens import CUT, LONGEST_CACHED, TOUCHING, SegmentEncoder

SPACE_PIECE = "▁"
WHOLE = re.compile(f"[\x00-\x08{SPACE_PIECE}]")  # texts whose pieces are not looked up by segment
CACHE_BYTES, SEGMENT_BYTES, WINDOW_BYTES = 96 << 20, 330, 400
BATCH_BYTES = 1 << 19
HOT_PAIRS = 1 << 17
COUNTED = 1 << 21  # id pairs that are counted together before they leave a task
LONG_WINDOW = 512  # bytes of ids; longer windows are not kept, and their links are counted, not listed
Key = tuple[bytes, bytes]  # a window's ids of either tokenizer
Window = tuple[str, int, int, int, int, bytes, bytes]  # shown, n_a, n_b, n_groups, n_links, pairs, times
_aligners: dict[tuple[str, str], Aligner] = {}

ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


class PlainEncoder(SegmentEncoder):
    """As SegmentEncoder, but strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.added = re.compile("(?!)")

    def coded(self, segments: Iterable[str]) -> dict[str, bytes]:
        self._learn(set(segments))
        found = dict(self.cache)
        self.forget()
        return found


def byte_table(vocabulary: dict[str, int], size: int) -> list[bytes]:
    """Bytes of each entry of a byte-level vocabulary: printable Latin-1 characters stand for themselves, the other bytes for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    table = [b""] * size
    for entry, id in vocabulary.items():
        table[id] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return table


def piece_table(model) -> list[bytes]:
    pieces = map(model.id_to_piece, range(model.get_piece_size()))
    return [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]


class Aligner:
    """Encodes a text with both tokenizers and aligns the ids. Caches are bounded by their bytes and end with the task.

    Neither tokenizer has a token over a single space that stands between two
    other characters (of the pieces this is looked up), so segments from space
    to space are encoded apart, and only once, and each is a window: both have
    a shared end before it. Segments whose bytes the tokens don't give back are
    marked, and a text that has one has no tokens.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = PlainEncoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        vocabulary = self.a.tokenizer.get_vocab()
        self.bytes_a, self.bytes_b = byte_table(vocabulary, max(vocabulary.values()) + 1), piece_table(self.b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.lengths_a, self.lengths_b = self.length_a.tolist(), self.length_b.tolist()
        self.shown = [f"{i}{end}" for table in (self.bytes_a, self.bytes_b) for end in (",", "|" if table is self.bytes_a else ";") for i in range(len(table))]
        self.marked_a, self.marked_b = (np.array([x[:1] == b" " for x in t]) for t in (self.bytes_a, self.bytes_b))
        self.radix = len(self.bytes_b)
        self.apart = not any(SPACE_PIECE in p[1:] and p.strip(SPACE_PIECE) for p in map(self.b.id_to_piece, range(self.radix)))
        self.forget()

    def forget(self) -> None:
        self.segments: dict[str, Key | None] = {}
        self.windows: dict[Key, Window] = {}
        self.room_segments = self.room_windows = CACHE_BYTES

    def _verified(self, segment: str, a: bytes, b: list[int]) -> Key | None:
        whole = segment.encode()
        if b"".join([self.bytes_b[i] for i in b]) != whole or b"".join([self.bytes_a[i] for i in np.frombuffer(a, self.a.dtype).tolist()]) != whole:
            return None
        return a, np.array(b, "<u4").tobytes()

    def _learn(self, segments: set[str]) -> dict[str, Key | None]:
        """Both tokenizers' ids of segments, each of which begins with a space; the pieces add that space themselves.

        Segments with no other space go through the pieces as one text, which
        is cut again before its marked pieces. If its bytes are right as a
        whole, so is each segment.
        """
        coded = self.a.coded(segments)
        names = [x for x in coded if " " not in x[1:] and len(x) > 1]
        b = np.array(self.b.encode(" ".join([x[1:] for x in names])), "<u4") if names else np.empty(0, "<u4")
        begins = np.flatnonzero(self.marked_b[b])
        whole = "".join(names).encode()
        a = np.frombuffer(b"".join([coded[x] for x in names]), self.a.dtype)
        found: dict[str, Key | None] = {}
        if len(begins) == len(names) and b"".join([self.bytes_b[i] for i in b.tolist()]) == whole and b"".join([self.bytes_a[i] for i in a.tolist()]) == whole:
            raw, at = b.tobytes(), [*(begins * 4).tolist(), 4 * len(b)]
            found = {x: (coded[x], raw[i:j]) for x, i, j in zip(names, at, at[1:], strict=False)}
        names = [x for x in coded if x not in found]
        return found | {x: self._verified(x, coded[x], b) for x, b in zip(names, self.b.encode([x[1:] for x in names], num_threads=1), strict=True)}

    def encode(self, texts: list[str | None]) -> list[list[Key] | None]:
        """Windows of ids of a space and each text; None if there is no text or the tokens don't give its bytes back."""
        cut: list[list[str]] = []
        for text in texts:
            if not text or WHOLE.search(text) or not self.apart:
                cut.append([])
            elif text[0].isspace() or text[-1] == " " or TOUCHING.search(text):
                cut.append(CUT.split(" " + text))
            else:
                cut.append([" " + x for x in text.split(" ")])
        get = self.segments.get
        found = [[get(x, 0) for x in segments] for segments in cut]
        missing = {x for segments, known in zip(cut, found, strict=True) if 0 in known for x, y in zip(segments, known, strict=True) if y == 0}
        if missing:
            new = self._learn(missing)
            found = [[new[x] if y == 0 else y for x, y in zip(segments, known, strict=True)] if 0 in known else known for segments, known in zip(cut, found, strict=True)]
            short = {x: y for x, y in new.items() if len(x) <= LONGEST_CACHED}
            if self.room_segments <= 0:
                self.segments.clear()
                self.room_segments = CACHE_BYTES
            self.room_segments -= SEGMENT_BYTES * len(short)
            self.segments.update(short)
        return [self._whole(text) if text and not known else None if not text or None in known else known for text, known in zip(texts, found, strict=True)]

    def _whole(self, text: str) -> list[Key] | None:
        """Windows of a text that is encoded as one: cut where both have a shared end before a token that begins with a space."""
        coded = self._verified(" " + text, self.a.ids(" " + text).tobytes(), self.b.encode(text))
        if coded is None:
            return None
        a, b = np.frombuffer(coded[0], self.a.dtype), np.frombuffer(coded[1], "<u4")
        begins_a, begins_b = np.cumsum(self.length_a[a]) - self.length_a[a], np.cumsum(self.length_b[b]) - self.length_b[b]
        anchors = np.union1d([0], np.intersect1d(begins_a[self.marked_a[a]], begins_b[self.marked_b[b]]))
        cuts_a = [*(np.searchsorted(begins_a, anchors) * self.a.dtype.itemsize).tolist(), len(coded[0])]
        cuts_b = [*(np.searchsorted(begins_b, anchors) * 4).tolist(), len(coded[1])]
        return [(coded[0][a0:a1], coded[1][b0:b1]) for a0, a1, b0, b1 in zip(cuts_a, cuts_a[1:], cuts_b, cuts_b[1:], strict=False)]

    def window(self, key: Key) -> Window:
        """Of a window: its groups as text, their number, the number of links, and the distinct id pairs with how often they are linked."""
        a, b = np.frombuffer(key[0], self.a.dtype).tolist(), np.frombuffer(key[1], "<u4").tolist()
        texts, links, pairs = [], 0, {}
        i = j = end_a = end_b = first_a = first_b = 0
        while i < len(a):
            end_a += self.lengths_a[a[i]]
            i += 1
            while j < len(b) and end_b < end_a:
                end_b += self.lengths_b[b[j]]
                j += 1
            if end_a == end_b:
                own_a, own_b = a[first_a:i], b[first_b:j]
                first_a, first_b = i, j
                texts.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                links += len(own_a) * len(own_b)
                times_b = Counter(own_b).items()
                for x, n in Counter(own_a).items():
                    for y, m in times_b:
                        pair = x * self.radix + y
                        pairs[pair] = pairs.get(pair, 0) + n * m
        return ";".join(texts), len(a), len(b), len(texts), links, array("q", pairs).tobytes(), array("q", pairs.values()).tobytes()

    def windows_of(self, keys: list[Key]) -> list[Window]:
        """As window, of many at once; a window's pairs then stand there as often as they are linked, and it has no times."""
        if not keys:
            return []
        a, b = np.frombuffer(b"".join([k[0] for k in keys]), self.a.dtype).astype(np.int64), np.frombuffer(b"".join([k[1] for k in keys]), "<u4").astype(np.int64)
        last_a, last_b = np.cumsum([len(k[0]) // self.a.dtype.itemsize for k in keys]), np.cumsum([len(k[1]) // 4 for k in keys])
        ends_a, ends_b = np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b])
        shut_a, shut_b = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a, ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(shut_a) - shut_a, np.cumsum(shut_b) - shut_b
        size_a, size_b = np.bincount(group_a), np.bincount(group_b)
        # Tokens in the order of the text: a group's of the first tokenizer, then its of the second.
        order = np.empty(len(a) + len(b), np.int64)
        before_b, after_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        order[np.arange(len(a)) + before_b[group_a]] = a + len(self.bytes_a) * shut_a
        order[np.arange(len(b)) + after_a[group_b]] = b + self.radix * shut_b + 2 * len(self.bytes_a)
        shown = list(map(self.shown.__getitem__, order.tolist()))
        # Links: each token of the first tokenizer with those of the second in its group.
        n = size_b[group_a]
        at = np.repeat(before_b[group_a] - np.cumsum(n) + n, n) + np.arange(n.sum())
        raw = (np.repeat(a, n) * self.radix + b[at]).tobytes()
        links, groups, tokens = [0, *np.cumsum(n)[last_a - 1].tolist()], [0, *(group_a[last_a - 1] + 1).tolist()], [0, *(last_a + last_b).tolist()]
        wide = self.a.dtype.itemsize
        return [("".join(shown[tokens[i] : tokens[i + 1]])[:-1], len(keys[i][0]) // wide, len(keys[i][1]) // 4, groups[i + 1] - groups[i], links[i + 1] - links[i], raw[8 * links[i] : 8 * links[i + 1]], b"") for i in range(len(keys))]

    def align(self, texts: list[str | None]) -> list[tuple]:
        """Of each text n_a, n_b, n_groups, n_links, groups_sha256, pairs and times; zeros and empty ones for texts without tokens."""
        cut = self.encode(texts)
        get = self.windows.get
        found = [[get(k) for k in keys] if keys else [] for keys in cut]
        missing = list({k for keys, known in zip(cut, found, strict=True) if None in known for k, x in zip(keys, known, strict=True) if x is None})
        if missing:
            long = {k for k in missing if len(k[0]) + len(k[1]) > LONG_WINDOW}
            short = [k for k in missing if k not in long]
            new = dict(zip(short, self.windows_of(short), strict=True))
            if self.room_windows <= 0:
                self.windows.clear()
                self.room_windows = CACHE_BYTES
            self.room_windows -= sum([WINDOW_BYTES + 9 * len(k[1]) for k in short])
            self.windows.update(new)
            new.update((k, self.window(k)) for k in long)
            found = [[new[k] if x is None else x for k, x in zip(keys, known, strict=True)] if None in known else known for keys, known in zip(cut, found, strict=True)]
        return [self._document(known) if known else (0, 0, 0, 0, "", b"", b"") for known in found]

    def _document(self, windows: list[Window]) -> tuple:
        shown, n_a, n_b, groups, links, pairs, times = zip(*windows, strict=True)
        keys, n = summed(pairs, times)
        digest = hashlib.sha256(";".join(shown).encode()).hexdigest()
        return sum(n_a), sum(n_b), sum(groups), sum(links), digest, keys.astype("<u4").tobytes() if self.narrow else keys.tobytes(), packed(n)

    @property
    def narrow(self) -> bool:
        return len(self.bytes_a) * self.radix <= 1 << 32


def summed(pairs: tuple[bytes, ...], times: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order and how often they are linked, of windows' pairs and times (none: once each)."""
    if not any(times):
        return np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_counts=True)
    n = [np.frombuffer(t, "<i8") if t else np.ones(len(p) // 8, np.int64) for p, t in zip(pairs, times, strict=True)]
    keys, at = np.unique(np.frombuffer(b"".join(pairs), "<i8"), return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, np.concatenate(n))
    return keys, out


def packed(times: np.ndarray) -> bytes:
    """Times as bytes of a width that the first byte states."""
    width = 1 if not len(times) or times.max() < 1 << 8 else 4 if times.max() < 1 << 32 else 8
    return bytes([width]) + times.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64) if raw else np.empty(0, np.int64)


@contextlib.contextmanager
def aligner(path_a: str, path_b: str) -> Iterator[Aligner]:
    """The worker's own aligner, which later tasks of the worker use again; its caches end with the task."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    gc.disable()  # millions of small tuples live in the caches, and none is in a cycle
    try:
        yield _aligners[path_a, path_b]
    finally:
        gc.enable()
        _aligners[path_a, path_b].forget()


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row for each document (ALIGNED): counts, the digest of its groups, and its id pairs with how often each is linked."""
    import pyarrow as pa

    names = [x.split()[0] for x in ALIGNED.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]

    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with aligner(path_a, path_b) as both:
            for b in slices(batches, 512):
                texts, rows, part, size = b.column("text").to_pylist(), [], [], 0
                for x in texts:
                    part.append(x)
                    size += len(x or "")
                    if size >= BATCH_BYTES:
                        rows += both.align(part)
                        part, size = [], 0
                rows += both.align(part)
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds[2:], strict=True))], names=names)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(align, ALIGNED)


def pair_counts(done: DataFrame, narrow: bool) -> DataFrame:
    """In how many documents each id pair is linked; documents of a task are added up before the shuffle."""
    import pyarrow as pa

    kind = "<u4" if narrow else "<i8"

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in slices(batches):
            held += [np.frombuffer(x, kind) for x in b.column("pairs").to_pylist() if x]
            size = sum(map(len, held))
            if size >= COUNTED:
                yield flush()
                held = []
        if held:
            yield flush()

    return done.select("pairs").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def hot_level(pairs: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs have that count; it comes from one row for each power."""
    levels = sorted(pairs.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).count().collect(), reverse=True)
    least, total = 62, 0
    for r in levels:
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    return 1 << least


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    Texts that are null, empty, or not given back by their tokens have zeros
    and an empty digest. Rows with one doc_id are documents of their own.
    Counts of the commonest id pairs (``hot_pairs`` at most) go to all tasks;
    the other pairs, each with few documents, are joined by the pair.
    """
    import pyarrow as pa
    import sentencepiece
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    radix = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    narrow = (max(Tokenizer.from_file(path_a).get_vocab().values()) + 1) * radix <= 1 << 32
    kind = "<u4" if narrow else "<i8"
    done = stage_table(spark, aligned(docs, path_a, path_b), "aligned")
    counted = stage_table(spark, pair_counts(done, narrow), "pair-counts")
    best = counted.groupBy(F.expr(f"pair div {radix}").alias("a")).agg(F.max("n").alias("most"))
    pairs = stage_table(spark, counted.withColumn("a", F.expr(f"pair div {radix}")).join(best, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-ranks")
    least = hot_level(pairs, hot_pairs)
    hot = pairs.where(F.col("n") >= least).orderBy("pair").toArrow()
    shared = spark.sparkContext.broadcast(tuple(hot.column(c).to_numpy() for c in ("pair", "n", "best")))

    def lookup(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = np.frombuffer(raw, kind).astype(np.int64)
        known = shared.value[0]
        at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
        return keys, at, known[at] == keys if len(known) else np.zeros(len(keys), bool)

    def add_hot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sums, bests = [], []
            for raw, times in zip(b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
                _, at, hit = lookup(raw)
                m, at = unpacked(times)[hit], at[hit]
                sums.append(int((shared.value[1][at] * m).sum()))
                bests.append(int(m[shared.value[2][at]].sum()))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in plain), pa.array(sums, pa.int64()), pa.array(bests, pa.int64())], names=[*plain, "hot_sum", "hot_best"])

    def cold_links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            parts = []
            for row, raw, times in zip(b.column("row").to_pylist(), b.column("pairs").to_pylist(), b.column("times").to_pylist(), strict=True):
                keys, _, hit = lookup(raw)
                parts.append((np.full((~hit).sum(), row, np.int64), keys[~hit], unpacked(times)[~hit]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*parts, strict=True)], names=["row", "pair", "times"])

    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    links = done.select("row", "pairs", "times").mapInArrow(cold_links, "row long, pair long, times long")
    cold = links.join(pairs.where(F.col("n") < least), "pair").groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("cold_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("cold_best"))
    known = done.select(*plain, "pairs", "times").mapInArrow(add_hot, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, hot_sum long, hot_best long")
    both = known.join(cold, "row", "left")
    total = lambda x: F.col(f"hot_{x}") + F.coalesce(F.col(f"cold_{x}"), F.lit(0))
    out = stage_table(spark, both.select("doc_id", "n_a", "n_b", "n_groups", "n_links", total("best").alias("n_best"), total("sum").alias("count_sum"), "groups_sha256"), "alignment")
    drop_tables(spark, done, counted, pairs)
    shared.destroy()
    return out


def paths() -> tuple[str, str]:
    """The two public vocabularies: byte-level BPE and pieces."""
    import public_tokenizers

    return tuple(str(Path(public_tokenizers.path(x))) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
