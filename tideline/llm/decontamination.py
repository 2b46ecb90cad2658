"""Benchmark decontamination by template canonicalisation.

Numbers, names and measures become typed placeholders, a run of them one, so a
question that was asked again with other values keeps its template, also where
a value has more words than before. Windows of template tokens are joined by
hash; where a run of them lies in a document as in the benchmark item, the
slots must agree: one value of the item always stands for one value of the
document. Items that differ in nothing but their values are one template class
and are matched once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import Memo, hash_bitmap, in_bitmap, slices, stage_table

# Words for small numbers, and units of measure.
NUMBER_WORDS = frozenset("one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split())
UNITS = frozenset("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years usd eur dollar dollars euro euros cent cents percent degree degrees mph kph".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?$")
MEASURED = re.compile(r"([+-]?\d[\d.,]*)([a-z]+)$")
EDGES = "\"'“”‘’«»()[]{}<>.,;:!?*_-–—…`"
ENDS, STOPS = ".!?:", ".!?,;:"
LITERAL, NUM, NAME, MEASURE = 0, 1, 2, 3
CAPITAL, ENDING, STOP, UNIT = 4, 8, 16, 32
FLAGS = np.uint64(63)
MARKS = np.array([0, 0x51ED270B, 0x2545F491, 0x9E3779B9], np.uint64)
BITS = 1 << 23


@dataclass(frozen=True)
class LeakRule:
    """When a document holds an item.

    ``window``: template tokens of a window. ``literals``: how many of them
    must be plain words. A document holds an item if it matches ``windows`` of
    the item's windows that at most ``common`` template classes have (so not a
    phrase that all questions begin with), or ``coverage`` of all of them, or if
    it has ``words`` plain words (a power of two) of the item in a row, whatever
    stands in the placeholders between them and however many items have them.
    ``least``: an item of fewer tokens matches nothing, as it can't be told
    from chance.
    """

    window: int = 8
    literals: int = 4
    windows: int = 6
    coverage: float = 0.5
    least: int = 4
    common: int = 32
    words: int = 16


def describe(token: str) -> int:
    """A token's hash, with its kind and flags in the lowest six bits."""
    core = token.strip(EDGES)
    small = core.lower()
    value = xxh3_64_intdigest(small) & ~63
    if small in NUMBER_WORDS:
        value |= NUM
    elif not core.isalpha():
        measured = MEASURED.match(small)
        value |= NUM if NUMBER.match(core) else MEASURE if measured and measured[2] in UNITS else LITERAL
    if core != small and core.istitle():
        value |= CAPITAL
    if small in UNITS:
        value |= UNIT
    if token[-1:] not in core[-1:]:  # marks behind it
        last = token.rstrip("\"'”’»)]}")[-1:]
        value |= ENDING * (last in ENDS) | STOP * (last in STOPS)
    return value


@dataclass(frozen=True)
class Canonical:
    """A text's tokens and hashes; and of its template the codes, the kinds, and where each template token begins (and the last ends)."""

    tokens: list[str]
    hashes: np.ndarray
    codes: np.ndarray
    kinds: np.ndarray
    begins: np.ndarray

    def slot(self, i: int) -> str:
        return " ".join(self.tokens[self.begins[i] : self.begins[i + 1]]).strip(EDGES).lower()


def canonical(text: str | None, known: Callable[[str], int] = describe, cased: bool = True, begun: bool = True) -> Canonical:
    """A text in template form.

    A capitalised word (not one in capitals throughout) is a name unless it
    begins the text or a sentence; a unit is part of a measure behind a number
    or in one token with it. Neighbouring names are one placeholder, and so are
    neighbouring numbers with their units, unless a mark stands between them.
    Without ``begun`` the text does not begin a sentence. Without ``cased`` names are plain words, as they are in texts that are in
    small letters or capitals throughout.
    """
    tokens = (text or "").split()
    if not tokens:
        return Canonical([], *(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64)), np.zeros(1, np.int64))
    packed = np.array(list(map(known, tokens)), np.uint64)
    flags = (packed & FLAGS).astype(np.int64)
    hashes, kinds = packed & ~FLAGS, flags & 3
    behind = np.append(False, kinds[:-1] == NUM)
    kinds = np.where((flags & UNIT > 0) & behind & (kinds == LITERAL), MEASURE, kinds)
    if cased:
        begins = np.append(begun, flags[:-1] & ENDING > 0)
        kinds = np.where((kinds == LITERAL) & (flags & CAPITAL > 0) & ~begins, NAME, kinds)
    family = np.where(kinds == MEASURE, NUM, kinds)
    joined = np.append(False, (family[1:] == family[:-1]) & (family[1:] > 0) & (flags[:-1] & STOP == 0))
    starts = np.flatnonzero(~joined)
    merged = np.maximum.reduceat(kinds, starts)
    return Canonical(tokens, hashes, np.where(merged == LITERAL, hashes[starts], MARKS[merged]), merged, np.append(starts, len(tokens)))


def rolled(codes: np.ndarray, width: int, form: int) -> np.ndarray:
    """Hashes of all windows of ``width`` codes; ``form`` keeps templates and plain texts apart."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = np.full(n, width * 2 + form, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(29)
    return mixed


TEMPLATE, PLAIN = 0, 1
RUN = -1  # stands for the place of a run of plain words
Key = tuple[int, int]  # a window's width, and whether it is of the template or of the plain text


def windows(text: Canonical, key: Key, literals: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows that have enough plain words."""
    width, form = key
    hashes = rolled(text.codes if form == TEMPLATE else text.hashes, width, form)
    places = np.arange(len(hashes))
    if literals and len(hashes):
        plain = np.cumsum(np.append(0, text.kinds == LITERAL))
        places = np.flatnonzero(plain[width:] - plain[: len(hashes)] >= literals)
    return places, hashes[places]


def word_windows(text: Canonical, words: int) -> np.ndarray:
    """Distinct hashes of all runs of so many plain words; each step joins two runs of half the length."""
    mixed, k = text.codes[text.kinds == LITERAL], 1
    while k < words and len(mixed) > k:
        with np.errstate(over="ignore"):
            mixed = mixed[:-k] * np.uint64(0x9E3779B97F4A7C15) + mixed[k:]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
        k *= 2
    return np.unique(mixed) if k >= words else np.empty(0, np.uint64)


def item_windows(text: Canonical, rule: LeakRule) -> tuple[Key, np.ndarray, np.ndarray]:
    """The windows of an item: its key, places and hashes.

    An item without a window of the rule's is one window as a whole: of its
    template if that has enough plain words, else of its very words.
    """
    key = (rule.window, TEMPLATE)
    places, hashes = windows(text, key, rule.literals)
    if len(places) or len(text.tokens) < rule.least:
        return key, places, hashes
    key = (len(text.codes), TEMPLATE) if (text.kinds == LITERAL).sum() >= rule.literals else (len(text.tokens), PLAIN)
    return key, *windows(text, key)


def item_forms(text: str | None, rule: LeakRule) -> list[tuple[Canonical, Key, np.ndarray, np.ndarray]]:
    """An item as it stands and as it is in other case; and if it is one window as a whole, as it is inside a sentence too."""
    out = []
    for cased, begun in ((True, True), (False, True), (True, False)):
        form = canonical(text, cased=cased, begun=begun)
        key, places, hashes = item_windows(form, rule)
        if begun or key != (rule.window, TEMPLATE):
            out.append((form, key, places, hashes))
    return out


def _item_rows(benchmark: DataFrame, rule: LeakRule) -> DataFrame:
    """item_id, class, width, form, place, h and slots of each item's windows; slots are numbered by their value's first place in the item."""
    schema = "item_id long, class long, width int, form int, place long, h long, slots array<int>"

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for form, key, places, hashes in item_forms(text.as_py(), rule):
                    values: dict[str, int] = {}
                    slots = [values.setdefault(form.slot(i), i) if form.kinds[i] else -1 for i in range(len(form.codes))] if key[1] == TEMPLATE else []
                    codes = form.codes if key[1] == TEMPLATE else form.hashes
                    kind = xxh3_64_intdigest(codes.tobytes() + np.array(slots, np.int64).tobytes()) - (1 << 63)
                    for p, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        rows.append((item_id, kind, *key, p, h, [x for x in slots[p : p + key[0]] if x >= 0]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_id", "class", "width", "form", "place", "h", "slots"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, schema)


def _item_runs(benchmark: DataFrame, rule: LeakRule) -> DataFrame:
    """item_id and h of the runs of plain words of each item, as it stands and in other case."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, runs = [], []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.unique(np.concatenate([word_windows(canonical(text.as_py(), cased=cased), rule.words) for cased in (True, False)]))
                ids += [item_id] * len(own)
                runs += own.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(runs, pa.int64())], names=["item_id", "h"])

    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "item_id long, h long").distinct()


def _hits(docs: DataFrame, rule: LeakRule, keys: list[Key], bitmap) -> DataFrame:
    """doc_id, place, h and slots of the documents' windows and runs that may be the benchmark's; slots are the placeholders' own values."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = bitmap.value, Memo(describe, 40 << 20).__getitem__
        for batch in slices(batches):
            rows = ([], [], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                form = canonical(text.as_py(), known)
                for key in keys:
                    places, hashes = windows(form, key, rule.literals if key == (rule.window, TEMPLATE) else 0)
                    hit = in_bitmap(bits, hashes)
                    for p, h in zip(places[hit].tolist(), hashes[hit].view(np.int64).tolist(), strict=True):
                        rows[0].append(doc_id)
                        rows[1].append(p)
                        rows[2].append(h)
                        rows[3].append([form.slot(p + i) for i in np.flatnonzero(form.kinds[p : p + key[0]]).tolist()] if key[1] == TEMPLATE else [])
                runs = word_windows(form, rule.words)
                runs = runs[in_bitmap(bits, runs)].view(np.int64).tolist()
                for column, values in zip(rows, ([doc_id] * len(runs), [RUN] * len(runs), runs, [[]] * len(runs)), strict=True):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.list_(pa.string()))], names=["doc_id", "place", "h", "slots"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, place long, h long, slots array<string>")


def _leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The template classes that documents hold (doc_id, class, matched, item_windows, slots), and the classes' items.

    Then the sets of items that documents have runs of plain words of (doc_id,
    set, matched), and the sets' items. Items that share a passage share its
    runs, and with them a set, so a document meets a set, not each item.
    """
    spark = docs.sparkSession
    rows = stage_table(spark, _item_rows(benchmark, rule), "benchmark-windows")
    members = rows.select("class", "item_id").distinct()
    items = rows.groupBy("class", "place", "h").agg(F.first("slots").alias("item_slots")).withColumnRenamed("place", "item_place")
    times = items.groupBy("h").agg(F.countDistinct("class").alias("classes"))
    in_class = Window.partitionBy("class")  # no longer than one item
    need = F.ceil(rule.coverage * F.col("item_windows"))
    items = items.join(times, "h").withColumn("item_windows", F.count("*").over(in_class)).withColumn("nth", F.row_number().over(in_class.orderBy("classes", "h", "item_place")))
    # Of its windows a leak by coverage has at least ``need``, so it has one of the others' number and one more, the least common first.
    items = stage_table(spark, items.withColumn("telling", F.col("nth") <= F.col("item_windows") - need + 1).drop("nth"), "benchmark-classes")
    keys = sorted((r["width"], r["form"]) for r in rows.select("width", "form").distinct().collect())
    owners = _item_runs(benchmark, rule).groupBy("h").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    owners = stage_table(spark, owners.withColumn("set", F.xxhash64("ids")), "benchmark-runs")
    bits = spark.sparkContext.broadcast(hash_bitmap(items.select("h").unionByName(owners.select("h")), "h", BITS))
    hits = stage_table(spark, _hits(docs, rule, keys, bits), "benchmark-hits")
    held_sets = hits.where(F.col("place") == RUN).join(owners.select("h", "set"), "h").groupBy("doc_id", "set").agg(F.countDistinct("h").alias("matched"))
    hits = hits.where(F.col("place") != RUN)
    own = ["doc_id", "place", "slots", "class", "item_place", "item_slots", "item_windows", "classes"]
    met = hits.join(items.where(F.col("classes") <= rule.common), "h").select(own)
    widespread = items.where(F.col("classes") > rule.common)
    if widespread.head(1):  # only for documents that hold another telling window of the class
        likely = hits.select("doc_id", "h").distinct().join(items.where("telling").select("h", "class"), "h").select("doc_id", "class").distinct()
        spread = hits.join(widespread.select("h").distinct(), "h", "left_semi")
        met = met.unionByName(spread.join(likely, "doc_id").join(widespread, ["class", "h"]).select(own))
    slots = F.arrays_zip(F.col("item_slots").alias("was"), F.col("slots").alias("now"))
    met = met.select("doc_id", "class", (F.col("place") - F.col("item_place")).alias("shift"), "item_place", "item_windows", (F.col("classes") <= rule.common).alias("own"), slots.alias("slots"))
    # One shift of one class in one document is one occurrence, so a group is no larger than the item.
    runs = met.groupBy("doc_id", "class", "shift").agg(F.countDistinct("item_place").alias("matched"), F.countDistinct(F.when(F.col("own"), F.col("item_place"))).alias("matched_own"), F.first("item_windows").alias("item_windows"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
    agree = F.size(F.array_distinct(F.transform("slots", lambda x: x["was"]))) == F.size("slots")
    held = (F.col("matched_own") >= rule.windows) | (F.col("matched") >= rule.coverage * F.col("item_windows"))
    best = runs.where(agree & held).groupBy("doc_id", "class").agg(F.max("matched").alias("matched"), F.first("item_windows").alias("item_windows"), F.max_by("slots", F.struct("matched", "shift")).alias("slots"))
    return best, members, held_sets, owners.select("set", "ids").dropDuplicates(["set"])


def find_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """doc_id, item_id, matched windows, the item's windows and slots, of each item that a document has taken up.

    Slots are pairs of a value's number in the item and its value in the
    document. Of items that a document has in runs of plain words only, the
    runs are counted, and there are no slots. Null and empty texts match nothing. Whole texts are searched,
    however long. Repeated rows give what one row gives; of several places (a
    tie goes to the last) the one with most windows counts; other columns are
    ignored, and empty tables give no rows.

    The benchmark's window hashes go to the tasks as a bitmap of fixed size,
    however many there are; what passes it is joined by hash, so other hits do
    no harm.
    """
    found, members, held_sets, sets = _leaks(docs, benchmark, rule)
    windows = members.join(found, "class").select("doc_id", "item_id", F.struct("matched", "item_windows", "slots").alias("x"))
    runs = _item_runs(benchmark, rule).groupBy("item_id").agg(F.count("*").alias("item_windows"))
    by_run = held_sets.join(sets, "set").select("doc_id", F.explode("ids").alias("item_id"), "matched").groupBy("doc_id", "item_id").agg(F.sum("matched").alias("matched")).join(runs, "item_id")
    none = F.array().cast(found.schema["slots"].dataType)
    by_run = by_run.select("doc_id", "item_id", F.struct("matched", "item_windows", none.alias("slots")).alias("x")).join(windows.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    return windows.unionByName(by_run).groupBy("doc_id", "item_id").agg(F.max("x").alias("best")).select("doc_id", "item_id", "best.*")


def mark_leaks(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """doc_id, contaminated, and the items (ascending) of every row of the documents; see find_leaks for odd rows."""
    found, members, held_sets, sets = _leaks(docs, benchmark, rule)
    lists = members.groupBy("class").agg(F.collect_set("item_id").alias("ids"))
    ids = found.join(lists, "class").select("doc_id", "ids").unionByName(held_sets.join(sets, "set").select("doc_id", "ids"))
    leaks = ids.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("item_ids"))
    empty = F.array().cast("array<bigint>")
    return docs.select("doc_id").join(leaks, "doc_id", "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", empty).alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, rule: LeakRule = LeakRule()) -> DataFrame:
    """The rows of documents without any leak, with all their columns."""
    found, _, held_sets, _ = _leaks(docs, benchmark, rule)
    return docs.join(found.select("doc_id").unionByName(held_sets.select("doc_id")).distinct(), "doc_id", "left_anti").select(docs.columns)
