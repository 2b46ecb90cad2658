"""Best-fit packing by bin completion.

Packing depends on lengths alone, and a length is one of ``capacity`` integers.
So Spark counts the pieces of each length (a table of at most ``capacity``
rows, whatever the input), the search works on these counts, and its answer is
a short list of fillings with the number of times each is used. Spark then
ranks the pieces of each length and looks up the sequence and offset of each
rank. No piece ever reaches the driver.
"""

from __future__ import annotations

import logging
import math
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import slices, stage_table
from tideline.llm.tokens import encoder, vocabulary

Plan = list[tuple[tuple[int, ...], int]]
PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
)


def cut_into_pieces(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Token pieces of each document: one if it fits, else pieces of ``capacity`` of which the first may be shorter.

    A null text counts as empty, so it gives one piece with the end id alone.
    Repeated rows give their pieces again; other columns are ignored.
    """
    import pyarrow as pa

    path = path or vocabulary()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        with encoder(path) as coder:
            for batch in slices(batches):
                rows: list[tuple] = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.append(coder.ids(text.as_py() or "").astype("<u4"), np.uint32(end_id)).astype("<u4")
                    begin, end = 0, len(ids) % capacity or capacity
                    for piece in range(-(-len(ids) // capacity)):
                        rows.append((doc_id, piece, begin, end - begin, zlib.crc32(ids[begin:end].tobytes())))
                        begin, end = end, end + capacity
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=PIECES.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's pieces fit into a's, several into one: then wherever b is used a can be, and b's pieces take a's places.

    Both are in descending order.
    """
    if sum(b) > sum(a) or (b and b[0] > a[0]):
        return False
    # Pieces that both have may stay in their places, and what is of length 1 fits wherever there is room.
    a, b = (tuple((Counter(x) - Counter(y)).elements()) for x, y in ((a, b), (b, a)))
    b = tuple(x for x in b if x > 1)
    left = list(a)

    def place(i: int) -> bool:
        if i == len(b):
            return True
        tried = set()
        for k, room in enumerate(left):
            if room >= b[i] and room not in tried:
                tried.add(room)
                left[k] -= b[i]
                if place(i + 1):
                    return True
                left[k] += b[i]
        return False

    return place(0)


def fillings(counts: np.ndarray, room: int, width: int = 24) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` from the lengths that are left, least waste first.

    A filling of one length that leaves no waste dominates all others. Else the
    ``width`` largest lengths are tried as the first of a filling and, for each,
    the ``width`` largest that still fit as the second; what is left is filled
    by the largest that fits, since a smaller one is dominated. Fillings whose
    pieces fit into those of another are dropped. The first answer is best
    fit's.
    """
    present = np.flatnonzero(counts[: room + 1])
    present = present[present > 0]
    if not len(present):
        return [()]
    largest = int(present[-1])
    if largest == room:
        return [(room,)]

    def best_below(limit: int, used: Counter) -> int:
        for x in present[: np.searchsorted(present, limit, "right")][::-1].tolist():
            if counts[x] > used[x]:
                return x
        return 0

    def greedy(chosen: tuple[int, ...]) -> tuple[int, ...]:
        used, left = Counter(chosen), room - sum(chosen)
        while left > 0 and (x := best_below(left, used)):
            chosen, left = (*chosen, x), left - x
            used[x] += 1
        return chosen

    found = {tuple(sorted(greedy(()), reverse=True))}
    firsts = present[::-1][:width].tolist()
    for a in firsts:
        found.add(tuple(sorted(greedy((a,)), reverse=True)))
        if counts[a] > 0 and a < room:
            for b in present[: np.searchsorted(present, min(a, room - a), "right")][::-1][:width].tolist():
                if counts[b] > (a == b):
                    found.add(tuple(sorted(greedy((a, b)), reverse=True)))
        if any(sum(x) == room for x in found):
            break
    kept: list[tuple[int, ...]] = []
    for x in sorted(found, key=lambda x: (-sum(x), len(x), tuple(-y for y in x))):
        if not any(dominates(y, x) for y in kept):
            kept.append(x)
    return kept


def all_fillings(counts: np.ndarray, room: int, effort: list[int]) -> Iterator[tuple[int, ...]]:
    """Every way to fill ``room`` to which no piece that is left can be added, as it is asked for.

    Each step takes one from ``effort``, which searches may share; below zero the ways end early.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1])[::-1] if x]
    free, below = [int(counts[x]) for x in lengths], [-x for x in lengths]
    chosen: list[int] = []
    i, left = 0, room
    while True:
        effort[0] -= 1
        if effort[0] < 0:
            return
        fits = bisect_left(below, -left)
        i = max(i, fits)
        while i < len(lengths) and not free[i]:
            i += 1
        if i < len(lengths):
            chosen.append(i)
            free[i] -= 1
            left -= lengths[i]
            continue
        if not any(free[fits:]):
            yield tuple(lengths[j] for j in chosen)
        if not chosen:
            return
        i = chosen.pop()
        free[i] += 1
        left += lengths[i]
        i += 1


def exhaust(counts: np.ndarray, capacity: int, best: Plan, bound: int, nodes: int, width: int = 24) -> tuple[Plan, bool]:
    """The least plan of all, if it is found within ``nodes`` fillings; and whether the search came to its end.

    The largest piece left is put into every undominated filling in turn,
    those of fillings() first, and each is repeated as often as the counts
    allow, then once less, down to once. A state that was reached with as few
    sequences before is not searched again. However many lengths and pieces
    there are, the search is the same: it ends after ``nodes`` fillings or 64
    steps for each of them in looking for fillings, and keeps its own stack.
    """
    best_bins, least, effort, seen = sum(n for _, n in best), {}, [64 * nodes], 0
    lengths = np.arange(capacity + 1)

    def steps(left: np.ndarray) -> Iterator[tuple[tuple[int, ...], int]]:
        largest = int(np.flatnonzero(left)[-1])
        rest, room = left.copy(), capacity - largest
        rest[largest] -= 1
        kept: list[tuple[int, ...]] = []
        # A piece that fills the room dominates all else, however often.
        exact = not room or rest[room] > 0
        for way in chain(fillings(rest, room, width), () if exact else all_fillings(rest, room, effort)):
            if any(dominates(y, way) for y in kept):
                continue
            kept.append(way)
            filling = (largest, *way)
            most = min(int(left[x]) // m for x, m in Counter(filling).items())
            yield from ((filling, times) for times in range(most, most - 1 if exact else 0, -1))

    stack, plan = [(0, counts, steps(counts))], []
    while stack:
        bins, left, options = stack[-1]
        step = next(options, None)
        if effort[0] < 0 or (step and seen == nodes):
            return best, False
        if step is None:
            stack.pop()
            del plan[len(stack) - 1 :]
            continue
        seen += 1
        after, reached = left.copy(), bins + step[1]
        for x in step[0]:
            after[x] -= step[1]
        if reached - (-int((lengths * after).sum()) // capacity) >= best_bins:
            continue
        if not after.any():
            best, best_bins = [*plan, step], reached
            if best_bins <= bound:
                return best, True
            continue
        key = after.tobytes()
        if least.get(key, best_bins) <= reached:
            continue
        least[key] = reached
        stack.append((reached, after, steps(after)))
        plan.append(step)
    return best, True


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that could do: total length, and pieces too long to share one (Martello and Toth's bound)."""
    lengths = np.arange(len(counts))
    best = -(-int((lengths * counts).sum()) // capacity)
    for k in np.flatnonzero(counts[: capacity // 2 + 1]).tolist() or [0]:
        long = int(counts[capacity - k + 1 :].sum())
        half = slice(capacity // 2 + 1, capacity - k + 1)
        middle, spare = int(counts[half].sum()), int(counts[half].sum()) * capacity - int((lengths[half] * counts[half]).sum())
        small = slice(k, capacity // 2 + 1)
        rest = int((lengths[small] * counts[small]).sum()) - spare
        best = max(best, long + middle + max(0, -(-rest // capacity)))
    return best


def complete_bins(histogram: dict[int, int], capacity: int = 1024, nodes: int = 4000, width: int = 24) -> Plan:
    """Branch and bound over fillings around the largest length left.

    A filling is repeated as often as the counts allow, so a plan has a few
    entries for each length at most. Waste beyond what the incumbent's count of
    sequences allows prunes a branch. The first incumbent is the best of three
    descents that always take the first filling: best fit's, and those that try
    a third of ``width`` and all of it.
    That search leaves out fillings and fewer repeats. Where it ends above the
    lower bound, all undominated fillings are searched (exhaust), so the answer
    is the least there is. Either search ends after ``nodes`` fillings; if the
    answer may then be above the least, a warning is logged, with the bound.
    ``nodes`` and ``width`` (see fillings) bound the driver's time, never what
    is packed.
    """
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    if not counts.any():
        return []
    total, bound = int((np.arange(capacity + 1) * counts).sum()), lower_bound(counts, capacity)

    def used(counts: np.ndarray, options: list[tuple[int, ...]], at: int) -> tuple[tuple[int, ...], int]:
        largest = int(np.flatnonzero(counts)[-1])
        filling = (largest, *options[at])
        return filling, min(int(counts[x]) // m for x, m in Counter(filling).items())

    def options(counts: np.ndarray, width: int = width) -> list[tuple[int, ...]]:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        out = fillings(counts, capacity - largest, width)
        counts[largest] += 1
        return out

    def without(counts: np.ndarray, filling: tuple[int, ...], times: int) -> np.ndarray:
        after = counts.copy()
        for x, m in Counter(filling).items():
            after[x] -= m * times
        return after

    def descent(width: int) -> Plan:
        left, plan = counts, []
        while left.any():
            plan.append(used(left, options(left, width), 0))
            left = without(left, *plan[-1])
        return plan

    best = min((descent(w) for w in sorted({1, max(1, width // 3), width})), key=lambda p: sum(n for _, n in p))
    best_bins = sum(n for _, n in best)
    if best_bins <= bound:
        return best
    # Each level: the counts before it, its options, the next option, and the waste so far.
    every = counts
    stack, plan, seen = [(counts, options(counts), 0, 0)], [], 0
    while stack:
        counts, ways, at, waste = stack.pop()
        del plan[len(stack) :]
        if seen >= nodes:
            break
        if at >= len(ways):
            continue
        stack.append((counts, ways, at + 1, waste))
        filling, times = used(counts, ways, at)
        seen += 1
        after = without(counts, filling, times)
        wasted = waste + (capacity - sum(filling)) * times
        plan.append((filling, times))
        if not after.any():
            bins = sum(n for _, n in plan)
            if bins < best_bins:
                best, best_bins = list(plan), bins
            if best_bins <= bound:
                break
        elif wasted + total <= (best_bins - 1) * capacity:
            stack.append((after, options(after), 0, wasted))
    if best_bins > bound:
        best, proven = exhaust(every, capacity, best, bound, nodes, width)
        best_bins = sum(n for _, n in best)
        if not proven and best_bins > bound:
            logging.getLogger(__name__).warning("the search ended after %d fillings with %d sequences; %d are the least that could do", seen, best_bins, bound)
    return best


def _slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """For each length and filling: first and last rank, copies in a sequence, first sequence, and first offset."""
    out, taken, first = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for length, copies in sorted(Counter(filling).items(), reverse=True):
            out.append((length, taken[length], taken[length] + copies * times, copies, first, offset))
            taken[length] += copies * times
            offset += length * copies
        first += times
    return out


def assign(pieces: DataFrame, plan: Plan, rows: int) -> DataFrame:
    """Give each piece its sequence and offset by its rank among the pieces of its length.

    Ranks are counted in buckets of an id hash first, as many as the root of all
    rows, so that of a length that very many pieces have neither the pieces nor
    the buckets' counts are too many for one task. The slots are a few for each of
    the ``capacity`` lengths, so they are small enough to send to every task.
    """
    spark = pieces.sparkSession
    buckets = max(1, math.isqrt(rows))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    local = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = pieces.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.withColumn("nth", F.row_number().over(local) - 1).join(firsts, ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("earlier"))
    slots = spark.createDataFrame(_slots(plan), "slot_length long, lo long, hi long, copies long, first long, offset0 long")
    nth = F.col("nth") - F.col("lo")
    return ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("nth") >= F.col("lo")) & (F.col("nth") < F.col("hi"))).select(
        *PIECES.names, (F.col("first") + F.floor(nth / F.col("copies"))).cast("long").alias("sequence_id"), (F.col("offset0") + (nth % F.col("copies")) * F.col("length")).cast("long").alias("offset")
    )


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2, nodes: int = 4000, width: int = 24) -> DataFrame:
    """Pack whole documents into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset. No
    documents give no rows. Ties between equal pieces go by doc_id and piece.
    Whole texts are packed, however long; a null text counts as empty, repeated
    rows are packed as often as they come, and other columns are ignored.
    ``nodes`` and ``width`` are complete_bins'.
    """
    spark: SparkSession = docs.sparkSession
    pieces = stage_table(spark, cut_into_pieces(docs, path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    return assign(pieces, complete_bins(histogram, capacity, nodes, width), sum(histogram.values()))
