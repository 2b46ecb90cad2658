"""Approximate nearest neighbours by cosine with an inverted multi-index.

The two halves of each unit vector are quantised apart, so ``side`` centroids
a half make ``side * side`` cells. A query walks pairs of centroids by their
summed distance with a heap until the cells it has met hold enough entries,
and what is in them is ranked by the exact measure.

How many entries are enough is not guessed: the exact neighbours of a few
sampled rows among all rows are sought in the index, and the walk goes as far
as a share ``recall`` of these neighbours needs. On vectors with structure
that is a small part of the table, on vectors without any it is a large one.

Entries are dealt out in blocks of about ``block`` entries: a cell's entries
take places after those of the cells before it, so small neighbouring cells
share a block and a large cell is split. Queries of a block come in chunks of
about ``chunk``, so no task holds more than a block and a chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import drop_table, drop_tables, slices, stage_table

RESULT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
FOUND = "query_id long, vec_id long, score double"


@dataclass(frozen=True)
class Settings:
    """``sample`` rows at most train the centroids (their number is ``side``: the root of the entries by ``per_cell``, 2 to 1024), ``probes`` of them set the length of the walk."""

    k: int = 5
    recall: float = 0.96
    sample: int = 16_384
    probes: int = 128
    per_cell: int = 8
    block: int = 2048
    chunk: int = 1024
    rounds: int = 8


@dataclass(frozen=True)
class Cells:
    """The trained index: centroids of either half, where each cell's entries begin, how many it has, and how many a walk should meet."""

    first: np.ndarray
    second: np.ndarray
    starts: np.ndarray
    counts: np.ndarray
    enough: int


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows that take part, as vec_id and embedding: an id, and a vector of finite components that are not all zero.

    Vectors of another length than most (of lengths as frequent, the longest
    counts) take no part; neither do empty ones.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all numbers
    rows = rows.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    lengths = rows.groupBy(F.size("embedding").alias("n")).count().agg(F.max(F.struct("count", "n"))).first()[0]
    return rows.where(F.size("embedding") == (lengths["n"] if lengths else 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """Each vector once, with its k + 1 smallest ids: no other id of it can be among a query's k nearest."""
    key = ["h", "embedding"]
    first = rows.withColumn("h", F.xxhash64("embedding")).distinct().withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return first.groupBy(*key).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select("ids", "embedding")


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length, as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares of very large or small components stay finite
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmax(x @ centroids.T - 0.5 * (centroids * centroids).sum(axis=1), axis=1)


def lloyd(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of a bounded sample, begun at evenly spaced rows."""
    centroids = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_centroid(x, centroids)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def walk(q: np.ndarray, cells: Cells) -> np.ndarray:
    """Cells with entries in the order of summed distances of their centroids, until they hold enough."""
    half, side, n_second = cells.first.shape[1], len(cells.first), len(cells.second)
    d1, d2 = ((cells.first - q[:half]) ** 2).sum(axis=1), ((cells.second - q[half:]) ** 2).sum(axis=1)
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    d1, d2 = d1[o1].tolist(), d2[o2].tolist()
    heap, met, taken, counts = [(d1[0] + d2[0], 0, 0)], 0, [], cells.counts
    while heap and met < cells.enough:
        _, i, j = heapq.heappop(heap)
        cell = o1[i] * n_second + o2[j]
        if n := counts[cell]:
            taken.append(cell)
            met += n
        if j + 1 < n_second:  # each pair is pushed once: along its row, and rows are begun down the first column
            heapq.heappush(heap, (d1[i] + d2[j + 1], i, j + 1))
        if j == 0 and i + 1 < side:
            heapq.heappush(heap, (d1[i + 1] + d2[0], i + 1, 0))
    return np.array(taken, np.int64)


def _assigned(entries: DataFrame, first: np.ndarray, second: np.ndarray) -> DataFrame:
    import pyarrow as pa

    half, n_second = first.shape[1], len(second)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4096):
            x = unit(matrix(b.column("embedding")))
            cell = nearest_centroid(x[:, :half], first) * n_second + nearest_centroid(x[:, half:], second)
            yield b.append_column("cell", pa.array(cell, pa.int64()))

    return entries.mapInArrow(assign, T.StructType([*entries.schema.fields, T.StructField("cell", T.LongType())]))


def _neighbour_cells(index: DataFrame, probes: np.ndarray, own: np.ndarray, k: int) -> list:
    """Of each probe the cells of its k nearest other entries among all: one pass, k rows of each probe and task."""
    import pyarrow as pa

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(probes), k), -np.inf)
        where = np.zeros((len(probes), k), np.int64)
        for b in slices(batches, 4096):
            score = probes @ unit(matrix(b.column("embedding"))).T
            ids = b.column("ids")
            score[own[:, None] == ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()][None, :]] = -np.inf
            score, cell = np.hstack([best, score]), np.hstack([where, np.broadcast_to(b.column("cell").to_numpy(), score.shape)])
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best, where = np.take_along_axis(score, top, 1), np.take_along_axis(cell, top, 1)
        probe, _ = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(probe), pa.array(best[np.isfinite(best)]), pa.array(where[np.isfinite(best)])], names=["probe", "score", "cell"])

    found = index.select("ids", "embedding", "cell").mapInArrow(search, "probe long, score double, cell long")
    ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score")))).where(F.col("n") <= k)
    return ranked.select("probe", "cell").collect()


def build(entries: DataFrame, s: Settings) -> tuple[DataFrame, Cells]:
    """The staged index of all distinct vectors, with their cells, and what a walk needs to know."""
    spark = entries.sparkSession
    n = entries.count()
    share = 1.0 if n <= s.sample else 0.95 * s.sample / n
    at = F.pmod(F.xxhash64(F.col("ids")[0], F.lit("sample")), F.lit(1 << 30))
    sample = entries.where(at < int(share * (1 << 30))).orderBy(at, F.col("ids")[0]).limit(s.sample).toArrow()
    x = unit(matrix(sample.column("embedding").combine_chunks()))
    own = np.array([v[0] for v in sample.column("ids").to_pylist()], np.int64)
    half = max(1, x.shape[1] // 2)
    side = int(np.clip(round((n / s.per_cell) ** 0.5), min(2, n), min(1024, len(x))))
    first = lloyd(x[:, :half], side, s.rounds)
    second = lloyd(x[:, half:], side, s.rounds) if x.shape[1] > half else np.zeros((1, 0))
    index = stage_table(spark, _assigned(entries, first, second), "multi-index")
    counts = np.zeros(len(first) * len(second), np.int64)
    for r in index.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    probes = np.linspace(0, len(x) - 1, min(s.probes, len(x))).astype(int)
    needed = []
    for r in _neighbour_cells(index, x[probes], own[probes], s.k):
        q = x[probes[r["probe"]]]
        d = (((first - q[:half]) ** 2).sum(axis=1)[:, None] + ((second - q[half:]) ** 2).sum(axis=1)[None, :]).ravel()
        needed.append(counts[d <= d[r["cell"]]].sum())
    enough = int(np.quantile(needed, s.recall, method="higher")) if needed else 1
    return index, Cells(first, second, np.concatenate([[0], np.cumsum(counts)[:-1]]), counts, max(enough, s.k + 1))


def _placed(index: DataFrame, cells: Cells, block: int) -> DataFrame:
    """Entries with their block: a place by hash among their cell's, after the cells before."""
    import pyarrow as pa

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, h = b.column("cell").to_numpy(), b.column("h").to_numpy()
            yield b.append_column("block", pa.array((cells.starts[cell] + h % np.maximum(cells.counts[cell], 1)) // block, pa.int64()))

    hashed = index.withColumn("h", F.xxhash64("embedding"))
    return hashed.mapInArrow(place, T.StructType([*hashed.schema.fields, T.StructField("block", T.LongType())])).drop("h")


def _visits(queries: DataFrame, cells: Cells, block: int) -> DataFrame:
    """A row for each query and block that its walk meets, with the cells that it met there."""
    import pyarrow as pa

    kind = queries.schema["embedding"].dataType
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("embedding", kind), T.StructField("block", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType()))])

    def visit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows, blocks, lists = [], [], []
            for i, q in enumerate(unit(matrix(b.column("embedding")))):
                cell = walk(q, cells)
                lo, hi = cells.starts[cell] // block, (cells.starts[cell] + cells.counts[cell] - 1) // block
                n = hi - lo + 1
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                cell = np.repeat(cell, n)
                order = np.lexsort((cell, at))
                at, cell = at[order], cell[order]
                cuts = np.flatnonzero(np.diff(at)) + 1
                lists += [x.tolist() for x in np.split(cell, cuts)]
                blocks += at[np.concatenate([[0], cuts])].tolist()
                rows += [i] * (len(cuts) + 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(rows)), b.column("embedding").take(pa.array(rows)), pa.array(blocks, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=schema.names)

    return queries.mapInArrow(visit, schema)


def rank_block(entries, queries, k: int):
    """The k best other rows of each query among the entries of its cells in this block, by cosine of the original vectors."""
    import pyarrow as pa

    out: tuple[list, list, list] = ([], [], [])
    if entries.num_rows and queries.num_rows:
        entries = entries.take(pa.compute.sort_indices(entries["cell"]))
        e, q = matrix(entries["embedding"].combine_chunks()), matrix(queries["embedding"].combine_chunks())
        # Very large or small components are scaled, which leaves the cosine as it is; all others are taken as they are.
        e, q = (np.where((m := np.abs(x).max(axis=1, keepdims=True)) > 1e100, x / m, np.where(m < 1e-100, x / m, x)) for x in (e, q))
        length, q_length = np.sqrt((e * e).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        cell, begins, counts = np.unique(entries["cell"].to_numpy(), return_index=True, return_counts=True)
        ids, query_ids = entries["ids"].to_pylist(), queries["query_id"].to_pylist()
        rough = e / length[:, None]
        for i, wanted in enumerate(queries["cells"].to_pylist()):
            at = np.repeat(np.isin(cell, wanted), counts).nonzero()[0]
            if not len(at):
                continue
            near = rough[at] @ q[i]
            if len(at) > k + 1:
                at = at[near >= np.partition(near, -(k + 1))[-(k + 1)] - 1e-9 * q_length[i]]
            score = np.clip((e[at] * q[i]).sum(axis=1) / (length[at] * q_length[i]), -1.0, 1.0)
            best: dict[int, float] = {}
            for s, v in sorted((-s, v) for s, x in zip(score.tolist(), at.tolist(), strict=True) for v in ids[x]):
                if v != query_ids[i] and v not in best:
                    best[v] = -s
                    if len(best) == k:
                        break
            out[0].extend([query_ids[i]] * len(best))
            out[1].extend(best)
            out[2].extend(best.values())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])


def nearest(rows: DataFrame, queries: DataFrame, settings: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found among all other rows, nearest first, ties to the smaller vec_id.

    ``rows`` and ``queries`` have vec_id and embedding. Nulls, zero vectors,
    vectors with a component that is null or not finite, and vectors of an odd
    length take no part (see usable). Of queries with one id the smallest vector
    counts; of rows with one id that with the best score. A query's own id is
    never its neighbour. Fewer rows than k give all; no rows give none.
    """
    s = settings or Settings()
    spark = rows.sparkSession
    entries = stage_table(spark, distinct_vectors(usable(rows), s.k), "vectors")
    if not entries.head(1):
        drop_table(spark, entries)
        return spark.createDataFrame([], RESULT)
    index, cells = build(entries, s)
    size = len(cells.first[0]) + len(cells.second[0])
    asked = usable(queries).where(F.size("embedding") == size).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    visits = stage_table(spark, _visits(asked, cells, s.block), "visits")
    chunks = visits.groupBy("block").agg(F.ceil(F.count("*") / s.chunk).cast("int").alias("chunks"))
    dealt = visits.join(F.broadcast(chunks) if len(cells.counts) <= 1 << 17 else chunks, "block").withColumn("part", F.pmod(F.xxhash64("query_id"), "chunks").cast("int"))
    copied = _placed(index, cells, s.block).join(chunks, "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    k = s.k

    def rank(entries, queries):
        return rank_block(entries, queries, k)

    pairs = copied.select("block", "part", "ids", "embedding", "cell").groupBy("block", "part").cogroup(dealt.select("block", "part", "query_id", "embedding", "cells").groupBy("block", "part")).applyInArrow(rank, FOUND)
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    done = stage_table(spark, ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "neighbours")
    drop_tables(spark, entries, index, visits)
    return done
