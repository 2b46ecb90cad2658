"""Similarity of embeddings: exact cosine neighbours by balls around pivots, and what they say about labels; and SVD by Gram sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.sources.shared import staged


BAND = 0.25  # radians; at most 13 bands around a pivot
NEAR = "source_id long, neighbor_id long, similarity double"


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _slices(batches: Iterable[pd.DataFrame], rows: int = 512) -> Iterator[pd.DataFrame]:
    """Batches in parts, so that what a worker holds of rows times cells has one size, whatever Arrow's batches and the number of cells up to the pivots' bound."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.iloc[i : i + rows]


def _pivots(table: DataFrame, id_: str, vector: str, pivots: int) -> np.ndarray:
    """Unit vectors far from each other, each the farthest from those before, of the first 32 rows a pivot by a hash of the id."""
    rows = table.orderBy(F.xxhash64(id_), id_).limit(32 * pivots).select(F.col(vector).cast("array<double>").alias("v")).toPandas()
    if rows.empty:
        return np.empty((0, 0))
    x = _unit(rows["v"])
    x = x[np.linalg.norm(x, axis=1) > 0.5]
    chosen, nearest = [], np.full(len(x), -2.0)
    while len(chosen) < min(pivots, len(x)) and (not chosen or nearest.min() < 1 - 1e-9):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    return x[chosen] if chosen else np.empty((0, len(rows["v"].iloc[0])))


def _placed(df: DataFrame, id_: str, vector: str, pivots: np.ndarray, kind: str = "") -> DataFrame:
    """id, unit vector (or the vector itself, as an array of ``kind``), the nearest pivot and the angle to it. A zero vector has pivot -1 and angle 0."""

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            x = _unit(batch["v"])
            s = x @ pivots.T if len(pivots) else np.zeros((len(x), 1))
            zero = np.linalg.norm(x, axis=1) < 0.5
            angle = np.arccos(np.clip(s.max(1), -1, 1))
            yield pd.DataFrame({"id": batch["id"], "v": batch["v"] if kind else list(x), "pivot": np.where(zero, -1, s.argmax(1)), "angle": np.where(zero, 0.0, angle)})

    rows = df.where(F.col(vector).isNotNull()).select(F.col(id_).cast("long").alias("id"), F.col(vector).cast(f"array<{kind or 'double'}>").alias("v"))
    return rows.mapInPandas(place, f"id long, v array<{kind or 'double'}>, pivot int, angle double")


def _bounds(x: np.ndarray, cells: pd.DataFrame, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each query and cell, the largest similarity that a row of the cell may have, and the angle to its pivot.

    By the triangle inequality of angles a row at angle r from the pivot lies at
    least |a - r| from a query at angle a. Zero vectors are similar to nothing.
    """
    number = cells["pivot"].to_numpy()
    angle = np.arccos(np.clip(x @ pivots.T, -1, 1))[:, np.maximum(number, 0)] if len(pivots) else np.zeros((len(x), len(cells)))
    apart = np.maximum(0, np.maximum(angle - cells["hi"].to_numpy(), cells["lo"].to_numpy() - angle))
    none = (np.linalg.norm(x, axis=1) < 0.5)[:, None] | (number < 0)[None, :]
    return np.where(none, 0.0, np.cos(apart)), angle


def _met(queries: DataFrame, rows: DataFrame, k: int, block: int) -> DataFrame:
    """The k best rows of each query in each block of the cells it goes to, none below its least similarity.

    ``queries`` has cell, id, v and least; ``rows`` has cell, id and v. A cell
    becomes a grid of blocks of about ``block`` queries by ``block`` rows, so no
    task holds a whole cell.
    """
    n_q, n_t = (df.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias(n)) for df, n in ((queries, "n_q"), (rows, "n_t")))
    grid = F.broadcast(n_q.join(n_t, "cell"))  # one row for each cell

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("id"), F.col(own_n)).cast("int").alias(own)
        return df.join(grid, "cell").select("cell", *(c for c in ("id", "v", "least") if c in df.columns), mine, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))

    a, b = dealt(queries, "i", "n_q", "j", "n_t"), dealt(rows, "j", "n_t", "i", "n_q")

    def meet(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        sources, others, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
        if len(q) and len(t):
            t = t.sort_values("id")
            ids, vectors = t["id"].to_numpy(), np.stack(t["v"].to_numpy())
            for part in _slices([q], 128):
                s = np.stack(part["v"].to_numpy()) @ vectors.T
                s[part["id"].to_numpy()[:, None] == ids[None, :]] = -2
                for own, least, x in zip(part["id"], part["least"], s, strict=True):
                    likely = np.flatnonzero(x >= max(least, -1.5))
                    if len(likely) > k:  # those that may be among the k best, ties by id with them
                        kth = np.partition(x[likely], len(likely) - k)[len(likely) - k]
                        likely = likely[x[likely] >= kth - 1e-11]
                    best = likely[np.lexsort((ids[likely], -np.round(x[likely], 12)))[:k]]
                    sources.append(np.full(len(best), own))
                    others.append(ids[best])
                    scores.append(x[best])
        return pd.DataFrame({"source_id": np.concatenate(sources), "neighbor_id": np.concatenate(others), "similarity": np.concatenate(scores)})

    keys = ("cell", "i", "j")
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(meet, NEAR)


def _best(near: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("source_id").orderBy(F.desc(F.round("similarity", 12)), "neighbor_id")
    return near.withColumn("neighbor_rank", F.row_number().over(w).cast("long")).where(F.col("neighbor_rank") <= k)


def ball_search(queries: DataFrame, table: DataFrame, id_: str, vector: str, k: int, pivots: int = 64, block: int = 4096, rows_a_pivot: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The rows of cosine_knn, and source_id, n_cells and n_visited: how many cells a query had to meet.

    Rows lie in cells: a pivot, and a band of angles around it. A query first
    meets one cell near to it with more than k rows, which gives a k-th best
    similarity; then it meets only those cells whose bound reaches that. What
    reaches the driver is the pivots (one for ``rows_a_pivot`` rows, ``pivots``
    at most) and one row for each cell, however many rows there are. Vectors without any structure lie at much the same angle
    from all pivots, and then nearly every cell has to be met.
    """
    spark = table.sparkSession
    known = table.where(F.col(vector).isNotNull())
    centres = _pivots(known, id_, vector, max(1, min(pivots, known.count() // rows_a_pivot)))
    rows = staged(_placed(table, id_, vector, centres).withColumn("band", F.floor(F.col("angle") / BAND).cast("int")), "ball-rows")
    cells = rows.groupBy("pivot", "band").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).orderBy("pivot", "band").toPandas()
    if cells.empty:
        return spark.createDataFrame([], NEAR + ", neighbor_rank long"), spark.createDataFrame([], "source_id long, n_cells long, n_visited long")
    cells["cell"] = np.arange(len(cells))
    numbered = F.broadcast(spark.createDataFrame(cells[["pivot", "band", "cell"]], "pivot int, band int, cell int"))
    rows = rows.join(numbered, ["pivot", "band"]).select("cell", "id", "v")

    def home(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            bound, angle = _bounds(np.stack(batch["v"].to_numpy()), cells, centres)
            liked = np.where(cells["n"].to_numpy() > k, bound - 0.01 * angle, -9.0)
            yield batch.assign(cell=liked.argmax(1))[["id", "v", "cell"]]

    asked = staged(_placed(queries, id_, vector, centres).select("id", "v").mapInPandas(home, "id long, v array<double>, cell int").dropDuplicates(["id"]), "ball-queries")
    first = staged(_met(asked.withColumn("least", F.lit(-2.0)), rows, k, block), "ball-first")
    kth = _best(first, k).where(F.col("neighbor_rank") == k).select(F.col("source_id").alias("id"), (F.col("similarity") - 1e-9).alias("least"))
    asked = asked.join(kth, "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))

    def others(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in _slices(batches):
            bound, _ = _bounds(np.stack(batch["v"].to_numpy()), cells, centres)
            reach = bound >= batch["least"].to_numpy()[:, None]
            reach[np.arange(len(batch)), batch["cell"]] = False
            yield batch.assign(cells=[np.flatnonzero(x) for x in reach])[["id", "v", "least", "cells"]]

    going = staged(asked.mapInPandas(others, "id long, v array<double>, least double, cells array<int>"), "ball-visits")
    second = _met(going.select("id", "v", "least", F.explode("cells").alias("cell")), rows, k, block)
    work = going.select(F.col("id").alias("source_id"), F.lit(len(cells)).cast("long").alias("n_cells"), (F.size("cells") + 1).cast("long").alias("n_visited"))
    return _best(first.unionByName(second), k), work


def cosine_knn(queries: DataFrame, table: DataFrame, id_: str, vector: str, k: int, pivots: int = 64, block: int = 4096) -> DataFrame:
    """The k nearest rows of each query by cosine similarity (itself left out), ties by id: exact, by ball_search.

    A zero vector is similar to nothing (similarity 0). Rows without a vector
    are left out; no rows give none. Ids are distinct, in queries and in rows.
    """
    return ball_search(queries, table, id_, vector, k, pivots, block)[0]


def _merged(best: np.ndarray, who: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """Puts into each row's k best (``best``, their ids in ``who``) those of ``s``, similarities to ``ids``, that are better; ties by id. Nothing under -1.5 counts."""
    k = best.shape[1]
    least = np.maximum(best[:, -1], -1.5)
    fresh = best[:, -1] < -1.5
    if fresh.any() and s.shape[1] > k:
        least[fresh] = np.maximum(least[fresh], np.partition(s[fresh], s.shape[1] - k, axis=1)[:, s.shape[1] - k])
    row, at = np.nonzero(s >= np.maximum(least - 1e-11, -1.5)[:, None])
    if not len(row):
        return
    changed = np.unique(row)
    row, x, i = np.concatenate([np.repeat(changed, k), row]), np.concatenate([best[changed].ravel(), s[row, at]]), np.concatenate([who[changed].ravel(), ids[at]])
    order = np.lexsort((i, -np.round(x, 12), row))
    row, x, i = row[order], x[order], i[order]
    first = np.searchsorted(row, changed)
    place = first[:, None] + np.arange(k)[None, :]  # a changed row has k entries at least
    best[changed], who[changed] = x[place], i[place]


def cosine_knn_all(table: DataFrame, id_: str, vector: str, k: int, pivots: int = 64, block: int = 8192, rows_a_pivot: int = 1024) -> DataFrame:
    """The rows of cosine_knn where every row of the table is a query, with nothing shuffled but the rows, once.

    Rows lie in the cells of ball_search and are written in the order of the
    cells, ``block`` rows to a file. A task has the rows of one file as its
    queries, meets its own file first and then, the likeliest first, those files
    that hold a cell whose bound reaches a query's k-th best so far. It holds two
    files at a time, whatever the number of rows, and writes no more than the k
    best. Without structure in the vectors all pairs are met: time is quadratic,
    disk is not. Of queries with one id one counts, as in cosine_knn.
    """
    spark = table.sparkSession
    known = table.where(F.col(vector).isNotNull())
    n = known.count()
    centres = _pivots(known, id_, vector, max(1, min(pivots, n // rows_a_pivot)))
    # Floats stay floats on disk: unit vectors, which are doubles, would take twice as much.
    kind = "float" if known.schema[vector].dataType.simpleString() == "array<float>" else "double"
    placed = _placed(table, id_, vector, centres, kind).withColumn("band", F.floor(F.col("angle") / BAND).cast("int"))
    cells = placed.groupBy("pivot", "band").agg(F.min("angle").alias("lo"), F.max("angle").alias("hi"), F.count("*").alias("n")).orderBy("pivot", "band").toPandas()
    if cells.empty:
        return spark.createDataFrame([], NEAR + ", neighbor_rank long")
    parts = max(-(-n // block), min(spark.sparkContext.defaultParallelism, -(-n // 512)))
    numbered = F.broadcast(spark.createDataFrame(cells.assign(cell=np.arange(len(cells)))[["pivot", "band", "cell"]], "pivot int, band int, cell int"))
    rows = placed.join(numbered, ["pivot", "band"]).select("cell", "id", "v")
    again = staged(rows.groupBy("id").agg(F.count("*").alias("_n"), F.min(F.xxhash64("v")).alias("_first")).where("_n > 1").drop("_n"), "ball-again")
    repeated = bool(again.head(1))
    rows = rows.join(again, "id", "left").withColumn("asks", F.coalesce(F.xxhash64("v") == F.col("_first"), F.lit(True))) if repeated else rows.withColumn("asks", F.lit(True))
    rows = staged(rows.select("cell", "id", "v", "asks").repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell"), "ball-rows")
    held = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.collect_set("cell").alias("cells")).orderBy("file").collect()
    files, cells_of = [r["file"] for r in held], [np.array(sorted(r["cells"])) for r in held]

    def read(url: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(url)
        t = pq.read_table(path, filesystem=system, columns=["cell", "id", "v", "asks"]).combine_chunks()
        x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)
        return *(t.column(c).to_numpy() for c in ("cell", "id")), x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), t.column("asks").to_numpy()

    def search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for own in (int(i) for batch in batches for i in batch["id"]):
            _, source, q, asks = read(files[own])
            source, q = source[asks], q[asks]
            best, who = np.full((len(q), k), -9.0), np.zeros((len(q), k), np.int64)
            near = [_bounds(q[i : i + 512], cells, centres)[0] for i in range(0, len(q), 512)]
            likely = [max((float(b[:, c].max()) for b in near), default=-9.0) for c in cells_of]
            for j in sorted(range(len(files)), key=lambda j: (j != own, -likely[j])):
                met = None
                for at, bound in zip(range(0, len(q), 512), near, strict=True):
                    mine = slice(at, at + 512)
                    reached = cells_of[j][(bound[:, cells_of[j]] >= best[mine, -1][:, None] - 1e-9).any(axis=0)]
                    if not len(reached):
                        continue
                    met = met or read(files[j])
                    take = np.isin(met[0], reached)
                    s = q[mine] @ met[2][take].T
                    s[source[mine][:, None] == met[1][take][None, :]] = -2
                    _merged(best[mine], who[mine], s, met[1][take])
            row, rank = np.nonzero(best > -1.5)
            yield pd.DataFrame({"source_id": source[row], "neighbor_id": who[row, rank], "similarity": best[row, rank], "neighbor_rank": rank + 1})

    found = spark.range(0, len(files), 1, len(files)).mapInPandas(search, NEAR + ", neighbor_rank long")
    return found.dropDuplicates(["source_id", "neighbor_rank"]) if repeated else found


def neighbor_purity(neighbors: DataFrame, labels: DataFrame, id_: str, label: str) -> DataFrame:
    """Of each query, the share of its neighbours that have its label."""
    a = labels.select(F.col(id_).alias("source_id"), F.col(label).alias("own"))
    b = labels.select(F.col(id_).alias("neighbor_id"), F.col(label).alias("other"))
    return neighbors.join(a, "source_id").join(b, "neighbor_id").groupBy("source_id").agg(F.avg((F.col("own") == F.col("other")).cast("double")).alias("purity"))


def neighbor_gap(neighbors: DataFrame, values: DataFrame, id_: str, value: str) -> DataFrame:
    """Of each query, how far its value lies from its neighbours' mean."""
    a = values.select(F.col(id_).alias("source_id"), F.col(value).alias("own"))
    b = values.select(F.col(id_).alias("neighbor_id"), F.col(value).alias("other"))
    means = neighbors.join(b, "neighbor_id").groupBy("source_id").agg(F.avg("other").alias("mean_other"))
    return means.join(a, "source_id").select("source_id", F.abs(F.col("own") - F.col("mean_other")).alias("gap"))


def svd_embed(df: DataFrame, id_: str, vector: str, k: int) -> DataFrame:
    """Coordinates of each row on the k first right singular vectors, without centring.

    Tasks sum Gram matrices of their rows; what reaches the driver has the size
    of the vectors squared, whatever the number of rows. Each axis points to
    where its largest part is positive. Rows without a vector are left out.
    """
    df = df.where(F.col(vector).isNotNull())
    rows = df.select(F.col(vector).cast("array<double>").alias("v"))

    def gram(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_numpy())
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.indices(total.shape)
            yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "x": total.ravel()})

    parts = rows.mapInPandas(gram, "i long, j long, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    if parts.empty:
        return df.select(F.col(id_), F.array().cast("array<double>").alias("coordinates"))
    n = int(parts["i"].max()) + 1
    matrix = np.zeros((n, n))
    matrix[parts["i"], parts["j"]] = parts["x"]
    values, axes = np.linalg.eigh(matrix)
    axes = axes[:, np.argsort(-values)[: min(k, n)]]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    shared = df.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()) @ shared.value)) if len(v) else pd.Series([], dtype=object)

    return df.select(F.col(id_), project(F.col(vector).cast("array<double>")).alias("coordinates"))
