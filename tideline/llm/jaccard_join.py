"""Exact similarity join on word shingles, through count-vector R-trees.

A global tree over count vectors cannot prune: two unrelated texts of equal
size have much the same counts, so every pair of nodes would survive. The
trees are therefore grown where texts can link at all:

1. Shingles are put in one global order (rare first; any order is exact). Two
   sets that reach the threshold share at least ``l`` of their first
   ``n - ceil(t n) + l`` shingles.
2. Each document joins the cluster of the first document with which it shares
   the most of these shingles. A cluster's documents, by size, fill leaf nodes.
3. A node's box is the largest count in each group of hashed shingles. The sum
   over groups of the smaller of two boxes' counts bounds any overlap below
   them; node pairs under the threshold are dropped.
4. The pairs of the nodes that are left are verified on the whole sets.

Nothing in this caps partners, candidates or node pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tideline.llm.common import drop_tables, join_hot, slices, stage_table
from tideline.llm.components import connected_components

GROUPS = 256


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text (A-Z lower-cased); all words at once if fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.array(list(map(xxh3_64_intdigest, words)), np.uint64)
    mixed = np.zeros(max(1, len(ids) - width + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(ids))):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + len(mixed)]
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


SLACK = 16


def slack(n: int) -> int:
    """How many common prefix shingles a document asks for (l)."""
    return 1 + n // SLACK


LEVELS, LEVEL_BITS = (2, 8, 32), 1 << 23


def frequency_levels(docs: DataFrame, width: int, share: int = 14) -> np.ndarray:
    """Bitmaps of hashed shingles that are in two, eight and 32 documents of a sample of one in ``share``.

    They only order shingles (seldom ones first), and the join is exact under
    any order; so the sample, the bitmaps' fixed size and false hits change the
    work and never the result.
    """
    import pyarrow as pa

    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("order")), F.lit(share)) == 0)

    def explode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [shingles(x.as_py(), width) for x in batch.column(0)]
            keys, n = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    counts = picked.select("text").mapInArrow(explode, "h long, n int").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= LEVELS[0])
    placed = counts.select("n", F.pmod("h", F.lit(LEVEL_BITS)).alias("bit")).selectExpr("shiftright(bit, 5) as w", "shiftleft(1L, cast(bit % 32 as int)) as x", "n")
    words = placed.groupBy("w").agg(*(F.coalesce(F.bit_or(F.when(F.col("n") >= n, F.col("x"))), F.lit(0)).cast("long").alias(f"x{n}") for n in LEVELS)).toPandas()
    out = np.zeros((len(LEVELS), LEVEL_BITS // 32), np.uint32)
    for k, n in enumerate(LEVELS):
        out[k, words["w"].to_numpy(np.int64)] = words[f"x{n}"].to_numpy(np.int64).astype(np.uint32)
    return out


def _prefixes(docs: DataFrame, width: int, percent: int, levels: np.ndarray) -> DataFrame:
    """doc_id, n, digest of the text and the first shingles of each document, and how many of these, at the end, are of the most common."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(levels)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in slices(batches):
            sizes, parts, common = [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width)
                n = len(s)
                sizes.append(n)
                at = (s % np.uint64(LEVEL_BITS)).astype(np.int64)
                level = ((known[:, at >> 5] >> (at & 31).astype(np.uint32)) & 1).sum(0)
                order = np.argsort(level, kind="stable")
                keep = n - -(-percent * n // 100) + slack(n) if n else 0
                parts.append(s[order[:keep]].view(np.int64))
                common.append(int((level[order[:keep]] == len(LEVELS)).sum()))
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2), prefix, pa.array(common, pa.int32())], names=["doc_id", "n", "digest", "prefix", "common"])

    digest = F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return docs.select("doc_id", "text", digest.alias("digest")).mapInArrow(first, "doc_id long, n long, digest string, prefix array<long>, common int")


def id_filter(ids: DataFrame, bits: int = 1 << 22) -> np.ndarray:
    """A bitmap of hashed ids, of fixed size: it lets later scans skip most other rows, and false hits do no harm."""
    hashed = ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(bits)).alias("bit"))
    words = hashed.selectExpr("shiftright(bit, 5) as w", "shiftleft(1L, cast(bit % 32 as int)) as x").groupBy("w").agg(F.bit_or("x").alias("x")).collect()
    out = np.zeros(bits // 32, np.uint32)
    for r in words:
        out[r["w"]] = r["x"]
    return out


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """Whole sets and count vectors of the wanted documents, by shingling their texts again."""
    import pyarrow as pa

    bitmap = docs.sparkSession.sparkContext.broadcast(id_filter(wanted))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in slices(batches):
            at = batch.column(2).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1)
            ids, texts = batch.column(0).take(pa.array(rows)), batch.column(1)
            sets = [shingles(texts[int(i)].as_py(), width) for i in rows]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.uint64), *sets])
            vectors = [np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS), 65_535).astype("<u2").tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(s) for s in sets], pa.int64()), pa.array(vectors, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["doc_id", "n", "vector", "shingles"])

    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 22))
    scanned = docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(build, "doc_id long, n long, vector binary, shingles array<long>")
    return scanned.dropDuplicates(["doc_id"])


def _boxes(sets: DataFrame) -> DataFrame:
    """node, smallest and largest set, and the largest count of each group, folded in two steps."""
    def fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        for b in batches:
            for cluster, block, lo, hi, v in b.itertuples(index=False):
                x = np.frombuffer(v, "<u2")
                if (y := held.get((cluster, block))) is None:
                    held[cluster, block] = [lo, hi, x.copy()]
                else:
                    y[0], y[1] = min(lo, y[0]), max(hi, y[1])
                    np.maximum(y[2], x, out=y[2])
            if len(held) > 20_000:  # the last key may go on in the next batch
                last = {(cluster, block): held.pop((cluster, block))}
                yield _box_frame(held)
                held = last
        yield _box_frame(held)

    schema = "cluster long, block long, lo long, hi long, box binary"
    parts = sets.select("cluster", "block", F.col("n").alias("lo"), F.col("n").alias("hi"), F.col("vector").alias("box")).mapInPandas(fold, schema)
    return parts.repartition("cluster", "block").sortWithinPartitions("cluster", "block").mapInPandas(fold, schema)


def _box_frame(held: dict) -> pd.DataFrame:
    return pd.DataFrame([(c, b, lo, hi, x.astype("<u2").tobytes()) for (c, b), (lo, hi, x) in held.items()], columns=["cluster", "block", "lo", "hi", "box"])


def _may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """Node pairs whose boxes allow the threshold, by the sum of the smaller counts."""
    @F.pandas_udf("boolean")
    def allowed(a: pd.Series, b: pd.Series, lo_a: pd.Series, lo_b: pd.Series) -> pd.Series:
        out = []
        for x, y, m, n in zip(a, b, lo_a, lo_b, strict=True):
            x, y = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
            overlap = np.minimum(x, y).sum(dtype=np.int64)
            # inter >= t/(1+t) (|A|+|B|), with the smallest sets of both nodes; full counts are no bound
            out.append(bool(x.max() == 65_535 or y.max() == 65_535 or (100 + percent) * overlap >= percent * (m + n)))
        return pd.Series(out, dtype=bool)

    return pairs.where(allowed("box_a", "box_b", "lo_a", "lo_b"))


def _verify(rows: DataFrame, percent: int) -> DataFrame:
    """Links of each node with a batch of others, or within it (batch -1): a spanning forest of what is linked there."""
    import pyarrow as pa

    def overlaps(sets: list[np.ndarray]) -> np.ndarray:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
        keep = times[column] > 1
        column, owner = np.unique(column[keep], return_inverse=True)[1], owner[keep]
        width = int(column.max()) + 1 if len(column) else 0
        total = np.zeros((len(sets), len(sets)), np.float32)
        for a in range(0, width, 4096):
            part = (column >= a) & (column < a + 4096)
            m = np.zeros((len(sets), min(4096, width - a)), np.float32)
            m[owner[part], column[part] - a] = 1
            total += m @ m.T
        return total.astype(np.int64)

    def links(ids: list[int], sides: list[int], sets: list[np.ndarray], both: bool) -> Iterator[tuple[int, int]]:
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        n = np.array([len(s) for s in sets], np.int64)
        if len(ids) == 2:
            inter = np.array([[0, len(np.intersect1d(sets[0], sets[1], assume_unique=True))], [0, 0]])
        else:
            inter = overlaps(sets)
        near = 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
        if both:
            side = np.array(sides)
            near &= side[:, None] != side[None, :]
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = root(int(i)), root(int(j))
            if x != y:
                parent[x] = y
                yield ids[i], ids[j]

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, ([], [], [])
        out: list[tuple[int, int]] = []

        def close() -> None:
            if key is not None and len(group[0]) > 1:
                out.extend(links(*group, both=key[2] >= 0))

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            sides, ids, sets = batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5)
            flat, ends = sets.flatten().to_numpy(), (sets.offsets.to_numpy() - sets.offsets[0].as_py())
            for i, k in enumerate(keys):
                if k != key:
                    close()
                    key, group = k, ([], [], [])
                group[0].append(ids[i])
                group[1].append(sides[i])
                group[2].append(flat[ends[i] : ends[i + 1]])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])
                out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in (0, 1)], names=["a", "b"])

    key = ["cluster", "block", "batch"]
    return rows.repartition(*key).sortWithinPartitions(*key).select(*key, "side", "doc_id", "shingles").mapInArrow(verify, "a long, b long")


SALTS = 64


def _headed(unique: DataFrame) -> DataFrame:
    """doc_id, h and head, the smallest document that has h, of each shingle that several documents have in their prefixes.

    Shingles that the sample showed to be common are dealt out with a salt, so
    that one of them does not meet in one task; their heads are the smallest of
    the salts' smallest.
    """
    place = F.posexplode("prefix").alias("place", "h")
    common = F.col("place") >= F.size("prefix") - F.col("common")
    salt = F.when(common, 1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0)
    dealt = unique.select("doc_id", "prefix", "common", place).select("doc_id", "h", salt.cast("int").alias("salt")).repartition("h", "salt")
    parts = dealt.groupBy("h", "salt").agg(F.min("doc_id").alias("head"), F.count("*").alias("times"))
    salted = parts.where("salt > 0")
    whole = salted.groupBy("h").agg(F.min("head").alias("head"), F.sum("times").alias("times")).where("times > 1")
    heads = parts.where("salt = 0 and times > 1").select("h", "salt", "head").unionByName(salted.select("h", "salt").join(whole.select("h", "head"), "h"))
    return dealt.join(heads, ["h", "salt"]).drop("salt")


def _crossing(shared: DataFrame, of: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Sizes of clusters, the pairs of clusters of which two documents have enough common shingles to be linked, and tables to drop.

    A document with fewer shared shingles than any link of its asks for takes
    no part, so a passage that many else unlike documents hold makes no pairs.
    """
    spark = shared.sparkSession
    spans = stage_table(spark, of.groupBy("cluster").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.count("*").alias("docs")), "cluster-sizes")
    able = shared.groupBy("doc_id").agg(F.count("*").alias("held")).join(of, "doc_id").where(F.col("held") >= 1 + F.floor(percent * F.col("n") / (100 * SLACK)))
    seen = shared.select("h", "doc_id").join(able.select("doc_id", "cluster"), "doc_id").select("h", "cluster").distinct()
    several = seen.groupBy("h").count().where("count > 1").select("h")
    seen = stage_table(spark, seen.join(several, "h").join(spans.select("cluster", "lo", "hi"), "cluster"), "cluster-postings")
    fits = (100 * F.col("x.hi") >= percent * F.col("y.lo")) & (100 * F.col("y.hi") >= percent * F.col("x.lo"))
    crossing = seen.alias("x").join(seen.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.cluster") < F.col("y.cluster")) & fits)
    crossing = crossing.groupBy(F.col("x.cluster").alias("cluster_a"), F.col("y.cluster").alias("cluster_b")).agg(F.count("*").alias("votes"), F.first(F.least("x.lo", "y.lo")).alias("lo"))
    crossing = stage_table(spark, crossing.where(F.col("votes") >= 1 + F.floor(F.col("lo") / SLACK)).select("cluster_a", "cluster_b"), "crossing")
    return spans, crossing, [spans, seen, crossing]


def _in_blocks(wanted: DataFrame, node_docs: int, node_shingles: int) -> DataFrame:
    """Staged rows of doc_id, n and cluster with their leaf node (block): by size, at most about so many documents and shingles.

    Only the sizes that a cluster has are put in order. Documents of one size
    are spread by a hash over as many stretches as their number asks for.
    """
    spark, part = wanted.sparkSession, max(1, node_docs // 4)
    before = Window.partitionBy("cluster").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    sizes = wanted.groupBy("cluster", "n").agg(F.count("*").alias("times"))
    earlier = [F.coalesce(F.sum(c).over(before), F.lit(0)) for c in (F.col("times"), F.col("times") * F.col("n"))]
    sizes = stage_table(spark, sizes.select("cluster", "n", "times", earlier[0].alias("docs_before"), earlier[1].alias("shingles_before")), "cluster-blocks")
    nth = F.pmod(F.xxhash64("doc_id", F.lit("block")), F.ceil(F.col("times") / part)) * part
    block = F.greatest(F.floor((F.col("docs_before") + nth) / node_docs), F.floor((F.col("shingles_before") + nth * F.col("n")) / node_shingles))
    out = stage_table(spark, join_hot(wanted, sizes, ["cluster", "n"]).select("doc_id", "n", "cluster", block.cast("long").alias("block")), "blocks")
    drop_tables(spark, sizes)
    return out


def similar_links(docs: DataFrame, width: int = 5, percent: int = 75, node_docs: int = 512, node_shingles: int = 400_000, jumps: int = 3) -> tuple[DataFrame, DataFrame]:
    """Set sizes of all documents (doc_id, n), and links (a, b) that connect all documents that are linked.

    Exact copies are linked to the smallest doc_id that has their text. A hot
    shingle's list is dealt out in parts and meets other lists by cluster, not
    by document. Tables that are staged on the way are dropped at the end.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    facts = stage_table(spark, _prefixes(docs, width, percent, frequency_levels(docs, width)), "prefixes")
    texts = facts.where("n > 0")
    copies = stage_table(spark, texts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"), "texts")
    copied = stage_table(spark, join_hot(texts.select("doc_id", "digest"), copies, ["digest"]).where("doc_id <> first").select("doc_id", "first").distinct(), "copies")
    unique = texts.select("doc_id", "n", "prefix", "common").join(copied.select("doc_id"), "doc_id", "left_anti")
    shared = stage_table(spark, _headed(unique), "postings")
    voted = shared.where("doc_id <> head").groupBy("doc_id", "head").count().groupBy("doc_id").agg(F.max(F.struct("count", (-F.col("head")).alias("minus_head"))).alias("best"))
    # A head with too few common shingles to be linked, even if it is the smallest set that may be, founds no cluster.
    enough = F.col("best.count") >= 1 + F.floor(percent * F.col("n") / (100 * SLACK))
    of = shared.select("doc_id").distinct().join(voted, "doc_id", "left").join(facts.select("doc_id", "n").distinct(), "doc_id")
    of = of.select("doc_id", "n", F.when(enough, -F.col("best.minus_head")).otherwise(F.col("doc_id")).alias("cluster"))
    of = stage_table(spark, of, "clusters")
    for _ in range(jumps):  # a head that has a head of its own brings its cluster along
        heads_of = of.select(F.col("doc_id").alias("head_id"), F.col("cluster").alias("above"))
        after = stage_table(spark, of.join(heads_of, F.col("cluster") == F.col("head_id"), "left").select("doc_id", "n", F.coalesce("above", "cluster").alias("cluster")), "clusters")
        drop_tables(spark, of)
        of = after
    spans, crossing, used = _crossing(shared, of, percent)
    inside = spans.where("docs > 1").select(F.col("cluster").alias("cluster_a"), F.col("cluster").alias("cluster_b"))
    meeting = stage_table(spark, crossing.select("cluster_a", "cluster_b").unionByName(inside), "cluster-pairs")
    active = meeting.select(F.col("cluster_a").alias("cluster")).unionByName(meeting.select(F.col("cluster_b").alias("cluster"))).distinct()
    wanted = stage_table(spark, of.join(active, "cluster", "left_semi"), "wanted")
    blocked = _in_blocks(wanted, node_docs, node_shingles)
    sets = stage_table(spark, _sets(docs, blocked.select("doc_id"), width).drop("n").join(blocked, "doc_id"), "sets")
    totals = sets.groupBy("cluster", "block").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    boxes = stage_table(spark, _boxes(sets).join(totals, ["cluster", "block"]), "boxes")
    na, nb = (boxes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("cluster", "block", "docs", "total", "lo", "hi", "box"))) for s in "ab")
    pairs = meeting.join(na, "cluster_a").join(nb, "cluster_b").where((F.col("cluster_a") < F.col("cluster_b")) | (F.col("block_a") <= F.col("block_b")))
    pairs = pairs.where((100 * F.col("hi_a") >= percent * F.col("lo_b")) & (100 * F.col("hi_b") >= percent * F.col("lo_a")))
    a, b = (F.struct(*(F.col(f"{c}_{s}").alias(c) for c in ("cluster", "block", "docs", "total"))) for s in "ab")
    larger = F.col("docs_b") > F.col("docs_a")
    pairs = stage_table(spark, _may_link(pairs, percent).select(F.when(larger, b).otherwise(a).alias("host"), F.when(larger, a).otherwise(b).alias("guest")), "node-pairs")
    # A host's guests come in batches, so its documents are sent once for each batch and not once for each guest.
    others = pairs.where("host <> guest")
    loads = others.groupBy("host").agg(F.sum("guest.docs").alias("docs"), F.sum("guest.total").alias("total"))
    batches = F.greatest(F.lit(1), F.ceil(F.col("docs") / node_docs), F.ceil(F.col("total") / node_shingles)).cast("long")
    others = others.join(loads, "host").withColumn("batch", F.pmod(F.xxhash64("guest"), batches))
    own = pairs.where("host = guest").select("host", "guest", F.lit(-1).cast("long").alias("batch"))
    pairs = stage_table(spark, others.select("host", "guest", "batch").unionByName(own), "node-batches")
    members = sets.select("cluster", "block", "doc_id", "shingles")
    hosts = pairs.select("host.cluster", "host.block", "batch").distinct()
    left = hosts.join(members, ["cluster", "block"]).select("cluster", "block", "batch", F.lit(0).alias("side"), "doc_id", "shingles")
    guests = pairs.where("batch >= 0").select(F.col("host.cluster").alias("host_cluster"), F.col("host.block").alias("host_block"), "batch", "guest.cluster", "guest.block")
    right = guests.join(members, ["cluster", "block"]).select(F.col("host_cluster").alias("cluster"), F.col("host_block").alias("block"), "batch", F.lit(1).alias("side"), "doc_id", "shingles")
    links = _verify(left.unionByName(right), percent)
    links = stage_table(spark, links.unionByName(copied.select(F.col("first").alias("a"), F.col("doc_id").alias("b"))), "linked")
    drop_tables(spark, copies, copied, shared, of, *used, meeting, wanted, blocked, sets, boxes, pairs)
    return facts.select("doc_id", "n"), links


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) for every row.

    Null and blank texts have an empty set and link with nothing. Repeated rows
    are returned as often as they come. Extra columns are ignored; no rows give
    no rows.
    """
    sizes, links = similar_links(docs, width, percent)
    groups = connected_components(links)
    return sizes.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
