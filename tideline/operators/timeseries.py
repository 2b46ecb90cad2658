"""Ordered analytics by entity: spines, fills, averages, streaks, targets, splits and as-of joins.

Every window is partitioned by entity first, so one shuffle on the entity
serves all of them. ``e`` is the entity column and ``t`` the order column.
Averages, fills and as-of joins, which reach back without bound, cut entities
with many rows into chunks of time: what a chunk leaves behind is carried over
the chunks (a few hundred rows an entity), so an entity may hold any share of
the rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.sources.shared import staged

CHUNK_ROWS = 1 << 18  # an entity with more rows is cut into chunks of time
CHUNKS = 256


def _spread(df: DataFrame, e: str, t: str, step: str, held: Sequence[str] = ()) -> DataFrame:
    """Each row, and rows without values for the steps up to the entity's next row; ``held`` columns keep theirs.

    Only the given rows are shuffled; the steps between them are made where
    their row lies, so nothing of the grid's size is moved, sorted or joined.
    """
    known = df.where(F.col(t).isNotNull()).withColumn("_next", F.lead(t).over(by(e, t)))
    last = F.greatest(F.col(t), (F.col("_next") - F.expr(step)).cast(df.schema[t].dataType))
    steps = known.select("*", F.posexplode(F.sequence(F.col(t), last, F.expr(step))).alias("_nth", "_step"))
    # Rows without an entity span a grid, but their values belong to nobody.
    own, first = F.col(e).isNotNull(), F.col("_nth") == 0
    return steps.select(e, F.col("_step").alias(t), *(F.when(own if c in held else own & first, F.col(c)).alias(c) for c in df.columns if c not in (e, t)))


def spine(df: DataFrame, e: str, day: str) -> DataFrame:
    """A row for each entity and day from its first to its last; values are null where a day had none."""
    return _spread(df, e, day, "interval 1 day")


def slot_spine(df: DataFrame, e: str, slot: str, minutes: int = 15, held: Sequence[str] = ()) -> DataFrame:
    """As spine, with slots of some minutes, on one grid; ``held`` columns keep their value up to the next slot that has a row."""
    return _spread(df, e, slot, f"interval {minutes} minutes", held)


def by(e: str | Sequence[str], *order) -> Window:
    return Window.partitionBy(*([e] if isinstance(e, str) else e)).orderBy(*order)


def rolling(c: Column, fn, rows: int, w: Window, least: int = 1) -> Column:
    """An aggregate over the last rows, null where fewer than ``least`` of them have a value."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) >= least, fn(c).over(frame))


def latest_wins(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """One row for each key, the first in the given order (which must break all ties)."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def time_chunks(df: DataFrame, e: str, t: str, rows: int = CHUNK_ROWS) -> tuple[DataFrame, bool]:
    """The rows with ``_chunk``, and whether there is more than one: entities with more than ``rows`` rows are cut at quantiles of their times.

    Rows of one time share a chunk, and chunks are in the order of time.
    """
    large = df.groupBy(e).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(e)
    if not large.head(1):
        return df.withColumn("_chunk", F.lit(0)), False
    cuts = F.percentile_approx(t, [k / CHUNKS for k in range(1, CHUNKS)], 4 * CHUNKS)
    edges = df.select(e, t).join(large, e, "left_semi").groupBy(e).agg(cuts.alias("_edges"))
    chunk = F.coalesce(F.size(F.filter("_edges", lambda x: x < F.col(t))), F.lit(0))
    return df.join(edges, e, "left").withColumn("_chunk", F.when(F.col("_edges").isNull(), 0).otherwise(chunk)).drop("_edges"), True


def carried(df: DataFrame, e: str, order: Sequence[str], value: Column, out: str, many: bool, ahead: bool = False) -> DataFrame:
    """The last known value up to each row of time_chunks (or the next one from it): inside the chunk, else of the nearest chunk that has one."""
    way = [F.desc(c) for c in order] if ahead else [F.asc(c) for c in order]
    df = df.withColumn("_v", value)
    inside = F.last("_v", ignorenulls=True).over(Window.partitionBy(e, "_chunk").orderBy(*way).rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn(out, inside)
    if not many:
        return df.drop("_v")
    key = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    ends = df.groupBy(e, "_chunk").agg(pick("_v", F.when(F.col("_v").isNotNull(), key)).alias("_end"))
    side = Window.partitionBy(e).orderBy(F.desc("_chunk") if ahead else F.asc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    brought = ends.select(e, "_chunk", F.last("_end", ignorenulls=True).over(side).alias("_brought"))
    return df.join(brought, [e, "_chunk"], "left").withColumn(out, F.coalesce(out, "_brought")).drop("_v", "_brought")


def numbered(df: DataFrame, e: str, t: str, out: str, many: bool) -> DataFrame:
    """Row numbers by time of each entity of time_chunks, from 1."""
    df = df.withColumn(out, F.row_number().over(by([e, "_chunk"], t)).cast("long"))
    if not many:
        return df
    sizes = df.groupBy(e, "_chunk").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(e).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(e, "_chunk", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return df.join(starts, [e, "_chunk"]).withColumn(out, F.col(out) + F.col("_before")).drop("_before")


def carried_ema(df: DataFrame, e: str, t: str, value: str, spans: Sequence[int], rows: int = CHUNK_ROWS) -> DataFrame:
    """Recursive averages without adjustment, for each span: a null carries the last average and fades its weight.

    A known value x makes of the last average a the average r a + (1 - r) x,
    where r depends on the nulls between alone. So inside a chunk each average
    is a multiple of the chunk's first average plus a constant, whatever came
    before: tasks walk chunks apart, what chunks make of an average is carried
    over the entity's chunks, and the rows' averages follow. Gives e, t, value
    and ``ema_`` columns.
    """
    kept, many = time_chunks(df.select(e, t, F.col(value).cast("double").alias(value)), e, t, rows)
    alphas = [2.0 / (s + 1.0) for s in spans]
    parts = [f"{p}{s}" for s in spans for p in ("_p", "_q")]
    # _led: nulls before the chunk's first value _x0 (all of them where it has none); _gap: nulls since the last value.
    schema = T.StructType([*kept.schema, T.StructField("_led", T.LongType()), T.StructField("_x0", T.DoubleType()), T.StructField("_gap", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in parts)])

    def walk(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, led, x0, gap, maps = None, 0, None, 0, []
        for batch in batches:
            out = []
            for key, c, x in zip(batch[e], batch["_chunk"], batch[value], strict=True):
                if (key, c) != chunk:
                    chunk, led, x0, gap, maps = (key, c), 0, None, 0, [(1.0, 0.0)] * len(alphas)
                if x != x:
                    led, gap = led + (x0 is None), gap + 1
                elif x0 is None:
                    x0, gap = x, 0
                else:
                    after = []
                    for alpha, (p, q) in zip(alphas, maps, strict=True):
                        faded = (1 - alpha) ** (gap + 1)
                        r = faded / (faded + alpha)
                        after.append((r * p, r * q + (1 - r) * x))
                    maps, gap = after, 0
                out.append((led, x0, gap, *(v for m in maps for v in m)))
            added = pd.DataFrame(out, columns=["_led", "_x0", "_gap", *parts], index=batch.index)
            yield pd.concat([batch, added], axis=1)

    walked = kept.repartition(e, "_chunk").sortWithinPartitions(e, "_chunk", t).mapInPandas(walk, schema)
    if not many:
        return walked.select(e, t, value, *(F.when(F.col("_x0").isNotNull(), F.col(f"_p{s}") * F.col("_x0") + F.col(f"_q{s}")).alias(f"ema_{s}") for s in spans))
    walked = staged(walked, "ema-chunks")
    ends = walked.groupBy(e, "_chunk").agg(F.count("*").alias("_n"), F.max_by(F.struct("_led", "_x0", "_gap", *parts), t).alias("_end")).select(e, "_chunk", "_n", "_end.*")
    firsts = [f"_a{s}" for s in spans]
    carry_schema = T.StructType([ends.schema[e], ends.schema["_chunk"], *(T.StructField(f"{p}{s}", T.DoubleType()) for s in spans for p in ("_in", "_a"))])

    def carry(chunks: pd.DataFrame) -> pd.DataFrame:
        """Of an entity's chunks, at most a few hundred: the average before each, and that of its first value."""
        out, states = [], [(None, 1.0)] * len(spans)
        for row in chunks.sort_values("_chunk").to_dict("records"):
            known, after, line = row["_x0"] == row["_x0"] and row["_x0"] is not None, [], []
            for s, alpha, (avg, weight) in zip(spans, alphas, states, strict=True):
                line.append(avg)
                if not known:
                    line.append(None)
                    after.append((avg, weight * (1 - alpha) ** row["_n"] if avg is not None else 1.0))
                    continue
                faded = weight * (1 - alpha) ** (row["_led"] + 1)
                first = row["_x0"] if avg is None else (faded * avg + alpha * row["_x0"]) / (faded + alpha)
                line.append(first)
                after.append((row[f"_p{s}"] * first + row[f"_q{s}"], (1 - alpha) ** row["_gap"]))
            out.append((row[e], row["_chunk"], *line))
            states = after
        return pd.DataFrame(out, columns=[f.name for f in carry_schema])

    states = ends.groupBy(e).applyInPandas(carry, carry_schema)
    averages = [F.when(F.col("_x0").isNull(), F.col(f"_in{s}")).otherwise(F.col(f"_p{s}") * F.col(first) + F.col(f"_q{s}")).alias(f"ema_{s}") for s, first in zip(spans, firsts, strict=True)]
    return walked.join(states, [e, "_chunk"]).select(e, t, value, *averages)


def interpolate(df: DataFrame, e: str, t: str, value: str, limit: int = 8, rows: int = CHUNK_ROWS) -> DataFrame:
    """Linear between known values, and the last one after them, for the first ``limit`` nulls of each gap."""
    v = F.col(value)
    out, many = time_chunks(df, e, t, rows)
    out = numbered(out, e, t, "_i", many)
    known = F.when(v.isNotNull(), F.struct(F.col("_i").alias("i"), v.alias("v")))
    out = carried(carried(out, e, [t], known, "_a", many), e, [t], known, "_b", many, ahead=True)
    a, b, i = F.col("_a"), F.col("_b"), F.col("_i")
    between = a["v"] + (b["v"] - a["v"]) * (i - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    filled = F.when(v.isNotNull(), v).when(a.isNotNull() & (i - a["i"] <= limit), F.when(b.isNull(), a["v"]).otherwise(between))
    return out.withColumn(f"{value}_filled", filled).drop("_i", "_a", "_b", "_chunk")


def forward_fill(df: DataFrame, e: str, t: str, value: str, out: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """The last known value up to each row."""
    cut, many = time_chunks(df, e, t, rows)
    return carried(cut, e, [t], F.col(value), out, many).drop("_chunk")


def streak(df: DataFrame, e: str, t: str, flag: Column, out: str) -> DataFrame:
    """Length of the run of true flags up to each row; 0 where the flag isn't true."""
    on = F.coalesce(flag, F.lit(False))
    w = by(e, t)
    df = df.withColumn("_on", on).withColumn("_run", F.sum((~on).cast("int")).over(w))
    return df.withColumn(out, F.when(F.col("_on"), F.sum(F.col("_on").cast("int")).over(by([e, "_run"], t))).otherwise(0).cast("long")).drop("_on", "_run")


def next_targets(df: DataFrame, e: str, t: str, columns: Sequence[str], h: int = 1, categories: Sequence[str] = ()) -> DataFrame:
    """Values h rows ahead, their differences, the days to them, and whether that gap is as expected.

    Of categories, the next one and whether it is the same (null where either is null).
    """
    w = by(e, t)
    for c in categories:
        df = df.withColumn(f"y_next_{c}", F.lead(c, h).over(w)).withColumn(f"y_same_{c}", F.col(f"y_next_{c}") == F.col(c))
    for c in columns:
        df = df.withColumn(f"y_next_{c}", F.lead(c, h).over(w)).withColumn(f"y_delta_next_{c}", F.col(f"y_next_{c}") - F.col(c))
    days = F.datediff(F.lead(t, h).over(w), t)
    return df.withColumn("days_to_next", days.cast("long")).withColumn("is_gap_expected", F.abs(F.col("days_to_next") - h) <= 0.5).where(F.col("days_to_next").isNotNull())


def temporal_split(df: DataFrame, e: str, t: str, out: str = "split") -> DataFrame:
    """First 80, next 10 and last 10 per cent of an entity's rows; 70, 15 and 15 under 30 rows; all train under 10."""
    nth, n = F.row_number().over(by(e, t)) - 1, F.count("*").over(Window.partitionBy(e))
    train = F.when(n < 10, n).when(n < 30, F.floor(0.7 * n)).otherwise(F.floor(0.8 * n))
    val = F.when(n < 10, n).when(n < 30, F.floor(0.85 * n)).otherwise(F.floor(0.9 * n))
    return df.withColumn(out, F.when(nth < train, "train").when(nth < val, "val").otherwise("test"))


def asof_backward(left: DataFrame, right: DataFrame, e: str, t: str, id_: str, columns: Sequence[str], seconds: int | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """For each left row the latest right row of its entity that is not later, unless older than ``seconds``.

    Both sides become one ordered stream, so no pairs are formed. Among right
    rows of one time the largest id counts; a right row of the same time as a
    left row is not later than it.
    """
    picked = F.struct(F.col(t).alias("t"), *(F.col(c).alias(c) for c in columns))
    nothing = F.lit(None).cast(right.select(picked).schema[0].dataType)
    both = left.withColumn("_side", F.lit(1)).withColumn("_right", nothing).unionByName(right.select(e, t, id_, F.lit(0).alias("_side"), picked.alias("_right")), allowMissingColumns=True)
    both, many = time_chunks(both, e, t, rows)
    found = carried(both, e, [t, "_side", id_], F.col("_right"), "_last", many).where("_side = 1")
    age = F.unix_timestamp(F.col(t).cast("timestamp")) - F.unix_timestamp(F.col("_last.t").cast("timestamp"))
    good = F.lit(True) if seconds is None else age <= seconds
    return found.select(*left.columns, *(F.when(good, F.col(f"_last.{c}")).alias(f"asof_{c}") for c in columns), F.when(good, age).alias("asof_age"))
