"""Readers for device and log exports, all with explicit schemas and null for what can't be read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_device_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV files whose first line is a banner and whose second names the columns.

    A file's first line is the least of its first block; the names are told by
    what they hold. So it doesn't matter how files are dealt to tasks.
    """
    names = ",".join(schema.names)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    banners = lines.where("block = 0").groupBy("file").agg(F.min("at").alias("at"))
    body = lines.join(banners, ["file", "at"], "left_anti").where((F.trim("value") != "") & ~F.regexp_replace("value", " ", "").startswith(names))
    row = F.from_csv("value", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    return body.select(row.alias("r")).select("r.*")


def read_log_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")


def parse_kv_entries(c: Column) -> Column:
    """A map from text like [a=1, b={x,y}, c=[1,2]], split at top-level commas (one level of nesting)."""
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    tokens = F.regexp_extract_all(inner, F.lit(r"([A-Za-z_][A-Za-z0-9_]*=(?:\{[^}]*\}|\[[^\]]*\]|[^,{\[]*))"), 1)
    pairs = F.transform(tokens, lambda t: F.struct(F.split_part(t, F.lit("="), F.lit(1)).alias("k"), F.trim(F.regexp_replace(t, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(pairs)


def zip_keys_values(keys: Column, values: Column) -> Column:
    """A map from parallel lists in text; missing values are null."""
    return F.map_from_entries(F.filter(F.arrays_zip(F.transform(F.split(keys, ","), lambda x: F.trim(x)).alias("k"), F.transform(F.split(values, ","), lambda x: F.trim(x)).alias("v")), lambda x: x["k"].isNotNull()))


def parse_export(entries: Column, keys: Column, values: Column) -> Column:
    return F.coalesce(parse_kv_entries(entries), zip_keys_values(keys, values))


def json_fields(c: Column, schema: str) -> Column:
    """Typed fields of a JSON text; null fields on bad JSON."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def canonical_events(df: DataFrame, mapping: Mapping[str, tuple[str, str]], required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Renamed and coerced columns, without rows that lack a required one, one row for each key."""
    cast = [F.col(source).cast("string").try_cast(kind).alias(name) for name, (source, kind) in mapping.items()]
    return df.select(*cast).dropna(subset=list(required)).dropDuplicates(list(keys))


def columnar_json_rows(c: Column, fields: Mapping[str, str]) -> Column:
    """Rows from JSON that holds one array for each field: an array of structs to inline."""
    schema = "struct<" + ",".join(f"{k}:array<{v}>" for k, v in fields.items()) + ">"
    parsed = F.from_json(c, schema)
    return F.arrays_zip(*(parsed[k].alias(k) for k in fields))


def read_review_batches(spark: SparkSession, root: str, kinds: Sequence[str], schema: T.StructType) -> DataFrame:
    """All reviews below a root of folders, tagged by folder; folders that lack a kind are left out. A kind is a file, or a folder of part files."""
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).json(root).withColumn("_path", F.regexp_replace(F.col("_metadata.file_path"), r"(\.[a-z]+)/part-[^/]*$", "$1"))
    rows = rows.withColumn("folder", F.regexp_extract("_path", r"([^/]+)/[^/]+$", 1)).withColumn("kind", F.regexp_extract("_path", r"/([^/.]+)\.[^/]*$", 1)).drop("_path")
    complete = rows.where(F.col("kind").isin(*kinds)).groupBy("folder").agg(F.count_distinct("kind").alias("n")).where(F.col("n") == len(kinds)).select("folder")
    return rows.join(complete, "folder", "left_semi")


def snapshot_or_seed(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows by key from the first of some tables that has it."""
    out = None
    for priority, t in enumerate(tables):
        t = t.withColumn("_priority", F.lit(priority))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    best = out.groupBy(key).agg(F.min_by(F.struct(*[c for c in out.columns if c not in (key, "_priority")]), "_priority").alias("_best"))
    return best.select(key, "_best.*")


def source_profile(df: DataFrame, time: str, day: str, key: str) -> DataFrame:
    """What speaks for a table as a source: usable times, keys and rows a day."""
    return df.agg(F.count("*").alias("n_rows"), F.avg(F.col(time).cast("string").try_cast("timestamp_ntz").isNotNull().cast("double")).alias("time_rate"), F.avg(F.col(key).isNotNull().cast("double")).alias("key_rate"), F.count_distinct(day).alias("n_days")).withColumn("rows_per_day", F.col("n_rows") / F.greatest(F.col("n_days"), F.lit(1)))


# Points of a source's score. The bands of rows a day go up to their bound; beyond the last, each row a day costs.
ROLE_POINTS = {"id": 4.0, "time": 3.0, "day": 3.0, "order": 1.0}
HIT_POINTS, PAIR_POINTS, LABEL_POINTS, COUNT_POINTS, PARSED_POINTS = 2.0, 4.0, 2.0, 1.0, 2.0
COUNT_RANGE = (50, 500_000)
DENSITY_POINTS, DENSE_FROM, DENSE_COST, DENSE_MOST = ((1, -3.0), (12, 8.0), (24, 1.0)), 24.0, 0.35, 18.0


def rank_sources(profiles: DataFrame) -> DataFrame:
    """Profiles with a score and a place, best first (ties by name).

    ``profiles`` has a row for each source: name, boost (what its name is
    worth), has_id, has_time, has_day, has_order, hits (how many columns of
    meaning it has), has_pair, has_label, n_rows, time_rate and rows_per_day.
    """
    roles = reduce(lambda a, b: a + b, (F.when(F.col(f"has_{k}"), v).otherwise(0.0) for k, v in ROLE_POINTS.items()))
    meaning = HIT_POINTS * F.col("hits") + F.when(F.col("has_pair"), PAIR_POINTS).otherwise(0.0) + F.when(F.col("has_label"), LABEL_POINTS).otherwise(0.0)
    usable = F.when(F.col("n_rows").between(*COUNT_RANGE), COUNT_POINTS).otherwise(0.0) + F.when(F.col("has_time"), PARSED_POINTS * F.col("time_rate")).otherwise(0.0)
    rate = F.col("rows_per_day")
    density = reduce(lambda out, band: out.when(rate <= band[0], band[1]), DENSITY_POINTS, F.when(rate.isNull(), 0.0)).otherwise(-F.least(F.lit(DENSE_MOST), DENSE_COST * (rate - DENSE_FROM)))
    scored = profiles.withColumn("score", F.col("boost") + roles + meaning + usable + density)
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "name")).cast("long"))  # one row for each source


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), kind: str = "parquet") -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).format(kind).save(path)
