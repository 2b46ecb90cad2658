"""Column roles: choices that are made from names while a plan is built, and cost nothing when it runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leakage_screen(df: DataFrame, ids: Sequence[str], safe: Sequence[str], labels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Ids, columns that start as a safe one does, and labels; and the names of all others, which go."""
    kept = [c for c in df.columns if c in ids or c.startswith((*safe, *labels))]
    return df.select(*kept), [c for c in df.columns if c not in kept]


def feature_frame(df: DataFrame, drop: Sequence[str], prefixes: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numbers and flags as doubles, without ids and what belongs to targets."""
    out = []
    for f in df.schema:
        if f.name in keep:
            out.append(F.col(f.name))
        elif f.name not in drop and not f.name.startswith(tuple(prefixes)) and f.dataType.simpleString() not in ("string", "date", "timestamp", "timestamp_ntz"):
            out.append(F.col(f.name).cast("double").alias(f.name))
    return df.select(*out)


def eligible(df: DataFrame, modalities: Sequence[str]) -> DataFrame:
    return df.where(reduce(lambda a, b: a & b, (F.col(f"has_{m}") > 0 for m in modalities)))


def group_features(columns: Sequence[str], keywords: Mapping[str, Sequence[str]], default: str = "other") -> dict[str, list[str]]:
    """Columns by the first group of which a keyword is in the name."""
    out: dict[str, list[str]] = {}
    for c in columns:
        group = next((g for g, words in keywords.items() if any(w in c for w in words)), default)
        out.setdefault(group, []).append(c)
    return out


def ablation_sets(groups: Mapping[str, Sequence[str]]) -> dict[str, list[str]]:
    """All columns, all without one group, and one group alone."""
    everything = [c for g in groups.values() for c in g]
    sets = {"full": everything}
    for name, columns in groups.items():
        sets[f"without_{name}"] = [c for c in everything if c not in columns]
        sets[f"only_{name}"] = list(columns)
    return sets


def standardize(df: DataFrame, mapping: Mapping[str, str], required: Sequence[str]) -> DataFrame:
    """Standard names, every source column as src__, and no row that lacks a required one."""
    out = df.select(*(F.col(s).alias(n) for n, s in mapping.items()), *(F.col(c).alias(f"src__{c}") for c in df.columns))
    return out.dropna(subset=list(required))


def neutralize(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in columns})


def custom_order(c: Column, order: Sequence[str]) -> Column:
    """Places of known values; unknown ones come after them."""
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(c == v, i).otherwise(out)
    return out
