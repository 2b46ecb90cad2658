"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams in order. A document is as
far from a language as its own n-grams are out of place in that list, and an
n-gram that the list lacks counts as the whole length of the list.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import fold, in_sample, sample_share

UNKNOWN = "und"
EDGE = 32


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_counts(text: str | None, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a text's words, packed 21 bits a letter, and how often each occurs.

    Letters are lower-cased; whatever lies between words is one edge mark, and
    an n-gram of edge marks alone does not count. No letters give no n-grams.
    """
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letters = _letters()[codes]
    if not letters.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes[~letters] = EDGE
    codes = np.concatenate([[EDGE], codes, [EDGE]])
    codes = codes[np.append(True, (codes[1:] != EDGE) | (codes[:-1] != EDGE))]
    found = []
    for n in orders:
        if len(codes) >= n:
            key = np.zeros(len(codes) - n + 1, np.int64)
            for k in range(n):
                key = (key << 21) | codes[k : k + len(key)]
            found.append(key if n > 1 else key[key != EDGE])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by the n-gram."""
    return keys[np.lexsort((keys, -counts))[:length]]


@dataclass(frozen=True)
class Profiles:
    """Languages in alphabetical order; n-grams in ascending order; and each n-gram's rank in each language."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    length: int
    sharpness: float = 40.0

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the document's n-grams that the language's profile has."""
        keys, counts = gram_counts(text)
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0, 0.0
        own = ranked(keys, counts, self.length)
        at = np.minimum(np.searchsorted(self.grams, own), max(0, len(self.grams) - 1))
        ranks = np.full((len(own), len(self.languages)), self.length)
        known = self.grams[at] == own if len(self.grams) else np.zeros(len(own), bool)
        ranks[known] = self.ranks[at[known]]
        missing = ranks >= self.length
        places = np.where(missing, self.length, np.abs(ranks - np.arange(len(own))[:, None]))
        distance = places.sum(0) / (self.length * len(own))
        best = int(np.argmin(distance))
        score = 1 / np.exp(-self.sharpness * (distance - distance[best])).sum()
        return self.languages[best], float(score), float(1 - missing[:, best].mean())


def learn_profiles(docs: DataFrame, length: int = 400, max_docs: int = 40_000) -> Profiles:
    """Profiles from documents with a language; counts are summed by Spark before the lists are cut.

    ``max_docs`` bounds how many labelled rows are learned from: a sample that
    depends on doc_id alone. Rows without a language or text teach nothing.
    """
    docs = docs.where("lang is not null and text is not null")
    share = sample_share(docs.select("lang").count(), max_docs)
    picked = docs.where(in_sample("doc_id", share)).select("lang", "text")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                parts = [gram_counts(x) for x in texts]
                keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([c for _, c in parts]), len(keys))
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": n.astype(np.int64)})

    counts = picked.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < length).collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    grams = np.unique(np.array([r["gram"] for r in rows], np.int64))
    ranks = np.full((len(grams), len(languages)), length)
    for r in rows:
        ranks[np.searchsorted(grams, r["gram"]), languages.index(r["lang"])] = r["place"]
    return Profiles(languages, grams, ranks, length)


def identify(docs: DataFrame, profiles: Profiles, out: str = "language") -> DataFrame:
    """All columns, and a struct ``out`` of lang_pred, score and known.

    A null text or one without a letter is ``und`` with score 0. A tie goes to
    the language that comes first in the alphabet. A column of the struct's name
    is replaced. Whole texts are read, however long; repeated rows give equal
    answers, and no rows give none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.pandas_udf("lang_pred string, score double, known double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.identify(x) for x in texts], columns=["lang_pred", "score", "known"])

    return docs.withColumn(out, guess(F.col("text").cast("string")))


def learning_rows(docs: DataFrame) -> DataFrame:
    """Rows that profiles may learn from: all but those whose id's crc32 leaves 2 when divided by 4."""
    return docs.where(fold("doc_id", 4) != 2).select("doc_id", "lang", "text")


def accepted(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The documents that are in a language that was learned: some letters, and some n-grams of its profile."""
    return identify(docs, profiles, "_language").where("_language.lang_pred <> 'und' and _language.known > 0").select(docs.columns)
