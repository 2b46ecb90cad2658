"""Toxicity scores from a learned lexicon, matched through Levenshtein automata.

The lexicon holds the words that labelled toxic documents have far more often
than others. A word is matched by walking the lexicon's trie and the Levenshtein
automata of all its terms together, one letter at a time, so misspellings
within a bounded distance are found; a misspelling weighs what its term weighs,
times how reliable matches of its distance to terms of that weight are on rows
that the lexicon has not seen.
Each match is judged by its window: between quotation marks or next to words
that clean documents put around such terms it counts as quoted, and quoted
matches can only lower the score. A logistic model over a document's sums gives
the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Memo, fold, in_sample, sample_share, stage_table

FEATURES = ("hits", "strongest", "density", "quoted")
QUOTES = frozenset("\"'«»“”‘’„`")
LETTERS = re.compile(r"[^\W\d_]+")
# Characters that stand for letters in disguised spellings.
DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
DISGUISED = re.compile(r"[^\W\d_][013457@$!]|[013457@$!][^\W\d_]")
STATES_KEPT = 60_000


def edits_of_length(n: int) -> int:
    """Edits allowed for a term: none below 5 letters, one below 9, else two."""
    return 0 if n < 5 else 1 if n < 9 else 2


class State:
    """A state of the walk: the next states by letter, and the least distance and heaviest weight of the terms that end here."""

    __slots__ = ("best", "places", "then")

    def __init__(self, places: dict[int, int], best: tuple[int, float] | None):
        self.places, self.best, self.then = places, best, {}


class FuzzyLexicon:
    """The trie of the terms intersected with their Levenshtein automata, determinised as words need it.

    A place is a trie node with the least edits that lead there. A state is a
    set of places, so all terms are followed at once, and a word whose state is
    empty is given up. States are made when a word first leads to them and are
    shared by all words with the same beginnings; beyond ``STATES_KEPT`` of
    them the walk begins anew with none, which costs time only. With
    ``beginning`` a term matches the beginning of a word.
    """

    def __init__(self, terms: dict[str, float], beginning: bool = False):
        self.beginning = beginning
        self.children: list[dict[str, int]] = [{}]
        self.allowed, self.weight, self.most = [0], [0.0], [0]
        for term, weight in terms.items():
            if not (edits := edits_of_length(len(term))):
                continue
            node = 0
            self.most[0] = max(self.most[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    for x, zero in ((self.allowed, 0), (self.weight, 0.0), (self.most, 0)):
                        x.append(zero)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], edits)
            self.allowed[node], self.weight[node] = edits, max(self.weight[node], weight)
        self._restart()

    def _restart(self) -> None:
        self.states: dict[tuple, State | None] = {}
        self.start = self._state({0: 0} if len(self.children) > 1 else {})

    def _state(self, places: dict[int, int]) -> State | None:
        """The state of these places and of those that leaving out letters of terms leads to."""
        waiting = list(places.items())
        while waiting:
            node, edits = waiting.pop()
            if edits == places[node]:
                for child in self.children[node].values():
                    if edits + 1 <= self.most[child] and edits + 1 < places.get(child, 99):
                        places[child] = edits + 1
                        waiting.append((child, edits + 1))
        if not places:
            return None
        key = tuple(sorted(places.items()))
        if key not in self.states:
            ends = [(e, -self.weight[n]) for n, e in places.items() if self.weight[n] and e <= self.allowed[n]]
            self.states[key] = State(places, min(ends, default=None))
        return self.states[key]

    def _next(self, state: State, letter: str) -> State | None:
        """The state behind a letter: it is the terms' own, stands for another, or is one too many."""
        after: dict[int, int] = {}
        for node, edits in state.places.items():
            if edits < self.most[node] and edits + 1 < after.get(node, 99):
                after[node] = edits + 1
            for own, child in self.children[node].items():
                e = edits + (own != letter)
                if e <= self.most[child] and e < after.get(child, 99):
                    after[child] = e
        state.then[letter] = found = self._state(after)
        return found

    def match(self, word: str) -> tuple[float, int]:
        """Weight and distance of the nearest term (the heaviest of equals), or (0, 0)."""
        if len(self.states) > STATES_KEPT:
            self._restart()
        state, best = self.start, None
        for letter in word:
            if state is None:
                break
            if self.beginning and state.best and (best is None or state.best < best):
                best = state.best
            try:
                state = state.then[letter]
            except KeyError:
                state = self._next(state, letter)
        if state is not None and state.best and (not self.beginning or best is None or state.best < best):
            best = state.best
        return (-best[1], best[0]) if best else (0.0, 0)


@dataclass
class Lexicon:
    """Terms and stems with weights, words near a term that clean texts use, and what stands around quoted terms."""

    terms: dict[str, float]
    stems: dict[str, float] = field(default_factory=dict)
    benign: frozenset[str] = frozenset()
    context: dict[str, float] = field(default_factory=dict)
    window: int = 5
    reliability: dict[tuple[int, float], float] = field(default_factory=dict)

    def __post_init__(self):
        self.stem_sizes = sorted({len(x) for x in self.stems}, reverse=True)
        self.fuzzy, self.fuzzy_stems = FuzzyLexicon(self.terms), FuzzyLexicon(self.stems, beginning=True)

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("terms", "stems", "benign", "context", "window", "reliability")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def weigh_token(self, token: str) -> tuple[float, int]:
        """The heaviest match of a token's words, as they stand and with disguised letters read as what they stand for."""
        if token.isalpha():
            return self.weigh_word(token)
        words = set(LETTERS.findall(token))
        if DISGUISED.search(token):
            words.update(LETTERS.findall(token.translate(DISGUISE)))
        return max(map(self.weigh_word, words), default=(0.0, 0))

    def weigh_word(self, word: str) -> tuple[float, int]:
        """Weight and distance of a word: as a term, by its stem, or as a misspelling of a term or of a stem."""
        if word in self.terms:
            return self.terms[word], 0
        if word in self.benign:
            return 0.0, 0
        for n in self.stem_sizes:
            if word[:n] in self.stems:
                return self.stems[word[:n]], 0
        a, b = self.fuzzy.match(word), self.fuzzy_stems.match(word)
        return min((x for x in (a, b) if x[0]), key=lambda x: (x[1], -x[0]), default=(0.0, 0))

    def trust(self, weight: float, distance: int) -> float:
        """How much of its term's weight a match counts: all, unless unseen clean rows have such matches."""
        return self.reliability.get((distance, weight), 1.0)

    def memo(self) -> Memo:
        """Matches by token, for one task."""
        return Memo(self.weigh_token)

    def hits(self, text: str | None, known: Memo | None = None) -> tuple[list[str], list[tuple[int, float, int, bool]]]:
        """Tokens of a text, and of each match its place, weight, distance and whether it is quoted."""
        tokens = (text or "").lower().split()
        found = list(map((known if known is not None else self.memo()).__getitem__, tokens))
        return tokens, [(i, *x, self.quoted(tokens, i)) for i, x in enumerate(found) if x[0]]

    def quoted(self, tokens: list[str], at: int) -> bool:
        before, after = tokens[max(0, at - self.window) : at], tokens[at + 1 : at + 1 + self.window]
        token = tokens[at]
        opened = token[0] in QUOTES or any(x[0] in QUOTES and x[-1].rstrip(".,;:!?") not in QUOTES for x in before)
        closed = token.rstrip(".,;:!?")[-1:] in QUOTES or any(x.rstrip(".,;:!?")[-1:] in QUOTES for x in after)
        around = sum(self.context.get(x, 0.0) for x in (*before, *after)) if self.context else 0.0
        return (opened and closed) or around > 1.0

    def features(self, text: str | None, known: Memo | None = None) -> tuple[float, ...]:
        """FEATURES of a text. A match counts by its term's weight and the trust in such matches."""
        tokens, hits = self.hits(text, known)
        plain = [w * self.trust(w, d) for _, w, d, q in hits if not q]
        quoted = sum(w * self.trust(w, d) for _, w, d, q in hits if q)
        total = sum(plain)
        return float(np.log1p(total)), max(plain, default=0.0), float(np.log1p(100 * total / max(20, len(tokens)))), float(np.log1p(quoted))


def _labelled(docs: DataFrame, labels: DataFrame, max_docs: int) -> DataFrame:
    """Learning rows, staged: text, toxic and digest; at most about ``max_docs``, by a sample that depends on doc_id alone.

    Of a doc_id with several labels one counts (the toxic one). The sampled
    labels are few whatever the corpus, so they go to the documents and no text
    is shuffled.
    """
    usable = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = sample_share(labels.where(F.col("toxic").isNotNull() & (fold("doc_id", 5) != 0)).count(), max_docs)
    picked = docs.where(fold("doc_id", 5) != 0).where(in_sample("doc_id", share)).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = picked.join(F.broadcast(usable.where(in_sample("doc_id", share))), "doc_id").select("text", "toxic", F.md5(F.encode("text", "UTF-8")).alias("digest"))
    return stage_table(docs.sparkSession, rows, "toxic-rows")


def _words(column: str = "text"):
    return F.regexp_extract_all(F.lower(column), F.lit(r"(\p{L}+)"), 1)


def _ways(texts: DataFrame) -> DataFrame:
    """word and ways, the number of different pairs of neighbours that it has in the texts, with one pair (by its hash) for each text."""
    listed = texts.select("digest", _words().alias("words"))
    places = F.arrays_zip(F.concat(F.array(F.lit("")), "words").alias("before"), F.col("words").alias("word"), F.slice("words", F.lit(2), F.greatest(F.size("words"), F.lit(1))).alias("after"))
    each = listed.select("digest", F.inline(places)).where("word is not null")
    one = each.groupBy("word", "digest").agg(F.min(F.xxhash64("before", "after")).alias("around"))
    return one.select("word", "around").distinct().groupBy("word").agg(F.count("*").alias("ways"))


def learn_lexicon(rows: DataFrame, least_gain: float = 3.0) -> Lexicon:
    """Words by the log of how much oftener toxic documents have them, out of counts over all learning rows.

    ``rows`` has text, toxic and digest. A text counts once for each label it
    has, in the words' counts and in the totals that these are held against. A
    term needs support that grows with the toxic rows, in documents and in
    different pairs of neighbours, which must be three for ten documents at
    least: near copies repeat a word's neighbours, so a word that only copies of
    one document have is no term. A stem is a word beginning that
    several words share and that is as telling by itself. All that reach these
    thresholds are kept; the bounded learning rows bound how many there are.
    """
    spark = rows.sparkSession
    totals = {r["toxic"]: r["count"] for r in rows.select("digest", "toxic").distinct().groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon({})
    texts = rows.dropDuplicates(["digest", "toxic"])
    counts = texts.select("toxic", F.explode(F.array_distinct(_words())).alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    gain = F.ln((F.col("bad") + 0.5) / (bad + 1)) - F.ln((F.col("good") + 0.5) / (good + 1))
    counts = counts.join(_ways(texts.where("toxic = 1")), "word", "left").fillna(0, ["ways"]).withColumn("gain", gain)
    counts = stage_table(spark, counts, "toxic-words")
    support = max(3, bad // 150)
    varied = (F.col("ways") >= max(5, support)) & (F.col("ways") >= 0.3 * F.col("bad"))
    supported = (F.col("bad") >= support) & varied & (F.col("gain") >= least_gain)
    terms = counts.where(supported & (F.length("word") > 2)).select("word", "gain").collect()
    begins = counts.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda n: F.substring("word", F.lit(1), n))).alias("stem"), "word", "bad", "good", "ways").where(F.length("word") > F.length("stem"))
    stems = begins.groupBy("stem").agg(F.count("*").alias("words"), F.max("bad").alias("most"), F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("ways").alias("ways"))
    stems = stems.where((F.col("words") >= 4) & (F.col("bad") >= 3 * support) & varied & (2 * F.col("most") <= F.col("bad")))
    stems = stems.withColumn("gain", gain).where(F.col("gain") >= least_gain).select("stem", "gain").collect()
    draft = Lexicon({r["word"]: float(r["gain"]) for r in terms}, {r["stem"]: float(r["gain"]) for r in stems})
    shared = spark.sparkContext.broadcast(draft)

    @F.pandas_udf("boolean")
    def near(words: pd.Series) -> pd.Series:
        return pd.Series([w not in shared.value.terms and shared.value.weigh_word(w)[0] > 0 for w in words], dtype=bool)

    # Clean texts' own words that lie near a term are no misspellings of it.
    others = counts.where((F.col("good") > 0) & (F.col("gain") < least_gain / 2)).where(near("word")).select("word").collect()
    lexicon = Lexicon(draft.terms, draft.stems, frozenset(r["word"] for r in others))
    lexicon.context = learn_context(rows, lexicon)
    return lexicon


def learn_reliability(rows: DataFrame, lexicon: Lexicon, prior: float = 1.0, least: float = 0.02) -> dict[tuple[int, float], float]:
    """By distance and term weight, how telling such misspellings are on unseen rows, as a share of what terms weigh on average.

    Terms of one weight have the same counts, so they share an entry. Terms that
    lie among clean texts' own words lose their misspellings and others keep
    theirs: what some terms' neighbours are says nothing of the rest. ``prior``
    documents speak for a share of 1, so a misspelling that unseen rows don't
    have counts in full; a share is never under ``least``.
    """
    if not lexicon.terms:
        return {}
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<struct<d:int,w:double>>")
    def misspelt(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = shared.value.memo()
        for texts in batches:
            yield pd.Series([[{"d": d, "w": w} for d, w in sorted({(d, w) for _, w, d, q in shared.value.hits(x, known)[1] if d and not q})] for x in texts], dtype=object)

    seen = stage_table(rows.sparkSession, rows.select("toxic", misspelt("text").alias("m")), "toxic-distances")
    totals = seen.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    bad, good = (totals[0] or 0) + 1, (totals[1] or 0) + 1
    mean, out = float(np.mean(list(lexicon.terms.values()))), {}
    for r in seen.select("toxic", F.inline("m")).groupBy("d", "w").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).collect():
        gain = np.log((r["bad"] + 0.5) / bad) - np.log((r["good"] + 0.5) / good)
        n = r["bad"] + r["good"]
        out[(r["d"], r["w"])] = max(least, float((n * min(1.0, max(0.0, gain / mean)) + prior) / (n + prior)))
    return out


def learn_context(rows: DataFrame, lexicon: Lexicon, least: int = 20) -> dict[str, float]:
    """Words around terms, by the log of how much oftener they stand there in clean documents.

    They are learned only if at least ``least`` clean windows exist.
    """
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("array<string>")
    def around(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = shared.value
        known, n = lexicon.memo(), lexicon.window
        for texts in batches:
            out = []
            for text in texts:
                tokens, hits = lexicon.hits(text, known)
                out.append([t for i, _, d, _ in hits if not d for t in {*tokens[max(0, i - n) : i], *tokens[i + 1 : i + 1 + n]}])
            yield pd.Series(out, dtype=object)

    seen = rows.select("toxic", F.explode(around("text")).alias("word")).groupBy("word").agg(F.sum(1 - F.col("toxic")).alias("good"), F.sum("toxic").alias("bad"))
    seen = stage_table(rows.sparkSession, seen.where(F.col("good") >= 3), "toxic-context")
    good, bad = seen.agg(F.sum("good"), F.sum("bad")).first()
    if (good or 0) < least * lexicon.window:
        return {}
    gain = F.ln((F.col("good") + 0.5) / (good + 1)) - F.ln((F.col("bad") + 0.5) / (bad + 1))
    return {r["word"]: float(r["gain"]) for r in seen.select("word", gain.alias("gain")).where("gain > 1").collect()}


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of FEATURES: the first three are 0 at least, that of quoted matches 0 at most."""

    lexicon: Lexicon
    weights: tuple[float, ...]
    bias: float


def learn(docs: DataFrame, labels: DataFrame, max_docs: int = 40_000) -> ToxicityModel:
    """Lexicon and logistic model from labelled learning rows; ``max_docs`` bounds how many.

    The lexicon comes from two thirds of the rows, by their text, and the model
    is fitted on the rest, which the lexicon has not seen (with under ten rows
    of a label there, both come from all rows). The weights are bounded by their meaning: no match lowers the score of a
    text, but for quoted ones, which never raise it. Without both labels among
    the rows the model gives 0.5 or the sole label's rate.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    spark = docs.sparkSession
    rows = _labelled(docs, labels, max_docs)
    third = F.pmod(F.xxhash64("digest", F.lit("fit")), F.lit(3)) == 0
    sizes = [r["count"] for r in rows.where(third).groupBy("toxic").count().collect()]
    apart = len(sizes) == 2 and min(sizes) >= 10
    lexicon = learn_lexicon(rows.where(~third) if apart else rows)
    if apart:
        rows = rows.where(third)
        lexicon.reliability = learn_reliability(rows, lexicon)
    described = rows.select("toxic", describer(spark, lexicon)("text").alias("f"))
    described = stage_table(spark, described.select(F.col("toxic").cast("double").alias("label"), "f.*"), "toxic-features")
    totals = {int(r["label"]): r["count"] for r in described.groupBy("label").count().collect()}
    if len(totals) < 2:
        return ToxicityModel(lexicon, (0.0,) * len(FEATURES), 0.0 if not totals else 5.0 if 1 in totals else -5.0)
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(described)
    least, most = ([0.0] * 3 + [-50.0], [50.0] * 3 + [0.0])
    bounds = {"lowerBoundsOnCoefficients": DenseMatrix(1, 4, least), "upperBoundsOnCoefficients": DenseMatrix(1, 4, most)}
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=0.001, maxIter=60, **bounds).fit(data)
    return ToxicityModel(lexicon, tuple(map(float, model.coefficients)), float(model.intercept))


def describer(spark: SparkSession, lexicon: Lexicon):
    """A column function from texts to FEATURES."""
    shared = spark.sparkContext.broadcast(lexicon)

    @F.pandas_udf(", ".join(f"{f} double" for f in FEATURES))
    def describe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = shared.value.memo()
        for texts in batches:
            yield pd.DataFrame([shared.value.features(x, known) for x in texts], columns=list(FEATURES))

    return describe


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """All columns and ``toxicity`` from 0 to 1 (a column of that name is replaced).

    Null and empty texts get the score of a text without matches. Whole texts
    are read, however long; repeated rows give equal scores, and no rows none.
    """
    f = describer(docs.sparkSession, model.lexicon)(F.col("text").cast("string"))
    margin = F.lit(model.bias)
    described = docs.drop("toxicity", "_toxic").withColumn("_toxic", f)
    for name, weight in zip(FEATURES, model.weights, strict=True):
        margin = margin + weight * F.col("_toxic")[name]
    return described.withColumn("toxicity", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), margin))))).drop("_toxic")
