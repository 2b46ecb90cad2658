"""Quality rules as learned decision lists, in DataFrame operations only.

Sequential covering learns one rule after another. A rule grows by the
threshold condition that gains most information on growing rows, is pruned on
pruning rows by dropping conditions from its end, and then covers what it
matches; the next rule learns from the rest. Every step is one aggregation
over a small table of binned statistics. The list becomes one ordered
conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import SPACE, WORD, in_sample, sample_share, stage_table

STATISTICS = ("n_words", "mean_word", "symbol_share", "upper_share", "digit_share", "exclaim_share", "bar_share", "dup_line_share", "repeat_share", "line_words", "distinct_share", "n_lines")


def _letters_only(text: Column, kept: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{kept}]+", ""))


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``base``: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole text.

    Words are what stands between ASCII white space. A null text has none of
    anything. Three-word windows are compared as words, not by hashes; sorting
    a text's windows brings equal ones together, so a text of n words costs
    about n log n steps and never n squared. Repeated rows have equal statistics,
    and no rows give none. Columns called base, stats, base_failed, rule or
    kept are replaced, and _words, _text, _lines, _sorted and _twice dropped.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    staged = docs.drop("base", "_words", "_text", "_lines", "_sorted").withColumn("_text", whole)
    staged = staged.withColumn("_words", F.regexp_extract_all("_text", F.lit(f"({WORD})"), 1)).withColumn("_lines", F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD)))
    n = F.size("_words")
    # One entry for each window, with its place last; words are first brought to small numbers by hashing pairs of them.
    numbers = F.sequence(F.lit(0), n - 3)
    windows = F.arrays_zip(F.slice("_words", 1, n - 2).alias("a"), F.slice("_words", 2, n - 2).alias("b"), F.slice("_words", 3, n - 2).alias("c"), numbers.alias("i"))
    staged = staged.withColumn("_sorted", F.when(n >= 3, F.sort_array(windows)))
    count = F.size("_sorted")
    nexts = F.slice("_sorted", 2, count)
    twice = F.filter(
        F.arrays_zip(F.slice("_sorted", 1, count - 1).alias("x"), nexts.alias("y")),
        lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]),
    )
    staged = staged.withColumn("_twice", F.when(count >= 2, twice))
    covered = F.array_distinct(F.flatten(F.transform("_twice", lambda p: F.array(p["x"]["i"], p["x"]["i"] + 1, p["x"]["i"] + 2, p["y"]["i"], p["y"]["i"] + 1, p["y"]["i"] + 2))))
    base = F.struct(
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        _letters_only(F.col("_text"), r"#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("_twice") > 0, F.size(covered)).otherwise(0).cast("long").alias("n_repeat_words"),
    )
    return staged.withColumn("base", base).drop("_sorted", "_twice")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, ``base``, and ``stats`` with the numbers that rules are about."""
    staged = base_statistics(docs, text)
    b = F.col("base")
    words, chars, lines = F.greatest(b["n_words"], F.lit(1)), F.greatest(b["word_chars"], F.lit(1)), F.greatest(F.size("_lines"), F.lit(1))
    stats = F.struct(
        b["n_words"].cast("double").alias("n_words"),
        (b["word_chars"] / words).alias("mean_word"),
        (b["n_symbols"] / chars).alias("symbol_share"),
        (_letters_only(F.col("_text"), r"\p{Lu}") / chars).alias("upper_share"),
        (_letters_only(F.col("_text"), "0-9") / chars).alias("digit_share"),
        (_letters_only(F.col("_text"), "!") / chars).alias("exclaim_share"),
        (_letters_only(F.col("_text"), "|") / chars).alias("bar_share"),
        (b["n_dup_lines"] / lines).alias("dup_line_share"),
        (b["n_repeat_words"] / words).alias("repeat_share"),
        (b["n_words"] / lines).alias("line_words"),
        (F.size(F.array_distinct("_words")) / words).alias("distinct_share"),
        F.size("_lines").cast("double").alias("n_lines"),
    )
    return staged.withColumn("stats", stats).drop("_text", "_words", "_lines")


def base_failed() -> Column:
    b = F.col("base")
    return (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    cut: float

    def column(self, of: Column) -> Column:
        x = of[self.name]
        return (x > self.cut) if self.above else (x <= self.cut)


Rule = tuple[Condition, ...]


@dataclass(frozen=True)
class DecisionList:
    """Rules for low quality, each with its precision on learning rows; what no rule matches is kept."""

    rules: tuple[Rule, ...]
    precision: tuple[float, ...]

    def rule_number(self, stats: str = "stats") -> Column:
        """Number of the first rule that matches, or null: an ordered conditional expression."""
        out = F.lit(None).cast("int")
        for number, rule in reversed(list(enumerate(self.rules))):
            out = F.when(_all(rule, F.col(stats)), F.lit(number)).otherwise(out)
        return out

    def __str__(self) -> str:
        return "\n".join(f"{i}: " + " and ".join(f"{c.name} {'>' if c.above else '<='} {c.cut:.4g}" for c in r) + f" (precision {p:.3f})" for i, (r, p) in enumerate(zip(self.rules, self.precision, strict=True)))


def _all(rule: Rule, of: Column) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column(of)
    return out


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """FOIL's information gain of going from (p0, n0) to (p1, n1) covered low and good rows."""
    return p1 * (math.log2(p1 / (p1 + n1)) - math.log2(p0 / (p0 + n0))) if p1 and p0 else -1.0


def learn_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 50_000, bins: int = 24, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.8) -> DecisionList:
    """Learn a list from rows with doc_id and stats, and labels with quality (0 is low).

    ``max_rows`` bounds the labelled rows that are used: a sample that depends
    on doc_id alone. Cuts are quantiles of a statistic. Rows are parted by id
    into growing (two thirds) and pruning rows. Labels of one kind, or none,
    give an empty list, which keeps everything.
    """
    spark = stats.sparkSession
    usable = labels.where("quality is not null").select("doc_id", (F.col("quality") == 0).alias("low")).dropDuplicates(["doc_id"])
    share = sample_share(usable.count(), max_rows)
    rows = stats.where(in_sample("doc_id", share)).join(usable, "doc_id").select("stats", "low", (F.pmod(F.xxhash64("doc_id", F.lit("prune")), F.lit(3)) != 0).alias("grow"))
    rows = stage_table(spark, rows, "quality-rows")
    kinds = {r["low"]: r["count"] for r in rows.groupBy("low").count().collect()}
    if len(kinds) < 2:
        return DecisionList((), ())
    shares = [k / bins for k in range(1, bins)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    quantiles = rows.agg(*(F.percentile_approx(F.col("stats")[s], shares, 10_000).alias(s) for s in STATISTICS)).first()
    low_quantiles = rows.where("low").agg(*(F.percentile_approx(F.col("stats")[s], shares, 10_000).alias(s) for s in STATISTICS)).first()
    cuts = {s: sorted({*quantiles[s], *low_quantiles[s]}) for s in STATISTICS}

    def bin_of(name: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[name])), lambda cut: cut < F.col("stats")[name]))

    rows = stage_table(spark, rows.select("stats", "low", "grow", F.array(*(F.struct(F.lit(s).alias("name"), bin_of(s).alias("bin")) for s in STATISTICS)).alias("bins")), "quality-bins")

    def counted(of: DataFrame) -> list[tuple[Condition, int, int]]:
        """Low and good rows that each condition matches, from their counts by statistic and bin."""
        table = of.select("low", F.inline("bins")).groupBy("name", "bin").agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect()
        out = []
        for name in STATISTICS:
            own = {r["bin"]: (r["p"], r["n"]) for r in table if r["name"] == name}
            total = tuple(sum(x[i] for x in own.values()) for i in (0, 1))
            p = n = 0
            for k, cut in enumerate(cuts[name]):  # bin k holds what lies between the cuts k - 1 and k
                p, n = p + own.get(k, (0, 0))[0], n + own.get(k, (0, 0))[1]
                out += [(Condition(name, False, cut), p, n), (Condition(name, True, cut), total[0] - p, total[1] - n)]
        return out

    def grow(rest: DataFrame) -> Rule:
        rule: Rule = ()
        while len(rule) < most_conditions:
            counts = counted(rest.where("grow").where(_all(rule, F.col("stats"))))
            p0, n0 = counts[0][1] + counts[1][1], counts[0][2] + counts[1][2]
            if not p0 or not n0:
                break
            gain, _, best = max(((_gain(p0, n0, p, n), p, c) for c, p, n in counts), key=lambda x: x[:2])
            if gain <= 0.01:
                break
            rule = (*rule, best)
        return rule

    rules, precision, rest = [], [], rows
    for _ in range(most_rules):
        rule = grow(rest)
        if not rule:
            break
        # Every end of the rule is rated in one pass: on pruning rows to choose it, and on all rows to judge it.
        ends = [rule[:k] for k in range(1, len(rule) + 1)]
        low, good, unseen = F.col("low"), ~F.col("low"), ~F.col("grow")
        cells = {f"{side}{k}{part}": F.count_if(_all(e, F.col("stats")) & of & where) for k, e in enumerate(ends) for side, of in (("p", low), ("n", good)) for part, where in (("u", unseen), ("a", F.lit(True)))}
        r = rest.agg(*(c.alias(name) for name, c in cells.items())).first()
        worth = [((r[f"p{k}u"] - r[f"n{k}u"]) / max(1, r[f"p{k}u"] + r[f"n{k}u"]), r[f"p{k}u"], -k) for k in range(len(ends))]
        chosen = -max(worth)[2]
        rule, p, n = ends[chosen], r[f"p{chosen}a"], r[f"n{chosen}a"]
        hit = _all(rule, F.col("stats"))
        if p < max(3, kinds[True] // 200) or p / (p + n) < least_precision:
            break
        rules.append(rule)
        precision.append(p / (p + n))
        rest = rest.where(~hit)
    return DecisionList(tuple(rules), tuple(precision))


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Rows of with_statistics with base_failed, rule (null: none) and kept."""
    out = docs.withColumn("base_failed", base_failed()).withColumn("rule", rules.rule_number())
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
