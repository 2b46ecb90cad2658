"""Personal data by candidate gradient boosting, in DataFrame and SQL functions only.

Base patterns with their checks (Luhn, part and digit counts) give spans that
always stay. Generators with high recall propose more spans, which may overlap.
Boosted trees score these by format and context, and a threshold for each kind
is calibrated on held-out documents; a proposal must also pass its kind's own
check, as base spans do. The trees learn off the base: base spans
are rewritten in their own surroundings into forms that the base patterns don't
match (spelled out, defanged, regrouped) and, as negatives, into look-alikes
that fail their checks; proposals of the texts themselves are negatives too.
Trees are written out as conditional expressions, so scoring runs inside the
scan and moves no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import stage_table

KINDS = ("email", "ip", "card", "phone")
# Base patterns. Possessive repeats and the look-behind give the same matches without rescanning long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A character that every match of a kind holds, and proposals for more spans of each kind.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
PROPOSALS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9._%+-]{1,64}+){0,3}(?: ?[\[(](?:at|AT|@)[\])] ?|@| at | AT )[A-Za-z0-9-]{1,63}(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.| dot | DOT )[A-Za-z0-9-]{2,63}){1,5}",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?: ?[.,] ?|[\[(]\.[\])]| dot )[0-9]{1,3}){3})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,5}){1,3}(?![0-9])",
}
CUES = {
    "email": r"(?i)(mail|contact|write|adress|correo|courriel)",
    "ip": r"(?i)(\bip\b|host|server|client|address|adresse)",
    "card": r"(?i)(card|visa|karte|carte|tarjeta|pay|credit)",
    "phone": r"(?i)(phone|tel|call|fax|mobile|cell|appel|ruf)",
}
FEATURES = ("kind_no", "chars", "digits", "letters", "separators", "kinds_of_separator", "luhn", "small_parts", "parts", "plus_before", "word_before", "word_after", "cue", "digit_share", "first_digit", "dots", "at_sign", "spelled", "range_ok", "capital", "bare_at")
# Written-out or bracketed marks.
SPELLED = r"(?i)[\[(](?:at|dot|@|\.)[\])]|\b(?:at|dot)\b"
# A new sentence behind a full stop; a bare "at" with no dot spelled out.
CAPITAL = r"\.[A-Z][a-z]"
BARE_AT = r"(?i)^(?!.* dot | ?.*[\[(]dot[\])]).* at "
BLOCK = 256
ROWS_A_TASK = 100_000  # distinct learning rows


def _spans(text: Column, kind: str, pattern: str, needs: str) -> Column:
    """Matches of a pattern as structs of kind, start, end (code points, end exclusive) and value."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern, -1)
    # Lengths of the stretch up to each match and of the match itself.
    steps = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m")), lambda x: F.struct(x["m"].alias("m"), F.length(x["g"]).cast("long").alias("g"), F.length(x["m"]).cast("long").alias("n")))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s + x["g"] + x["n"])

    def place(all_steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_steps) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(all_steps, b * BLOCK + 1, F.lit(BLOCK))))

        def one(held: Column) -> Column:
            def span(x: Column, i: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                before = F.aggregate(F.slice(held, 1, block), F.lit(0).cast("long"), lambda s, v: s + v)
                start = before + total(F.slice(all_steps, block * BLOCK + 1, i - block * BLOCK)) + x["g"]
                return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["n"]).alias("end"), x["m"].alias("value"))

            return F.transform(all_steps, span)

        return F.flatten(F.transform(F.array(blocks), one))

    spans = F.flatten(F.transform(F.array(steps), place))
    possible = text.contains(needs) if needs else F.lit(True)
    possible = possible & (text.rlike("[0-9]") if kind != "email" else F.lit(True))
    return F.when(possible & text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>"))


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


SMALL_PART = r"^0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x["value"], r"\."), lambda p: p.rlike(SMALL_PART))
    if kind == "card":
        digits = _digits(x["value"])
        # The order of the conditions keeps Luhn's sum off long runs of digits.
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x["value"])).between(9, 15)
    return F.lit(True)


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns and ``base_spans``, by kind as listed and then by start. A null text has none.

    Matches of one kind don't overlap; of two kinds they may. A match that
    fails its check is dropped, and what it covers isn't searched again.
    """
    docs = docs.drop("spans", "proposals").withColumn("_text", F.coalesce(F.col(text).cast("string"), F.lit("")))
    parts = [F.filter(_spans(F.col("_text"), k, BASE[k], NEEDS[k]), _check(k)) for k in KINDS]
    return docs.withColumn("base_spans", F.concat(*parts))


def _check(kind: str):
    def check(x: Column) -> Column:
        return _valid(kind, x)

    return check


def with_proposals(docs: DataFrame) -> DataFrame:
    """Rows of with_base_spans and ``proposals``: spans with their features and whether a base span of their kind meets them."""
    docs = docs.withColumn("_proposed", F.concat(*(_spans(F.col("_text"), k, PROPOSALS[k], "") for k in KINDS)))

    def describe(x: Column) -> Column:
        value, digits = x["value"], _digits(x["value"])
        before = F.substring(F.col("_text"), F.greatest(F.lit(1), x["start"] - 29).cast("int"), F.least(F.lit(30), x["start"]).cast("int"))
        after = F.substring(F.col("_text"), (x["end"] + 1).cast("int"), F.lit(1))
        separators = F.regexp_replace(value, "[A-Za-z0-9]", "")
        parts = F.split(value, "[^0-9]+")
        cue = F.lit(False)
        before = F.lower(before)
        for k in KINDS:
            cue = F.when(x["kind"] == k, before.rlike(CUES[k])).otherwise(cue)
        kind_no = F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
        numbers = {
            "kind_no": kind_no, "chars": F.length(value), "digits": F.length(digits), "letters": F.length(F.regexp_replace(value, "[^A-Za-z]", "")), "separators": F.length(separators),
            "kinds_of_separator": F.size(F.array_distinct(F.split(separators, ""))), "luhn": F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False),
            "small_parts": F.size(F.filter(parts, lambda p: p.rlike(SMALL_PART))), "parts": F.size(parts), "plus_before": before.rlike(r"\+[0-9]{0,3}[\x20(]*$"), "word_before": before.rlike(r"[\p{L}0-9]$"), "word_after": after.rlike(r"[\p{L}0-9]"),
            "cue": cue, "digit_share": F.length(digits) / F.greatest(F.lit(1), F.length(value)), "first_digit": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)), "dots": F.length(F.regexp_replace(value, r"[^.]", "")), "at_sign": value.contains("@"),
            "spelled": F.size(F.regexp_extract_all(value, F.lit(SPELLED), F.lit(0))), "range_ok": F.length(digits).between(9, 15),
            "capital": value.rlike(CAPITAL), "bare_at": value.rlike(BARE_AT),
        }
        met = F.exists("base_spans", lambda b: (b["kind"] == x["kind"]) & (b["start"] < x["end"]) & (x["start"] < b["end"]))
        meets_any = F.exists("base_spans", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
        return F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), met.alias("met"), meets_any.alias("meets_any"), *(c.cast("double").alias(n) for n, c in numbers.items()))

    return docs.withColumn("proposals", F.transform("_proposed", describe)).drop("_proposed")


def admissible(of) -> Column:
    """Whether a proposal, by its kind and features, passes the check of its kind.

    A card has 13 to 19 digits that pass Luhn, an address four parts up to 255
    (or letters, in the long form), a phone number 7 to 15 digits; and no letter
    or digit touches a number, so parts of secrets and codes are none. ``of``
    gives the fields by name.
    """
    apart = (of["word_before"] == 0) & (of["word_after"] == 0)
    ip = ((of["parts"] == 4) & (of["small_parts"] == 4) & (of["letters"] % 3 == 0)) | ((of["dots"] == 0) & (of["separators"] >= 3) & (of["kinds_of_separator"] <= 2))
    of_kind = F.when(of["kind"] == "card", of["luhn"] > 0).when(of["kind"] == "ip", ip).when(of["kind"] == "phone", of["digits"].between(7, 15))
    return F.coalesce((of["kind"] == "email") | (apart & of_kind), F.lit(False))


@dataclass(frozen=True)
class Boosted:
    """Trees as nested tuples: (feature, cut, left, right) or a leaf's value; weights; and a threshold for each kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def margin(self, of: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, cut, left, right = node
            return F.when(of[FEATURES[feature]] <= cut, walk(left)).otherwise(walk(right))

        out = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out = out + weight * walk(tree)
        return out

    def least(self, kind: Column) -> Column:
        """The margin that a proposal of a kind needs; null for a kind without a threshold."""
        least = F.lit(None).cast("double")
        for name, t in self.thresholds.items():
            least = F.when(kind == name, F.lit(t)).otherwise(least)
        return least


def _tree(node):
    """A fitted tree through Spark ML's public node classes."""
    if node.numDescendants() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _rewritings(kind: str, v: Column) -> list[tuple[bool, Column]]:
    """Forms of a base span that its pattern doesn't match (true), and look-alikes that fail its check (false)."""
    digits = _digits(v)
    fours = F.array_join(F.filter(F.split(F.regexp_replace(digits, "(.{4})", "$1 "), " "), lambda x: x != ""), "#")
    wrong_last = F.concat(F.expr("left(_digits, length(_digits) - 1)"), ((F.expr("try_cast(right(_digits, 1) as int)") + 1) % 10).cast("string"))
    wrong_fours = F.array_join(F.filter(F.split(F.regexp_replace(wrong_last, "(.{4})", "$1 "), " "), lambda x: x != ""), "#")
    if kind == "email":
        name, domain = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
        said = [F.concat(name, F.lit(at), F.regexp_replace(domain, r"\.", dot)) for at, dot in ((" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot "), ("[at]", "[dot]"), (" AT ", " DOT "))]
        said += [F.concat(name, F.lit(at), F.regexp_replace(domain, r"\.([A-Za-z0-9-]+)$", " dot $1")) for at in (" at ", " [at] ")]
        said += [F.concat(F.regexp_replace(name, r"\.", " [dot] "), F.lit(" [at] "), F.regexp_replace(domain, r"\.", " [dot] "))]
        # Addresses in texts may all have numbers; hidden ones need not.
        bare = F.when(F.regexp_replace(name, "[^A-Za-z]", "") != "", F.regexp_replace(name, "[^A-Za-z]", ""))
        said += [F.concat(bare, F.lit(at), F.regexp_replace(F.regexp_replace(domain, "[0-9]", ""), r"\.", dot)) for at, dot in ((" at ", " dot "), ("(at)", "."))]
        return [(True, x) for x in said] + [(False, F.concat(F.lit("look at "), domain)), (False, F.concat(F.lit("it was at "), F.substring_index(domain, ".", 1), F.lit(".Then")))]
    if kind == "ip":
        said = [F.regexp_replace(v, r"\.", dot) for dot in ("[.]", "(.)", " dot ", " . ")]
        high = F.concat((F.substring_index(v, ".", 1).try_cast("int") % 256 + 300).cast("string"), F.lit("."), F.substring_index(v, ".", -3))
        few = F.regexp_replace(v, r"[0-9]+([0-9])", "$1")
        said += [F.regexp_replace(few, r"\.", dot) for dot in ("[.]", " dot ")]
        return [(True, x) for x in said] + [(False, F.regexp_replace(x, r"\.", ", ")) for x in (v, few)] + [(False, F.regexp_replace(high, r"\.", dot)) for dot in ("[.]", " dot ", " . ", ".")]
    if kind == "card":
        return [(True, F.regexp_replace(fours, "#", x)) for x in (".", "/", "_", "  ", " - ", ". ")] + [(False, F.regexp_replace(wrong_fours, "#", x)) for x in (".", "/", "_", "  ", " ", "")]
    tail = F.expr("right(_digits, least(10, length(_digits) - 1))")
    groups = F.concat_ws("#", tail.substr(F.lit(1), F.lit(3)), tail.substr(F.lit(4), F.lit(3)), tail.substr(F.lit(7), F.lit(9)))
    said = [F.concat(F.lit("00"), F.expr("left(_digits, 1)"), F.lit(sep), F.regexp_replace(groups, "#", sep)) for sep in (" ", "-", ".")]
    said += [F.concat(F.lit("00"), F.expr("left(_digits, 2)"), F.lit(" "), F.regexp_replace(groups, "#", " "))]
    said += [F.regexp_replace(F.regexp_replace(v, r"^\+", first), r"[()]", "") for first in ("00", "")]
    said += [F.regexp_replace(groups, "#", sep) for sep in ("-", ".", "/")] + [F.concat(F.lit("("), tail.substr(F.lit(1), F.lit(3)), F.lit(") "), tail.substr(F.lit(4), F.lit(3)), F.lit("-"), tail.substr(F.lit(7), F.lit(9)))]
    short = F.concat_ws("-", tail.substr(F.lit(1), F.lit(2)), tail.substr(F.lit(3), F.lit(2)), tail.substr(F.lit(5), F.lit(3)))
    dated = F.concat(F.lit("20"), tail.substr(F.lit(1), F.lit(2)), F.lit("-0"), F.greatest(F.lit("1"), tail.substr(F.lit(3), F.lit(1))), F.lit("-1"), tail.substr(F.lit(4), F.lit(1)))
    return [(True, x) for x in said] + [(False, short), (False, dated), (False, F.concat(dated, F.lit(" "), tail.substr(F.lit(5), F.lit(2))))]


def learning_rows(docs: DataFrame) -> DataFrame:
    """held, kind, right (whether a proposal is personal data) and FEATURES of proposals off the base.

    Every base span is taken with 60 characters before and 40 behind it, once
    in each of its rewritings; of what is proposed there, proposals that meet
    the rewritten place count, right if it is a true form and the kind is its
    own. Proposals of the documents themselves count as wrong; cards that pass
    Luhn, and others that would pass their kind's check behind a cue, may be
    right and are left out. ``weight`` is 1 over the forms that a span is
    rewritten into, so a span counts once however many forms its kind has.
    """
    found = with_base_spans(docs.select("doc_id", "text"))
    held = (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(3)) == 0).alias("held")
    # Outer explosions: Spark would put a filter under the others that computes the whole array again, the base spans once for each proposal.
    plain = with_proposals(found).select(held, F.inline_outer("proposals")).where("not meets_any")
    passes = ((F.col("kind") == "card") & (F.col("luhn") > 0)) | ((F.col("kind") == "ip") & (F.col("small_parts") >= 4)) | ((F.col("kind") == "phone") & (F.col("range_ok") > 0)) | ((F.col("kind") == "email") & (F.col("spelled") > 0))
    plain = plain.where(~(passes & ((F.col("cue") > 0) | (F.col("kind") == "card")))).select("held", "kind", F.lit(False).alias("right"), F.lit(1.0).alias("weight"), *FEATURES)
    seeds = found.select(held, "_text", F.inline_outer("base_spans")).where("start is not null")
    around = (F.col("_text").substr(F.greatest(F.lit(1), F.col("start") - 59).cast("int"), F.least(F.lit(60), F.col("start")).cast("int")), F.col("_text").substr((F.col("end") + 1).cast("int"), F.lit(40)))
    seeds = seeds.select("held", F.col("kind").alias("own_kind"), around[0].alias("before"), around[1].alias("after"), "value", _digits(F.col("value")).alias("_digits"))
    forms = F.array().cast("array<struct<right:boolean,form:string,weight:double>>")
    for k in KINDS:
        ways = _rewritings(k, F.col("value"))
        own = F.array(*(F.struct(F.lit(right).alias("right"), form.alias("form"), F.lit(1 / sum(r == right for r, _ in ways)).alias("weight")) for right, form in ways))
        forms = F.when(F.col("own_kind") == k, own).otherwise(forms)
    made = seeds.select("held", "own_kind", "before", "after", F.inline_outer(forms)).where("form is not null")
    made = made.select("held", "own_kind", "weight", F.col("right").alias("true_form"), F.length("before").alias("lo"), (F.length("before") + F.length("form")).alias("hi"), F.concat("before", "form", "after").alias("text"))
    made = with_proposals(with_base_spans(made)).select("held", "own_kind", "weight", "true_form", "lo", "hi", F.inline_outer("proposals"))
    made = made.where("not meets_any and start < hi and end > lo")
    covers = (F.col("start") <= F.col("lo")) & (F.col("end") >= F.col("hi")) & (F.col("kind") == F.col("own_kind"))
    return plain.unionByName(made.select("held", "kind", (F.col("true_form") & covers).alias("right"), "weight", *FEATURES))


def lowest_margin(rows: list[tuple[float, int, int, float, float]], precision: float, least_support: int, window: int) -> float | None:
    """The lowest margin down to which held-out proposals are right as often as asked, or None.

    ``rows`` are margin, right ones and all by count, and both by weight. From
    the highest margin down, at least ``precision`` must be right by weight
    among all so far, and by count among the last ``window`` proposals or more:
    many easy ones at the top don't pay for wrong ones below. No margin under 0
    (even odds) is taken, nor one with fewer than ``least_support`` right ones.
    The threshold lies halfway to the next lower margin that was seen, or to 0.
    """
    ordered = [x for x in sorted(rows, reverse=True) if x[0] >= 0]
    best, right, weight_right, weight, recent = None, 0, 0.0, 0.0, []
    for at, (margin, r, n, wr, w) in enumerate(ordered):
        right, weight_right, weight = right + r, weight_right + wr, weight + w
        recent.append((r, n))
        while sum(x[1] for x in recent) - recent[0][1] >= window:
            recent.pop(0)
        near = sum(x[0] for x in recent) >= precision * sum(x[1] for x in recent)
        if near and right >= least_support and weight_right >= precision * weight:
            best = (margin + (ordered[at + 1][0] if at + 1 < len(ordered) else 0.0)) / 2
    return best


def learn(docs: DataFrame, rounds: int = 24, depth: int = 4, precision: float = 0.95, least_support: int = 20, window: int = 50) -> Boosted:
    """Boosted trees and thresholds from learning_rows of all documents.

    Equal rows are one row with their number as its weight, so what the trees
    read is the distinct forms of proposals, whatever the number of documents.
    A kind's threshold is the lowest_margin of its held-out proposals that are
    admissible; a kind with less support than asked gets none, and then only
    its base spans are found.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    rows = learning_rows(docs).groupBy("held", "kind", "right", "weight", *FEATURES).agg(F.count("*").alias("n"))
    rows = stage_table(spark, rows.withColumn("label", F.col("right").cast("double")).withColumn("times", F.col("n").cast("double")), "pii-proposals")
    kinds = {r["label"] for r in rows.where("not held").select("label").distinct().collect()}
    if len(kinds) < 2:
        return Boosted((), (), {})
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    # Every level of every tree is a job of its own: few tasks each, but more of them where there are more rows.
    learned = data.where("not held").coalesce(2 + rows.where("not held").count() // ROWS_A_TASK)
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, weightCol="times").fit(learned)
    draft = Boosted(tuple(_tree(t._call_java("rootNode")) for t in model.trees), tuple(map(float, model.treeWeights)), {})
    held = model.transform(data.where("held").where(admissible({c: F.col(c) for c in ("kind", *FEATURES)})))
    held = held.select("kind", "right", "weight", "n", F.round(vector_to_array("rawPrediction")[1], 3).alias("margin")).groupBy("kind", "margin")
    right, weight = F.col("right"), F.col("weight") * F.col("n")
    held = held.agg(F.sum(F.when(right, F.col("n")).otherwise(0)).alias("right"), F.sum("n").alias("n"), F.sum(F.when(right, weight).otherwise(0.0)).alias("weight_right"), F.sum(weight).alias("weight")).collect()
    found = {k: lowest_margin([(r["margin"], r["right"], r["n"], r["weight_right"], r["weight"]) for r in held if r["kind"] == k], precision, least_support, window) for k in KINDS}
    return Boosted(draft.trees, draft.weights, {k: t for k, t in found.items() if t is not None})


def detect(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """All columns with ``base_spans`` and ``spans``: the base ones and the proposals that the model selects.

    A proposal that isn't admissible, or meets a base span of any kind, adds
    nothing; of
    proposals that meet each other the one with the higher margin stays (at a
    tie the one that starts first, then the longer one, then by kind). A null
    text has no spans, whole texts are searched, repeated rows give equal
    spans, and no rows give none. Columns called base_spans, spans, proposals,
    _text, _proposed or _chosen are replaced or dropped.
    """
    found = with_base_spans(docs, text)
    plain = "array<struct<kind:string,start:bigint,end:bigint>>"
    bare = F.transform("base_spans", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    if not model.thresholds:
        return found.withColumn("spans", bare).drop("_text")
    found = with_proposals(found)
    scored = F.transform(F.filter("proposals", lambda x: ~x["meets_any"] & admissible(x)), lambda x: F.struct((-model.margin(x)).alias("minus_margin"), x["start"].alias("start"), (-x["end"]).alias("minus_end"), x["kind"].alias("kind")))
    chosen = F.filter(scored, lambda x: F.coalesce(-x["minus_margin"] >= model.least(x["kind"]), F.lit(False)))
    found = found.withColumn("_chosen", F.array_sort(F.coalesce(chosen, F.array().cast("array<struct<minus_margin:double,start:bigint,minus_end:bigint,kind:string>>"))))

    def take(kept: Column, x: Column) -> Column:
        free = ~F.exists(kept, lambda y: (y["start"] < -x["minus_end"]) & (x["start"] < y["end"]))
        return F.when(free, F.concat(kept, F.array(F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (-x["minus_end"]).alias("end"))))).otherwise(kept)

    added = F.aggregate("_chosen", F.array().cast(plain), take)
    order = F.transform(F.concat(bare, added), lambda x: F.struct(F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("no"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.withColumn("spans", F.transform(F.array_sort(order), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))).drop("_text", "_chosen", "proposals")


def joined(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, model: Boosted, text: str = "text") -> DataFrame:
    """All columns of documents, with the text's spans replaced by [KIND]. Spans that meet are replaced as one, by the first."""
    found = detect(docs, model, text)
    state = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("done"))
    whole = F.col(text)

    def step(s: Column, x: Column) -> Column:
        begin = F.substring(whole, (s["at"] + 1).cast("int"), F.greatest(F.lit(0).cast("long"), x["start"] - s["at"]).cast("int"))
        more = F.when(x["start"] >= s["at"], F.concat(s["done"], begin, F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["done"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), more.alias("done"))

    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    clean = F.aggregate(by_start, state, step, lambda s: F.concat(s["done"], F.substring(whole, (s["at"] + 1).cast("int"), F.lit(2_147_483_647))))
    return found.withColumn(text, F.when(F.size("spans") > 0, clean).otherwise(whole)).drop("spans", "base_spans")
