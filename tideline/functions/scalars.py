"""Column functions: coercion, flags, bands, calendar, text and ids. All run inside code generation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that mean yes and no.
YES = ("1", "true", "t", "yes", "y")
NO = ("0", "false", "f", "no", "n")

# Rules of the additive scores. A score begins at its base; each rule adds its points where a text holds
# one of the words, or where a count is above zero, and the sum is clipped to 0..1.
SCORE_BASES = {"comfort": 0.45, "fresh": 0.40, "indulgence": 0.40}
SCORE_WORDS = (
    ("prep", ("fried", "crispy", "breaded", "packaged"), {"indulgence": 0.2, "comfort": 0.1, "fresh": -0.15}),
    ("kind", ("salad", "bowl"), {"fresh": 0.2}),
    ("kind", ("pizza", "burger", "pasta", "dessert"), {"comfort": 0.2, "indulgence": 0.2, "fresh": -0.1}),
)
SCORE_DESSERT, SCORE_LONE_DRINK = {"indulgence": 0.15}, {"fresh": 0.05}
DENSITY_CUTS, SATIETY_CUTS = (("high", 900), ("moderate", 500)), (("high", 30, 8), ("moderate", 15, 4))
COHERENCE_CUTS, COHERENCE_REST, MANY_ROLES = ((2, 0.8), (4, 0.65)), 0.5, (4, 0.1)


def binary_coerce(c: Column) -> Column:
    """1.0, 0.0 or null from texts, flags and numbers."""
    x = F.lower(F.trim(c.cast("string")))
    number = x.try_cast("double")
    return F.when(x.isin(*YES), 1.0).when(x.isin(*NO), 0.0).when(number.isNull(), None).when(number > 0, 1.0).otherwise(0.0)


def numeric_coerce(c: Column, default: float | None = None) -> Column:
    """A finite number, or the default where there is none."""
    x = c.cast("string").try_cast("double")
    finite = F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
    return finite if default is None else F.coalesce(finite, F.lit(default))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def minmax_score(x: Column, lo: Column, hi: Column) -> Column:
    """0 to 1 between two bounds; 0.5 where the bounds or the value are no use."""
    usable = x.isNotNull() & lo.isNotNull() & hi.isNotNull() & (hi > lo)
    return F.when(usable, clip((x - lo) / F.nullif(hi - lo, F.lit(0.0)), 0.0, 1.0)).otherwise(0.5)


def inverse_minmax_score(x: Column, lo: Column, hi: Column) -> Column:
    return 1.0 - minmax_score(x, lo, hi)


def band(x: Column, edges: Sequence[float], labels: Sequence[str], closed: str = "right") -> Column:
    """The label of the interval between edges that holds a value; right-closed unless closed is left."""
    out = F.when(x.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when((x <= edge) if closed == "right" else (x < edge), label)
    return out.otherwise(labels[-1])


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isNotNull(), "fall")


def month_name(date: Column) -> Column:
    return F.date_format(date, "MMMM")


def slot_group(slot: Column, snacks: Sequence[str]) -> Column:
    """Slots as they are, but all snacks are one group."""
    return F.when(slot.isin(*snacks), "snack").otherwise(slot)


def threshold_flag(x: Column, op: str, value: float) -> Column:
    """A comparison that stays null for null."""
    return {"<": x < value, "<=": x <= value, ">": x > value, ">=": x >= value}[op]


def nullable_same(a: Column, b: Column) -> Column:
    return a == b


def gap_flag(days: Column, expected: float, tolerance: float) -> Column:
    return F.abs(days - expected) <= tolerance


def weighted_score(weights: Mapping[str, float], lo: float = 0.0, hi: float = 1.0) -> Column:
    """A linear blend of columns, clipped; nulls count as 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * w
    return clip(total, lo, hi)


def policy_band(score: Column, threshold: float, low: float, high: float) -> Column:
    """Four bands around a threshold and its zone of promotion."""
    return F.when(score.isNull(), None).when(score < low, "clear").when(score < threshold, "watch_low").when(score < high, "watch_high").otherwise("act")


def probability_band(p: Column, threshold: float) -> Column:
    return F.when(p.isNull(), None).when(p < threshold / 2, "low").when(p < threshold, "watch").otherwise("high")


def band_order(c: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in (("low", 0), ("watch", 1), ("high", 2)) for x in pair))[c]


# What stands for what in item names, as pattern and text, in the order in which they apply.
NAME_RULES = (("[‘’`]", "'"), ("&", " and "), (r"\[[^\]]*\]|\([^)]*\)", " "), (r"[^a-z0-9+'\-/ ]", " "))
NO_NAME = "unknown_item"


def normalize_text(c: Column, size_words: Sequence[str], rules: Sequence[tuple[str, str]] = NAME_RULES) -> Column:
    """Lower-case names after some rules, without words for sizes, with single spaces; NO_NAME where nothing is left."""
    words = (rf"\b({'|'.join(size_words)})\b", " ")
    x = reduce(lambda out, rule: F.regexp_replace(out, *rule), [*rules, words, (" +", " ")], F.lower(F.coalesce(c, F.lit(""))))
    return F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit(NO_NAME))


def pattern_flag(c: Column, words: Sequence[str]) -> Column:
    return F.coalesce(F.lower(c).rlike(rf"\b({'|'.join(words)})\b"), F.lit(False))


def first_nonblank(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def stable_id(prefix: str, *columns: Column, length: int = 12) -> Column:
    """A prefix and the first hex digits of SHA-1 over the values joined by ||."""
    joined = F.concat_ws("||", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined), 1, length))


def clean_tokens(c: Column, stop: Sequence[str] = ("the", "and", "with", "of")) -> Column:
    """Sorted distinct words of more than two letters that are no stop words."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*stop))))


def cluster_key(*columns: Column, fallback: Column) -> Column:
    """The categories joined by |, and behind them the fallback's first word in order where a category is not known."""
    names = [F.coalesce(F.nullif(F.lower(c), F.lit("")), F.lit("unknown")) for c in columns]
    vague = reduce(lambda a, b: a | b, (n.isin("unknown", "none") for n in names))
    first = F.coalesce(F.try_element_at(clean_tokens(fallback), F.lit(1)), F.lit("unknown"))
    return F.concat_ws("|", *names, F.when(vague, first))


def keyword_family(texts: Sequence[Column], rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """The first rule of which a keyword occurs in the joined texts."""
    joined = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(default)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | joined.contains(w)
        out = F.when(hit, name).otherwise(out)
    return out


def prefix_of(c: Column, known: Sequence[str]) -> Column:
    """The longest known prefix that ends at a word's end, else a possessive of at most 24 letters."""
    out = F.nullif(F.regexp_extract(c, r"^([a-z0-9]{1,22}'s) ", 1), F.lit(""))
    for k in sorted(known, key=lambda k: (len(k), k)):
        out = F.when((c == k) | c.startswith(k + " "), F.lit(k)).otherwise(out)
    return out


def strip_prefix(c: Column, prefix: Column) -> Column:
    return F.when(prefix.isNull(), c).otherwise(F.trim(c.substr(F.length(prefix) + 1, F.length(c))))


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) + F.minute(ts) / 60.0


def calendar(date: Column) -> dict[str, Column]:
    return {
        "weekday_no": F.weekday(date), "is_weekend": F.weekday(date) >= 5, "year_no": F.year(date), "month_no": F.month(date), "quarter_no": F.quarter(date), "day_of_year": F.dayofyear(date),
        "iso_week": F.weekofyear(date), "iso_year": F.extract(F.lit("YEAROFWEEK"), date), "week_of_month": F.floor((F.dayofmonth(date) - 1) / 7) + 1,
    }


def cyclic_year(date: Column) -> tuple[Column, Column]:
    angle = 2 * math.pi * (F.dayofyear(date) - 1) / 365.25
    return F.sin(angle), F.cos(angle)


def solar_shift(ts: Column, hours: float) -> Column:
    """A time moved by hours, which may be broken or negative."""
    return ts + F.make_dt_interval(secs=F.lit(round(hours * 3600.0, 6)))


def is_daylight(ts: Column, rise: Column, fall: Column) -> Column:
    """Whether a time lies in the half-open stretch from sunrise to sunset; null where a bound is null."""
    return (ts >= rise) & (ts < fall)


def log1p_clip(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def slot_start(ts: Column, minutes: int = 15, nearest: bool = False) -> Column:
    """The slot that holds a time, or the nearest slot's start (half a slot rounds up)."""
    step = minutes * 60
    seconds = F.unix_seconds(ts.cast("timestamp")) + (step // 2 if nearest else 0)
    return F.timestamp_seconds(F.floor(seconds / step) * step).cast("timestamp_ntz")


def wallclock(c: Column) -> Column:
    """A time as written, without its zone."""
    bare = F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), r"(?<=:\d\d)(\.\d+)?\s*([+-]\d{2}:?\d{2}|Z)$", "$1")
    return bare.try_cast("timestamp_ntz")


def multi_format_time(c: Column, formats: Sequence[str]) -> Column:
    """The first of some formats that fits."""
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def epoch_ms_date(c: Column) -> Column:
    return F.to_date(F.timestamp_millis(c))


def additive_scores(prep: Column, kind: Column, desserts: Column, drinks: Column, items: Column) -> dict[str, Column]:
    """Comfort, fresh and indulgence: a base and the points of every rule that holds, from 0 to 1."""
    texts = {"prep": F.lower(F.coalesce(prep, F.lit(""))), "kind": F.lower(F.coalesce(kind, F.lit("")))}
    rules = [(texts[of].rlike("|".join(words)), points) for of, words, points in SCORE_WORDS]
    rules += [(desserts > 0, SCORE_DESSERT), ((drinks > 0) & (items.isNull() | (items == 1)), SCORE_LONE_DRINK)]
    out = {}
    for score, base in SCORE_BASES.items():
        added = (F.when(held, points[score]).otherwise(0.0) for held, points in rules if score in points)
        out[score] = clip(reduce(lambda a, b: a + b, added, F.lit(base)), 0.0, 1.0)
    return out


def density_style(energy: Column) -> Column:
    return reduce(lambda out, cut: out.when(energy >= cut[1], cut[0]), DENSITY_CUTS, F.when(energy.isNull(), None)).otherwise("light")


def satiety_style(protein: Column, fibre: Column) -> Column:
    """By protein or fibre, whichever tells more; null where both are unknown."""
    p, f = F.coalesce(protein, F.lit(0.0)), F.coalesce(fibre, F.lit(0.0))
    return reduce(lambda out, cut: out.when((p >= cut[1]) | (f >= cut[2]), cut[0]), SATIETY_CUTS, F.when(protein.isNull() & fibre.isNull(), None)).otherwise("light")


def coherence_score(items: Column, roles: Sequence[Column]) -> Column:
    """Few items hang together; many different roles do less."""
    base = reduce(lambda out, cut: out.when(items <= cut[0], cut[1]), COHERENCE_CUTS, F.when(items.isNull(), COHERENCE_REST)).otherwise(COHERENCE_REST)
    filled = reduce(lambda a, r: a + F.coalesce((r > 0).cast("int"), F.lit(0)), roles, F.lit(0))
    return clip(base - F.when(filled >= MANY_ROLES[0], MANY_ROLES[1]).otherwise(0.0), 0.0, 1.0)


def explain(separator: str, first: Column, *rules: tuple[Column, str]) -> Column:
    """A text and the notes of the rules that hold, joined."""
    return F.concat_ws(separator, first, *(F.when(held, note) for held, note in rules))


def code_map(c: Column, names: Mapping[str, str]) -> Column:
    """What a code stands for; null for other codes."""
    return reduce(lambda out, pair: out.when(c == pair[0], pair[1]), names.items(), F.when(c.isNull(), None))


def portion_scale(amount: Column, factor: float) -> Column:
    return amount * factor


def feature_parts(c: Column) -> dict[str, Column]:
    """Parts of a name like days__t_minus_3__steps."""
    return {"modality": F.split_part(c, F.lit("__"), F.lit(1)), "lag": F.nullif(F.regexp_extract(c, r"__t_minus_(\d+)__", 1), F.lit("")).cast("bigint"), "core": F.regexp_replace(c, r"^.*__t_minus_\d+__", "")}
