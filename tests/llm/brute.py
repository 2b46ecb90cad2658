"""Plain twins of the text operators: loops over everything, for small tables."""

import math
import re
from collections import Counter, defaultdict

# ---- lines


def _enough(tokens):
    constants = sum(x is not None for x in tokens)
    return constants >= 6 and constants >= 0.6 * len(tokens)


def _tokens(line):
    words = line.encode().split()
    masked = [None if re.search(b"[0-9]", w) else w for w in words]
    plain = sum(x is not None for x in masked)
    return tuple(masked) if plain < len(words) and plain >= 2 and plain >= 0.6 * len(words) else tuple(words)


def dropped(texts):
    """Line numbers that each document loses."""
    where, leaves = defaultdict(list), defaultdict(set)
    for doc, text in texts.items():
        for n, line in enumerate((text or "").split("\n")):
            t = _tokens(line)
            if t:
                where[t].append((doc, n))
                leaves[len(t), t[:3]].add(t)
    general = {}
    for leaf, templates in leaves.items():
        if leaf[0] <= 6 or len(templates) < 2:
            continue
        counts = Counter((i, x) for t in templates for i, x in enumerate(t))
        now = {}
        for t in templates:
            masked = tuple(None if counts[i, x] == 1 else x for i, x in enumerate(t))
            now[t] = masked if masked != t and _enough(masked) else t
        for _ in range(2):
            kinds = set(now.values())
            if len(kinds) > 1:
                rest = Counter((i, g[:i] + g[i + 1 :]) for g in kinds for i, x in enumerate(g) if x is not None)
                step = {}
                for g in kinds:
                    n, i = max(((rest[i, g[:i] + g[i + 1 :]], -i) for i, x in enumerate(g) if x is not None), default=(0, 0))
                    masked = tuple(None if k == -i else x for k, x in enumerate(g))
                    step[g] = masked if n > 1 and _enough(masked) else g
                now = {t: step[g] for t, g in now.items()}
        general |= {t: (leaf, g) for t, g in now.items()}
    groups = defaultdict(list)
    for t, places in where.items():
        groups[general.get(t, t)] += places
    gone = defaultdict(set)
    for places in groups.values():
        owner = min(d for d, _ in places)
        for d, n in places:
            if d != owner:
                gone[d].add(n)
    return gone


# ---- statistics and spans


def base_statistics(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = defaultdict(list)
    for j in range(len(w) - 2):
        at[tuple(w[j : j + 3])].append(j)
    covered = {k for v in at.values() if len(v) > 1 for j in v for k in (j, j + 1, j + 2)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, v):
    digits = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def spans(t):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m.group())]


# ---- toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


class Matcher:
    """A token's weight, by the edit distance to every term and stem."""

    def __init__(self, lexicon, edits):
        self.lexicon, self.edits, self.known = lexicon, edits, {}

    def word(self, w):
        x = self.lexicon
        if w in x.terms:
            return x.terms[w], 0
        if w in x.benign:
            return 0.0, 0
        stems = sorted((t for t in x.stems if w.startswith(t)), key=len)
        if stems:
            return x.stems[stems[-1]], 0
        near = [(d, -v) for t, v in x.terms.items() if abs(len(t) - len(w)) <= self.edits(len(t)) > 0 and (d := distance(w, t)) <= self.edits(len(t))]
        near += [(d, -v) for t, v in x.stems.items() if self.edits(len(t)) > 0 and (d := min(distance(w[:n], t) for n in range(len(t) + 3))) <= self.edits(len(t))]
        return (-min(near)[1], min(near)[0]) if near else (0.0, 0)

    def token(self, t):
        """Weight, times the share that unseen rows leave to matches of its distance and weight."""
        if t not in self.known:
            spelled = str.maketrans("013457@$!", "oieastasi")
            letters = re.findall(r"[^\W\d_]+", t)
            if re.search(r"[^\W\d_][013457@$!]|[013457@$!][^\W\d_]", t):
                letters += re.findall(r"[^\W\d_]+", t.translate(spelled))
            weight, edits = max(map(self.word, letters), default=(0.0, 0))
            self.known[t] = weight * self.lexicon.reliability.get((edits, weight), 1.0)
        return self.known[t]


def toxicity(model, matcher, text):
    tokens = (text or "").lower().split()
    hits = [(i, w) for i, t in enumerate(tokens) if (w := matcher.token(t))]
    plain = [w for i, w in hits if not model.lexicon.quoted(tokens, i)]
    quoted = sum(w for i, w in hits if model.lexicon.quoted(tokens, i))
    f = math.log1p(sum(plain)), max(plain, default=0.0), math.log1p(100 * sum(plain) / max(20, len(tokens))), math.log1p(quoted)
    return 1 / (1 + math.exp(-model.bias - sum(w * x for w, x in zip(model.weights, f))))


# ---- languages


def grams(text):
    words = re.sub(r"[\W\d_]+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).split()
    joined = " " + " ".join(words) + " "
    found = Counter()
    if words:
        for n in (1, 2, 3):
            found.update(g for i in range(len(joined) - n + 1) if (g := joined[i : i + n]) != " ")
    return found


def _ranked(counts, length):
    return sorted(counts, key=lambda g: (-counts[g], [0] * (3 - len(g)) + [32 if c == " " else ord(c) for c in g]))[:length]


def profiles(rows, length):
    totals = defaultdict(Counter)
    for lang, text in rows:
        totals[lang].update(grams(text))
    return {lang: {g: i for i, g in enumerate(_ranked(c, length))} for lang, c in totals.items()}


def out_of_place(text, known, length):
    own = _ranked(grams(text), length)
    return {lang: sum(abs(ranks[g] - i) if g in ranks else length for i, g in enumerate(own)) for lang, ranks in known.items()} if own else {}


# ---- benchmark


def leaks(texts, items, canonical, rule):
    """Items by document, from every place of every document."""

    def parts(form):
        return [("word", form.tokens[form.begins[i]].strip(STRIP).lower()) if k == 0 else ("slot", int(k)) for i, k in enumerate(form.kinds)], [form.slot(i) if k else None for i, k in enumerate(form.kinds)]

    found = defaultdict(set)
    forms, places = {i: parts(canonical(t)) for i, t in texts.items()}, {}
    classes = defaultdict(set)
    for text in items.values():
        for cased in (True, False):
            want, values = parts(canonical(text, cased=cased))
            pattern = tuple(values.index(v) if v is not None else -1 for v in values)
            for i in range(len(want) - rule.window + 1):
                classes[tuple(want[i : i + rule.window])].add((tuple(want), pattern))
    def runs(form_parts):
        words = [w for kind, w in zip(*[[x[i] for x in form_parts[0]] for i in (0, 1)], strict=True) if kind == "word"]
        return {tuple(words[i : i + rule.words]) for i in range(len(words) - rule.words + 1)}

    own_runs = {doc: runs(x) for doc, x in forms.items()}
    for item, text in items.items():
        for cased in (True, False):
            form = canonical(text, cased=cased)
            want, values = parts(form)
            for doc, had in own_runs.items():
                if had & runs((want, values)):
                    found[doc].add(item)
            width, starts = rule.window, [i for i in range(len(want) - rule.window + 1) if sum(k == "word" for k, _ in want[i : i + rule.window]) >= rule.literals]
            if not starts:
                if len(form.tokens) < rule.least:
                    continue
                if sum(k == "word" for k, _ in want) < rule.literals:
                    raise NotImplementedError
                width, starts = len(want), [0]
            for doc, (have, own) in forms.items():
                if (doc, width) not in places:
                    places[doc, width] = defaultdict(list)
                    for i in range(len(have) - width + 1):
                        places[doc, width][tuple(have[i : i + width])].append(i)
                by_shift = defaultdict(list)
                for i in starts:
                    for at in places[doc, width].get(tuple(want[i : i + width]), ()):
                        by_shift[at - i].append(i)
                for shift, hit in by_shift.items():
                    own_windows = sum(len(classes[tuple(want[i : i + width])]) <= rule.common for i in hit)
                    if own_windows >= rule.windows or len(hit) >= rule.coverage * len(starts):
                        pairs = {(values[i + k], own[i + shift + k]) for i in hit for k in range(width) if values[i + k] is not None}
                        if len({a for a, _ in pairs}) == len(pairs):
                            found[doc].add(item)
    return found


STRIP = "\"'“”‘’«»()[]{}<>.,;:!?*_-–—…`"
