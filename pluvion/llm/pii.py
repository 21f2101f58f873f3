"""Operator 3: personal data by candidate gradient boosting, in DataFrame functions only.

1. Generators. Strict patterns propose e-mail addresses, IP addresses, card and phone
   numbers; wide patterns propose obfuscated or differently grouped forms. Spans overlap.
2. A strict candidate that passes its check (part range, digit count, Luhn) is a base span
   and always stays.
3. Boosted trees score the wide candidates from format and context features. They learn on a
   bounded, hash-chosen set of documents (``train_docs``): base spans, rewritten into the wide
   formats and left in their context, are the positives; what looks alike is not (base spans
   with a digit changed or digits missing, numbers that fail their check, prose around the word
   "at"), rewritten into the same formats. The training data are counts by feature vector,
   grouped in Spark; their number is bounded by the features' bins, and the trees become Column
   expressions.
4. Scores are calibrated (Platt scaling on all documents that the trees did not see) and a
   threshold per kind is the lowest at which those candidates of that kind reach ``precision``;
   a kind that has none there takes the threshold of all kinds together.
   A chosen span that overlaps a base span gives way to it.

Offsets are code points, ends exclusive. Quantifiers over groups are possessive, which finds
the same spans here and keeps Java's matcher from recursing on very long runs.

Defined results: null text counts as empty (no spans); repeated rows give repeated rows;
an empty table gives no rows; extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvion.llm.common import running_total

KINDS = ("email", "ip", "card", "phone")

#: Strict patterns, one per kind (fixed values). Look-behinds only spare useless starts.
STRICT = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wide patterns (fixed values).
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[({<]\x20?at\x20?[\])}>]\x20?[A-Za-z0-9-]++(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?[A-Za-z0-9-]++|\x20dot\x20[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++"
    r"|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]+)*?\x20dot\x20(?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu)(?![A-Za-z0-9-]))",
    "ip": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]{0,40}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:)(?![0-9A-Za-z:])",
    "card": r"(?<![0-9._-])(?:[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{2,7}|[0-9]{4}([._/])[0-9]{6}\2[0-9]{5})(?![0-9])",
    "phone": r"(?=[(0-9])(?<![0-9+.)-])(?:(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20./-])[0-9]{3}[\x20./-][0-9]{4}|00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{1,4}){3,5}|0[1-9](?:[\x20.-][0-9]{2}){4}|[0-9]{2,4}[./-][0-9]{2}[./-][0-9]{2,4}|[0-9]{3}[\x20./-][0-9]{4})(?![0-9])",
}
#: A text without this string has no strict candidate of the kind.
_NEEDS = {"email": "@", "phone": "+"}
#: What a text with a wide address holds: a sign in words, or seven colons where none is doubled.
_SPELT, _EIGHT = r"(?i)[\[({<]\x20?at\x20?[\])}>]|\x20dot\x20", r"(?:[0-9A-Fa-f]{1,4}:){7}"
#: Words that announce each kind (fixed values).
CUES = {
    "email": r"(?i)\b(e-?mail|contact|write|mailto|adresse|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|login)\b",
    "card": r"(?i)\b(card|visa|credit|pay|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|cell|telefon|telephone|movil)\b",
}
#: Prose that could be taken for a spelt address, and endings of addresses (fixed values).
_PROSE, _ENDING = r"\b[A-Za-z]++ at [A-Za-z]++ [A-Za-z]++", r"(?i)\b(com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$"
FEATURES = ("kind", "digits", "length", "separator", "groups", "cue", "left", "right", "form")
_CONTEXT = 32


def _found(text: Column, pattern: str, need: str | None = None) -> tuple[Column, Column]:
    """All matches of a pattern, and the texts before, between and behind them."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    if need:
        has = F.contains(text, F.lit(need))
        none = F.array().cast("array<string>")
        matches, gaps = F.when(has, matches).otherwise(none), F.when(has, gaps).otherwise(none)
    return matches, gaps


def _placed(matches: Column, gaps: Column) -> Column:
    """Matches as structs: start, end (code points), the string s, and its context.

    Contexts come from the texts between matches, so that all of them together are read
    once; taking them from the whole text by position would read it once per match.
    """
    each = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: (F.char_length(m) + F.char_length(g)).cast("long"))
    behind = F.slice(gaps, 2, F.size(matches))
    return F.transform(
        F.arrays_zip(matches.alias("s"), running_total(each).alias("e"), F.slice(gaps, 1, F.size(matches)).alias("l"), behind.alias("r")),
        lambda z: F.struct(
            (z["e"] - F.char_length(z["s"])).alias("start"), z["e"].alias("end"), z["s"].alias("s"),
            F.right(z["l"], F.lit(_CONTEXT)).alias("left"), F.left(z["r"], F.lit(1)).alias("right"),
        ),
    )


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _passes(kind: str, s: Column) -> Column:
    n = F.char_length(_digits(s))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(s, r"\."), lambda p: (F.char_length(part(p)) < 3) | (F.char_length(part(p)) == 3) & (part(p) <= "255"))
    if kind == "card":
        return F.when(n.between(14, 19), F.call_function("luhn_check", _digits(s))).otherwise(False)
    return n.between(10, 15) if kind == "phone" else F.lit(True)


def _with_candidates(df: DataFrame, text: str, wide: bool = True) -> DataFrame:
    """Adds an array column of candidates for each kind and pattern set."""
    for kind in KINDS:
        m, g = _found(F.col(text), STRICT[kind], _NEEDS.get(kind))
        df = df.withColumn(f"_m_{kind}", m).withColumn(f"_g_{kind}", g)
    df = df.withColumns({f"_c_{k}": _placed(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in KINDS})
    if wide:
        for kind in KINDS:
            # Few texts have any, so the test comes first.
            has = F.contains(F.col(text), F.lit("::")) | F.rlike(F.col(text), F.lit(_EIGHT)) if kind == "ip" else F.rlike(F.col(text), F.lit(_SPELT if kind == "email" else WIDE[kind]))
            m, g = _found(F.col(text), WIDE[kind])
            none = F.array().cast("array<string>")
            df = df.withColumn(f"_h_{kind}", has)
            df = df.withColumn(f"_m_{kind}", F.when(F.col(f"_h_{kind}"), m).otherwise(none)).withColumn(f"_g_{kind}", F.when(F.col(f"_h_{kind}"), g).otherwise(none))
        df = df.withColumns({f"_w_{k}": _placed(F.col(f"_m_{k}"), F.col(f"_g_{k}")) for k in KINDS})
    return df.drop(*(f"_{a}_{k}" for a in "mgh" for k in KINDS))


def _features(kind: str, c: Column) -> Column:
    """Small whole numbers that describe a candidate: format, context, and whether its form is that of the kind."""
    s = c["s"]
    n, length = F.char_length(_digits(s)), F.char_length(s)
    before = F.right(c["left"], F.lit(1))
    side = lambda x: F.when(x == "", 0).when(F.rlike(x, F.lit(r"\s")), 1).when(F.rlike(x, F.lit(r"[\p{L}\p{N}]")), 2).otherwise(3)
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(n, F.lit(20)).alias("digits"),
        F.least(F.floor(length / 4), F.lit(10)).cast("int").alias("length"),
        F.when(F.rlike(s, F.lit("[()]")), 3).when(F.contains(s, F.lit(" ")), 2).when(F.rlike(s, F.lit("[-./_:]")), 1).otherwise(0).alias("separator"),
        F.least(F.size(F.split(s, "[^A-Za-z0-9]+")), F.lit(8)).alias("groups"),
        F.rlike(c["left"], F.lit(CUES[kind])).cast("int").alias("cue"),
        side(before).alias("left"),
        side(c["right"]).alias("right"),
        _formed(kind, s).cast("int").alias("form"),
    )


def _formed(kind: str, s: Column) -> Column:
    """Of a wide candidate: an ending of addresses, three groups or more, a card's check digit, a phone's number of digits."""
    if kind == "email":
        return F.rlike(s, F.lit(_ENDING))
    if kind == "ip":
        return F.size(F.filter(F.split(s, ":"), lambda g: g != "")) >= 3
    return _passes(kind, s)


def _grouped(d: Column, *sizes: int) -> list[Column]:
    """The digits cut into groups; what is left joins the last one."""
    ends = [sum(sizes[: i + 1]) for i in range(len(sizes))]
    return [F.substr(d, F.lit(e - n + 1), F.lit(n if e < ends[-1] else 99)) for n, e in zip(sizes, ends)]


def _one_of(seed: Column, *forms: Column) -> Column:
    return F.element_at(F.array(*forms), (F.pmod(F.xxhash64(seed), F.lit(len(forms))) + 1).cast("int"))


def _rewritten(kind: str, s: Column) -> Column:
    """A strict span in one of the wide formats."""
    if kind == "email":
        user, host = F.regexp_extract(s, "^([^@]+)@", 1), F.regexp_extract(s, "@(.+)$", 1)
        return _one_of(s, F.concat(user, F.lit(" (at) "), F.replace(host, F.lit("."), F.lit(" (dot) "))), F.concat(user, F.lit("[at]"), host), F.concat(user, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot "))))
    if kind == "ip":
        part = [F.lower(F.conv(F.element_at(F.split(s, r"\."), i), 10, 16)) for i in range(1, 5)]
        start = lambda *x: F.concat_ws(":", *map(F.lit, x), *part)
        return _one_of(s, start("2001", "db8", "0", "0"), start("2001", "db8:"), start("fe80:"))
    if kind == "card":
        return F.concat_ws("", *_interleaved(_grouped(_digits(s), 4, 4, 4, 4), _one_of(s, *map(F.lit, "._/"))))
    d = _digits(s)
    a, b, c = _grouped(F.right(d, F.lit(10)), 3, 3, 4)
    code = F.concat(F.lit("00"), F.left(d, F.greatest(F.char_length(d) - 10, F.lit(1))))
    return _one_of(s, F.concat_ws(" ", code, a, b, c), F.concat(F.lit("("), a, F.lit(") "), b, F.lit("-"), c), F.concat_ws("-", a, b, c), F.concat_ws(".", a, b, c))


def _interleaved(groups: list[Column], sep: Column) -> list[Column]:
    return [x for g in groups for x in (g, sep)][:-1]


def _spoilt(kind: str, s: Column) -> Column:
    """What looks like a strict span in a wide format but is none: another check digit, too few digits or groups; for an address, prose."""
    if kind == "email":
        w = [F.element_at(F.split(s, " "), i) for i in (1, 3, 4)]
        return _one_of(s, F.concat(w[0], F.lit(" (at) "), w[1], F.lit(" (dot) "), w[2]), F.concat(w[0], F.lit("[at]"), w[1], F.lit("."), w[2]), F.concat(w[0], F.lit(" at "), w[1], F.lit(" dot "), w[2]))
    d = _digits(s)
    if kind == "ip":
        return F.concat_ws("::", *(F.element_at(F.split(s, r"\."), i) for i in (1, 2)))
    if kind == "card":
        last = F.right(d, F.lit(1)).cast("int")
        return _rewritten("card", F.concat(F.left(d, F.char_length(d) - 1), F.pmod(last + 1, F.lit(10)).cast("string")))
    return _one_of(s, F.concat_ws("-", *_grouped(F.right(d, F.lit(7)), 3, 4)), F.concat_ws("-", *_grouped(F.right(d, F.lit(8)), 4, 2, 2)), F.concat_ws("-", *_grouped(F.right(d, F.lit(9)), 3, 2, 4)))


class Booster:
    """Boosted depth-two trees over small whole-number features, with logistic loss.

    Trains on (feature vector, label, count) rows; the rows are few, so this runs where the
    plan is made, and ``score`` is a Column expression.
    """

    def __init__(self, rounds: int = 24, rate: float = 0.4, ridge: float = 1.0):
        self.rounds, self.rate, self.ridge = rounds, rate, ridge
        self.base, self.trees, self.platt = 0.0, [], (1.0, 0.0)

    def _leaf(self, rows, grads) -> float:
        g, h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
        return self.rate * g / (h + self.ridge)

    def _split(self, data, rows, grads):
        """The best (gain, feature, bound): rows with feature <= bound go left."""
        best = (1e-9, None, None)
        total_g, total_h = sum(grads[i][0] for i in rows), sum(grads[i][1] for i in rows)
        for f in range(len(data[0][0])):
            sums: dict[int, list[float]] = {}
            for i in rows:
                x = sums.setdefault(data[i][0][f], [0.0, 0.0])
                x[0] += grads[i][0]
                x[1] += grads[i][1]
            g = h = 0.0
            for v in sorted(sums)[:-1]:
                g, h = g + sums[v][0], h + sums[v][1]
                gain = g * g / (h + self.ridge) + (total_g - g) ** 2 / (total_h - h + self.ridge) - total_g**2 / (total_h + self.ridge)
                if gain > best[0]:
                    best = (gain, f, v)
        return best[1:]

    def fit(self, data: list[tuple[tuple, int, int]]) -> "Booster":
        up = sum(c for _, y, c in data if y)
        down = sum(c for _, y, c in data if not y)
        self.base = math.log((up + 0.5) / (down + 0.5))
        margins = [self.base] * len(data)
        for _ in range(self.rounds if up and down else 0):
            probs = [1 / (1 + math.exp(-m)) for m in margins]
            grads = [(c * (y - p), c * p * (1 - p)) for (_, y, c), p in zip(data, probs)]
            everything = list(range(len(data)))
            f, v = self._split(data, everything, grads)
            if f is None:
                break
            halves = []
            for side in ([i for i in everything if data[i][0][f] <= v], [i for i in everything if data[i][0][f] > v]):
                f2, v2 = self._split(data, side, grads)
                if f2 is None:
                    halves.append((None, None, self._leaf(side, grads), 0.0))
                else:
                    lo, hi = [i for i in side if data[i][0][f2] <= v2], [i for i in side if data[i][0][f2] > v2]
                    halves.append((f2, v2, self._leaf(lo, grads), self._leaf(hi, grads)))
            self.trees.append((f, v, *halves))
            margins = [self.margin(x) for x, _, _ in data]
        return self

    def margin(self, x) -> float:
        out = self.base
        for f, v, low, high in self.trees:
            f2, v2, a, b = low if x[f] <= v else high
            out += a if f2 is None or x[f2] <= v2 else b
        return out

    def calibrate(self, data: list[tuple[tuple, int, int]], steps: int = 200) -> "Booster":
        """Platt scaling of the margins by Newton steps."""
        a, b = 1.0, 0.0
        for _ in range(steps):
            ga = gb = haa = hab = hbb = 0.0
            for x, y, c in data:
                m = self.margin(x)
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * m + b))))
                w = c * p * (1 - p)
                ga, gb = ga + c * (y - p) * m, gb + c * (y - p)
                haa, hab, hbb = haa + w * m * m, hab + w * m, hbb + w
            ga, gb, haa, hbb = ga - 0.01 * (a - 1), gb - 0.01 * b, haa + 0.01, hbb + 0.01
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a + max(-1.0, min(1.0, da)), b + max(-1.0, min(1.0, db))
            if abs(da) + abs(db) < 1e-9:
                break
        self.platt = (a, b)
        return self

    def probability(self, x) -> float:
        a, b = self.platt
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * self.margin(x) + b))))

    def score(self, x: Column) -> Column:
        """The calibrated probability of a feature struct."""
        def half(h):
            f, v, a, b = h
            return F.lit(a) if f is None else F.when(x[FEATURES[f]] <= v, a).otherwise(b)

        total = F.lit(self.base)
        for f, v, low, high in self.trees:
            total = total + F.when(x[FEATURES[f]] <= v, half(low)).otherwise(half(high))
        a, b = self.platt
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(total * a + b)))


class Detector:
    """A trained booster with a threshold per kind."""

    def __init__(self, booster: Booster, thresholds: dict[str, float]):
        self.booster, self.thresholds = booster, thresholds


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = 4000, precision: float = 0.95) -> Detector:
    """Trees learn from about ``train_docs`` documents, chosen by a hash of their ids;
    calibration and thresholds count the candidates of all other documents.

    Only counts by feature vector and label reach the driver. Of the chosen documents a
    third is kept from the trees as well. A kind without candidates takes the threshold of
    all kinds together.
    """
    total = df.count()
    every = df.select(df[id_col].alias("_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"))
    chosen = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, train_docs / max(1, total)))
    found = _with_candidates(every, "_text", wide=False)

    def example(kind: str, c: Column, form: Column, y: Column | bool) -> Column:
        told = F.struct(form.alias("s"), c["left"].alias("left"), c["right"].alias("right"))
        return F.struct(_features(kind, told).alias("x"), F.lit(y).cast("int").alias("y"))

    def labelled(kind: str) -> list[Column]:
        spans = F.col(f"_c_{kind}")
        if kind == "card":  # the pattern takes any number; those of a card's length are of use
            spans = F.filter(spans, lambda c: F.char_length(_digits(c["s"])).between(14, 19))
        good = F.filter(spans, lambda c: _passes(kind, c["s"]))
        out = [F.transform(good, lambda c: example(kind, c, _rewritten(kind, c["s"]), True))]
        if kind == "card":
            bad = F.filter(spans, lambda c: ~_passes(kind, c["s"]))
            out.append(F.transform(bad, lambda c: example(kind, c, _rewritten(kind, c["s"]), False)))
        return [*out, F.transform("_prose" if kind == "email" else good, lambda c: example(kind, c, _spoilt(kind, c["s"]), False))]

    m, g = _found(F.col("_text"), _PROSE, " at ")
    found = found.withColumn("_prose", _placed(m, g))
    rows = F.concat(*(x for kind in KINDS for x in labelled(kind)))
    counts = (
        found.select((~chosen | (F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(3)) == 0)).alias("kept"), F.explode(rows).alias("r"))
        .groupBy("kept", "r").count().collect()
    )
    split = {kept: [(tuple(r["r"]["x"]), r["r"]["y"], r["count"]) for r in counts if r["kept"] == kept] for kept in (False, True)}
    for part in split.values():
        part.sort()
    booster = Booster().fit(split[False]).calibrate(split[True])
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = [r for r in split[True] if r[0][0] == k]
        scored = sorted(((booster.probability(x), y, c) for x, y, c in own or split[True]), reverse=True)
        hit = seen = 0
        thresholds[kind] = 1.01  # nothing is added unless the kept candidates bear it out
        for i, (p, y, c) in enumerate(scored):
            hit, seen = hit + y * c, seen + c
            if p >= 0.5 and hit >= precision * seen and (i + 1 == len(scored) or scored[i + 1][0] < p):
                thresholds[kind] = p
    return Detector(booster, thresholds)


def _spans(df: DataFrame, text: str, detector: Detector) -> DataFrame:
    """Adds _base and _all: sorted arrays of structs (start, kind number, end)."""
    df = _with_candidates(df, text)

    def spans(kind: str, candidates: Column) -> Column:
        return F.transform(candidates, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), c["end"].alias("end")))

    def passing(kind: str) -> Column:
        return F.filter(f"_c_{kind}", lambda c: _passes(kind, c["s"]))

    def chosen(kind: str) -> Column:
        def good(c: Column) -> Column:
            apart = ~F.exists("_base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
            return apart & (detector.booster.score(_features(kind, c)) >= detector.thresholds[kind])

        return F.filter(f"_w_{kind}", good)

    df = df.withColumn("_base", F.array_sort(F.concat(*(spans(k, passing(k)) for k in KINDS))))
    # Strict candidates that failed their check are known to be none; wide ones are scored.
    more = F.concat(*(spans(k, chosen(k)) for k in KINDS))
    empty = F.lit(True)
    for k in KINDS:
        empty = empty & (F.size(f"_w_{k}") == 0)
    df = df.withColumn("_all", F.when(empty, F.col("_base")).otherwise(F.array_sort(F.concat("_base", more))))
    return df.drop(*(f"_{a}_{k}" for a in "cw" for k in KINDS))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["k"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(df: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, base and all spans as arrays, and both as text
    (kind:start:end, by start and then kind, comma-joined). No shuffle, no Python."""
    rows = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("_text"))
    found = _spans(rows, "_text", detector)
    return found.select("doc_id", F.col("_base").alias("base"), F.col("_all").alias("spans"), _listed(F.col("_base")).alias("base_text"), _listed(F.col("_all")).alias("spans_text"))


def redact(df: DataFrame, detector: Detector, text_col: str = "text") -> DataFrame:
    """``df`` with every chosen span of its text replaced by its kind in square brackets.

    Overlapping spans become one, named after the first. Null texts stay null; extra columns
    stay as they are, whatever their names.
    """
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    rows = df.select(F.struct("*").alias("_row"), F.coalesce(df[text_col], F.lit("")).alias("_text"))
    found = _spans(rows, "_text", detector)
    text = F.col("_text")
    piece = lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))
    parts = F.aggregate(
        "_all",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece(acc["at"], s["start"]), names[s["k"]]))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.array_join(F.concat(acc["out"], F.array(piece(acc["at"], F.char_length(text).cast("long")))), ""),
    )
    own = lambda c: F.col("_row").getField(c)
    new = F.when(F.size("_all") == 0, own(text_col)).otherwise(parts)
    return found.select(*(new.alias(c) if c == text_col else own(c).alias(c) for c in df.columns))
