"""Personal data by candidate gradient boosting. DataFrame functions only.

Base spans come from four patterns with checks of their own (address ranges, Luhn's sum, digit counts). High-recall generators propose
looser spans that overlap each other: spelt-out addresses, dotted numbers, telephone-like and long numbers, and long unbroken strings
(keys and passwords, of kind secret). Boosted trees score each proposal by features of its format and context.

Training has no labels but what stands around a proposal: it is positive where a word that announces its kind (tel, mail, card, host) or,
for a string, an assignment to a word such as token or password comes right before it. That context is not among the features, which are
the proposal's own form and the classes of its neighbour characters, so that the trees learn which forms get announced and find them
where nothing announces them. Proposals come from what base spans leave over, in training as in scoring, so that the held-out precision is
that of the spans that are added. Half of the documents (by a hash of the text) grow the trees, and on the other half scores become
probabilities by isotonic regression and each kind's threshold is set to the lowest probability from which on PRECISION of the
held-out proposals are positive. All documents count, summed up by feature vector: there are VECTORS of them at most, as every
feature is a small bin, so that what the driver boosts on has that bound at any size. ``recall`` tells how much of the base spans the
trees alone would find.

Scoring looks for proposals in what base spans leave over, keeps those above the threshold of their kind, and where these overlap keeps
the more probable one, or the earlier one of equals. Base spans always stay. Trees run as CASE expressions in the same narrow pass.

Null text is empty. Null and repeated ids: each row is read by itself. Matches of a base kind don't overlap, and those that fail their
check are dropped without another try. Ties in start go by kind. A kind without proposals of both labels in both halves adds no span.
Empty tables give empty results; whole texts of any length are read, in time that grows with the matches to the power of 1.5 at most;
extra columns are ignored by ``find`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bound, folded, packed, text_or_empty, unpacked

#: Kinds with base spans, and all kinds in the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
ROUNDS, DEPTH, RATE, PRECISION = 20, 3, 0.3, 0.95

# Fixed patterns, with possessive repeats and starts only where a run starts, so that no text makes them slow or deep.
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_STRING = r"[A-Za-z0-9_+/=~!^-]"
#: Generators: pattern, the kind that their spans would be, and what a text with any must match.
LOOSE = {
    "address": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?(?:@|[(\[]at[)\]])\x20?{_DOMAIN}++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?{_DOMAIN}++)++", "email", r"@|[(\[]at[)\]]"),
    "dotted": (r"(?<![0-9.])[0-9]{1,5}(?:\.[0-9]{1,5}){2,9}(?![0-9])", "ip", r"[0-9]\.[0-9]"),
    "call": (r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])", "phone", "[0-9]"),
    "long": (r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])", "card", "[0-9]"),
    "string": (rf"(?<!{_STRING}){_STRING}{{16,}}+", "secret", None),
}
#: What stands right before a proposal and tells its kind.
_ANNOUNCING = {"email": "mail|contact|kontakt|correo", "ip": "host|addr|address|server|ip", "card": "card|visa|konto|account|iban|tarjeta|carte", "phone": "tel|telefon|phone|call|fax|mobile?|movil"}
ANNOUNCED = {k: rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{w})\.?\s{{0,2}}[:=]?\s{{0,2}}$" for k, w in _ANNOUNCING.items()}
ANNOUNCED["secret"] = r"(?i)(?:token|secret|key|passw[a-z]*|pwd|auth[a-z]*|bearer|credentials?)[\"']?\s{0,2}(?:[:=]|\s)\s{0,2}[\"']?$"
BEFORE = 24

#: Features by the number of their bins; strings have the last four only.
BINS = {"generator": 5, "digits": 7, "groups": 5, "plus": 2, "paren": 2, "dots": 3, "at": 2, "before": 4, "after": 4, "length": 5, "share": 4, "hex": 2, "mixed": 2}
VECTORS = 4 * int(np.prod([7, 5, 2, 2, 3, 2, 4, 4])) + int(np.prod([5, 4, 2, 2]))

_SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"
_MATCH = "array<struct<start:bigint,end:bigint,body:string,before:string,after:string>>"


def _located(text: Column, pattern: str) -> Column:
    """All matches with start, end (code points), the text itself, and what stands before and after."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        begin = at + F.length(s["gap"])
        end = begin + F.length(s["body"])
        one = F.struct(begin.alias("start"), end.alias("end"), s["body"].alias("body"), F.right(s["gap"], F.lit(BEFORE)).alias("before"), F.left(s["next"], F.lit(1)).alias("after"))
        return end, F.array(one)

    def locate(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.arrays_zip(gaps.alias("gap"), found.alias("body"), F.slice(gaps, 2, F.size(found)).alias("next"))
        steps = F.slice(steps, 1, F.size(found))
        return F.when(F.size(found) > 0, folded(steps, F.lit(0).cast("long"), step, _MATCH)).otherwise(F.array().cast(_MATCH))

    return bound(found, locate)


def _guarded(text: Column, needs: str | None, value: Column) -> Column:
    """The matches where the text can have any; most texts stop here."""
    can = F.contains(text, F.lit(needs)) if needs else text.rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(can, value)


def _luhn(digits: Column) -> Column:
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, r"[^0-9]", "")


def _valid(kind: str, body: Column) -> Column:
    """Whether a match of the kind's pattern passes the kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return body.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(_digits(body)).between(14, 19), _luhn(_digits(body))).otherwise(F.lit(False))
    return F.length(_digits(body)).between(10, 15)


def _base(text: Column, kind: str) -> Column:
    good = F.filter(_located(text, BASE[kind]), lambda m: _valid(kind, m["body"]))
    rank = KINDS.index(kind)
    spans = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))
    return F.coalesce(_guarded(text, NEEDS[kind], spans), F.array().cast(_SPAN))


def _with_base(df: DataFrame) -> DataFrame:
    """Adds base, the base spans in order, to rows with body."""
    return df.withColumn("base", F.sort_array(F.concat(*[_base(F.col("body"), k) for k in KINDS])))


def _one(f: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    """A function of one column, as Spark counts a lambda's parameters."""
    return lambda x: f(kind, x)


def _blotted(text: Column) -> Column:
    """The text with a private character in place of each character of a base span, kind by kind."""

    def without(kind: str, text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(BASE[kind]), F.lit(0)), lambda m: F.when(_valid(kind, m), F.repeat(F.lit("\ue000"), F.length(m))).otherwise(m))
        pieces = F.zip_with(F.split(text, BASE[kind], -1), found, lambda g, m: F.concat(g, F.coalesce(m, F.lit(""))))
        return F.coalesce(_guarded(text, NEEDS[kind], F.array_join(pieces, "")), text)

    for kind in KINDS:
        text = bound(text, _one(without, kind))
    return text


def _bin(value: Column, edges: list[float]) -> Column:
    """How many edges the value reaches."""
    return reduce(lambda a, e: a + (value >= e).cast("int"), edges, F.lit(0))


def _class_of(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _features(name: str, m: Column) -> dict[str, Column]:
    body = m["body"]
    digits, size = F.length(_digits(body)), F.length(body)
    none = dict.fromkeys(BINS, F.lit(0)) | {"generator": F.lit([*LOOSE].index(name))}
    if name == "string":
        return none | {
            "length": _bin(size, [20, 32, 40, 64]),
            "share": _bin(digits / size, [0.01, 0.2, 0.5]),
            "hex": body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("int"),
            "mixed": body.rlike("[a-z0-9][A-Z]|[A-Z][0-9]").cast("int"),
        }
    return none | {
        "digits": _bin(digits, [7, 10, 13, 16, 17, 20]),
        "groups": F.least(F.lit(4), F.size(F.regexp_extract_all(body, F.lit("[0-9]+"), F.lit(0)))),
        "plus": F.startswith(body, F.lit("+")).cast("int"),
        "paren": F.contains(body, F.lit("(")).cast("int"),
        "dots": F.least(F.lit(2), size - F.length(F.replace(body, F.lit("."), F.lit("")))),
        "at": F.contains(body, F.lit("@")).cast("int"),
        "before": _class_of(F.right(m["before"], F.lit(1))),
        "after": _class_of(m["after"]),
    }


def _holds(kind: str, m: Column) -> Column:
    """The label of a proposal in training."""
    return m["before"].rlike(ANNOUNCED[kind])


_FIELDS = ",".join(f"{n}:int" for n in BINS)


def _with_proposals(df: DataFrame, body: Column) -> DataFrame:
    """Adds proposals: the loose spans in ``body`` with their features and, as holds, their label."""
    kinds, parts = f"array<struct<start:bigint,rank:int,end:bigint,kind:string,holds:boolean,{_FIELDS}>>", []
    df = df.withColumn("left", body)
    text = F.col("left")

    def proposed(name: str, kind: str) -> Callable[[Column], Column]:
        def one(m: Column) -> Column:
            values = [v.cast("int").alias(n) for n, v in _features(name, m).items()]
            return F.struct(m["start"].alias("start"), F.lit(ALL_KINDS.index(kind)).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), _holds(kind, m).alias("holds"), *values)

        return one

    for name, (pattern, kind, needs) in LOOSE.items():
        found = F.transform(_located(text, pattern), proposed(name, kind))
        parts.append(F.coalesce((F.when(text.rlike(needs), found) if needs else found).cast(kinds), F.array().cast(kinds)))
    return df.withColumn("proposals", F.concat(*parts)).drop("left")


@dataclass
class Tree:
    """A split on a feature, or a leaf."""

    value: float = 0.0
    feature: str | None = None
    cut: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def column(self, of: Callable[[str], Column]) -> Column:
        if self.feature is None:
            return F.lit(float(self.value))
        return F.when(of(self.feature) < self.cut, self.low.column(of)).otherwise(self.high.column(of))

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(next(iter(x.values()))), self.value)
        return np.where(x[self.feature] < self.cut, self.low.predict(x), self.high.predict(x))


@dataclass
class Model:
    prior: float
    trees: list[Tree]
    #: By kind: the score from which on a span is added, with no entry for kinds that add none, and the held-out precision from there on.
    thresholds: dict[str, float] = field(default_factory=dict)
    precision: dict[str, float] = field(default_factory=dict)
    #: Scores and the probabilities that begin there.
    steps: list[tuple[float, float]] = field(default_factory=list)

    def score(self, of: Callable[[str], Column]) -> Column:
        return reduce(lambda a, t: a + t.column(of), self.trees, F.lit(float(self.prior)))

    def probability(self, score: Column) -> Column:
        out = F.lit(0.0)
        for start, p in self.steps:
            out = F.when(score >= start, F.lit(p)).otherwise(out)
        return out

    def predict(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return self.prior + sum(t.predict(x) for t in self.trees)


def _grow(x: dict[str, np.ndarray], g: np.ndarray, h: np.ndarray, on: np.ndarray, depth: int) -> Tree:
    """A regression tree on gradients (Newton steps)."""
    whole = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    best = (1e-9, None, 0)
    if depth:
        for name, v in x.items():
            for cut in range(1, BINS[name]):
                a, b = on & (v < cut), on & (v >= cut)
                if a.any() and b.any() and (gain := whole(a) + whole(b) - whole(on)) > best[0]:
                    best = (gain, name, cut)
    if best[1] is None:
        return Tree(float(RATE * g[on].sum() / (h[on].sum() + 1.0)))
    _, name, cut = best
    return Tree(0.0, name, cut, _grow(x, g, h, on & (x[name] < cut), depth - 1), _grow(x, g, h, on & (x[name] >= cut), depth - 1))


def boost(x: dict[str, np.ndarray], positive: np.ndarray, total: np.ndarray) -> Model:
    """Boosted trees on counts by feature vector."""
    if not 0 < positive.sum() < total.sum():
        return Model(0.0, [])
    rate = positive.sum() / total.sum()
    model = Model(float(np.log(rate / (1 - rate))), [])
    score = np.full(len(total), model.prior)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(x, positive - total * p, total * p * (1 - p), np.ones(len(total), bool), DEPTH)
        model.trees.append(tree)
        score = score + tree.predict(x)
    return model


def calibrate(model: Model, score: np.ndarray, kind: np.ndarray, positive: np.ndarray, total: np.ndarray) -> None:
    """Probabilities and thresholds from held-out counts."""
    if not model.trees or not total.sum():
        return
    blocks: list[list[float]] = []  # pooled adjacent violators: start, positives, all
    for s in np.unique(score):
        on = score == s
        blocks.append([float(s), float(positive[on].sum()), float(total[on].sum())])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, p, n = blocks.pop()
            blocks[-1][1] += p
            blocks[-1][2] += n
    model.steps = [(s, p / n) for s, p, n in blocks if n]
    for k in ALL_KINDS:
        on = (kind == k) & (total > 0)
        if not 0 < positive[on].sum() < total[on].sum():
            continue
        order = np.argsort(-score[on], kind="stable")
        s, right, every = score[on][order], np.cumsum(positive[on][order]), np.cumsum(total[on][order])
        last = np.append(np.diff(s) != 0, True)  # equal scores go together
        good = np.flatnonzero((right / every >= PRECISION) & last)
        if len(good):
            below = s[good[-1] + 1] if good[-1] + 1 < len(s) else s[good[-1]]
            model.thresholds[k], model.precision[k] = float((s[good[-1]] + below) / 2), float(right[good[-1]] / every[good[-1]])


def _left_over() -> Column:
    """The text of rows with base that base spans leave over."""
    return F.when(F.size("base") > 0, _blotted(F.col("body"))).otherwise(F.col("body"))


def learn(docs: DataFrame, text: str = "text") -> Model:
    """The model from the counts of all proposals by feature vector and label, halves apart."""
    df = _with_proposals(_with_base(docs.select(text_or_empty(text).alias("body"))), _left_over())
    each = df.select(F.pmod(F.xxhash64("body", F.lit(5)), F.lit(2)).alias("half"), F.explode("proposals").alias("p")).select("half", "p.kind", "p.holds", *[f"p.{n}" for n in BINS])
    sums = [F.sum((F.col("half") == h).cast("long") * v).alias(f"{n}{h}") for h in (0, 1) for n, v in (("all", F.lit(1)), ("pos", F.col("holds").cast("long")))]
    counts = sorted(each.groupBy("kind", *BINS).agg(*sums).collect())  # VECTORS rows at most
    x = {n: np.array([r[n] for r in counts], np.int64) for n in BINS}
    column = lambda n: np.array([r[n] for r in counts], float)
    model = boost(x, column("pos0"), column("all0")) if counts else Model(0.0, [])
    calibrate(model, model.predict(x) if model.trees else np.zeros(len(counts)), np.array([r["kind"] for r in counts]), column("pos1"), column("all1"))
    return model


_SCORED = "array<struct<start:bigint,rank:int,end:bigint,kind:string,p:double>>"


def _resolved(spans: Column) -> Column:
    """Spans in order of start without overlaps: of two that overlap the more probable one stays, or the earlier one of equals."""
    last = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p"))
    closing = F.struct(F.lit(2**62).alias("start"), F.lit(0).alias("rank"), F.lit(2**62).alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("p"))

    def step(held: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= held["end"]
        out = F.when(free & (held["kind"] != ""), F.array(held)).otherwise(F.array().cast(_SCORED))
        return F.when(free | (s["p"] > held["p"]), last(s)).otherwise(held), out

    start = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("end"), F.lit("").alias("kind"), F.lit(0.0).alias("p"))
    return folded(F.concat(F.sort_array(spans), F.array(closing).cast(_SCORED)), start, step, _SCORED)


def _with_spans(df: DataFrame, model: Model) -> DataFrame:
    """Adds base and spans to rows with body."""
    df = _with_base(df)
    if not model.thresholds:
        return df.withColumn("spans", F.col("base"))
    return _with_chosen(_with_proposals(df, _left_over()), model)


def _with_chosen(df: DataFrame, model: Model) -> DataFrame:
    """Adds spans, the base spans and the chosen proposals, to rows with base and proposals."""
    cut = F.lit(float("inf"))
    scored = F.transform("proposals", lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"), model.score(lambda n: p[n]).alias("p")))

    def above(p: Column) -> Column:
        out = cut
        for kind, least in model.thresholds.items():
            out = F.when(p["kind"] == kind, F.lit(least)).otherwise(out)
        return p["p"] >= out

    chosen = F.transform(F.filter(scored, above), lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"), model.probability(p["p"]).alias("p")))
    df = df.withColumn("chosen", chosen).drop("proposals")
    kept = F.transform(F.when(F.size("chosen") > 1, _resolved(F.col("chosen"))).otherwise(F.col("chosen")), lambda p: F.struct(p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind")))
    return df.withColumn("spans", F.sort_array(F.concat("base", kept))).drop("chosen")


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: Model | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_secret and n_spans (all spans)."""
    model = model or learn(docs, text)
    df = _with_spans(docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("body")), model)

    def counted(kind: str, of: str = "base") -> Column:
        return F.size(F.filter(of, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return df.select("doc_id", *map(counted, KINDS), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"), counted("secret", "spans"), F.size("spans").cast("long").alias("n_spans"))


def recall(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """For each kind with base spans: kind, n_base, and n_found, those of them that the trees alone find when no base pattern is used."""
    df = _with_base(docs.select(text_or_empty(text).alias("body"))).where(F.size("base") > 0)
    found = _with_chosen(_with_proposals(df.withColumn("known", F.col("base")).withColumn("base", F.array().cast(_SPAN)), F.col("body")), model)
    each = found.select("spans", F.explode("known").alias("b"))
    covered = F.exists("spans", lambda s: (s["start"] <= F.col("b.start")) & (s["end"] >= F.col("b.end")))
    return each.groupBy("b.kind").agg(F.count("*").alias("n_base"), F.count_if(covered).alias("n_found"))


def redact(docs: DataFrame, text: str = "text", model: Model | None = None) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; where spans overlap, the earlier one is."""
    model = model or learn(docs, text)
    df = _with_spans(packed(docs, body=text_or_empty(text)), model)
    body = F.col("body")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        passed = F.substring(body, (at + 1).cast("int"), (s["start"] - at).cast("int"))
        free = s["start"] >= at
        return F.when(free, s["end"]).otherwise(at), F.when(free, F.array(passed, F.concat(F.lit("<"), s["kind"], F.lit(">")))).otherwise(F.array().cast("array<string>"))

    # A last span behind the text takes the rest along.
    closing = F.struct(F.length(body).cast("long").alias("start"), F.lit(0).alias("rank"), F.length(body).cast("long").alias("end"), F.lit("").alias("kind"))
    pieces = folded(F.concat("spans", F.array(closing)), F.lit(0).cast("long"), step, "array<string>")
    whole = F.array_join(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(1))), "")
    return unpacked(df, docs, **{text: F.when(F.size("spans") > 0, whole).otherwise(F.col("row")[text])})
