"""Personal data by weak supervision: labelers vote on spans, expectation-maximisation weighs them, and a classifier that
is trained on what it believes decides.

DataFrame functions only. What reaches the driver is one count for each kind and pattern of votes and features.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.plans.storage import written

KINDS = ["email", "ip", "card", "phone"]
#: Base patterns. A start inside a run is only tried at the end of the match before it: the same leftmost matches, in
#: time linear in the run. Possessive repeats keep long runs off the stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Without a match of these, a text has none of BASE.
HINT = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Wider patterns whose matches are candidates besides the base spans. Fixed values.
WIDER = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[a-z0-9-]++(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[a-z0-9-]++)++",
    "ip": r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-f:])",
    "card": r"(?<![0-9-])[0-9]{4}(?:[\x20-]?[0-9]{4}){2}[\x20-]?[0-9]{3,4}(?![0-9-])",
    "phone": r"(?<![0-9+(.-])(?:\([0-9]{2,4}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])",
}
WIDER_HINT = {"email": r"(?i)[\[({]at[\])}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Words near a span that speak for its kind, and endings of domains known to the gazetteer. Fixed values.
CONTEXT = {
    "email": r"(?i)mail|contact|write|reply|correo|kontakt|courriel",
    "ip": r"(?i)\bip\b|address|server|host|login|client|gateway",
    "card": r"(?i)card|visa|master|amex|credit|payment|karte|tarjeta|carte",
    "phone": r"(?i)phone|tel|call|mobile|fax|whatsapp|anruf|llama|appel",
}
AGAINST = r"(?i)version|isbn|invoice|order|serial|page|figure|section|\bno\.?\s*$|[=#/\\]\s*$"
DOMAINS = r"(?i)(?:\.|\[dot\]|\(dot\)|\{dot\})\s?(?:com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu)$"
NEAR = 40
#: Labelers, and how likely each vote (-1, 0, 1) is held to be before any text is read, for spans that are personal data
#: and for others. This counts as much as STRENGTH spans of each kind, so small tables are judged by it, large ones by themselves.
VOTES = ["form", "context", "against", "shape", "border"]
PRIOR = [
    ((0.30, 0.00, 0.70), (0.60, 0.00, 0.40)),
    ((0.00, 0.50, 0.50), (0.00, 0.85, 0.15)),
    ((0.03, 0.97, 0.00), (0.30, 0.70, 0.00)),
    ((0.05, 0.10, 0.85), (0.30, 0.30, 0.40)),
    ((0.10, 0.00, 0.90), (0.40, 0.00, 0.60)),
]
SHARE, STRENGTH = 0.7, 40
#: Features that no labeler reads: found by a wider pattern; a sign that introduces a value right before; a context word
#: that near; a sign that ends a value right after; more than sixteen code points.
MARKS = ["wide", "led", "close", "ended", "long"]


def _prefix(values: Column, i: Column) -> Column:
    """Sum of the first ``i`` numbers, in blocks of 256, so that many matches in one text stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = F.floor(i / 256).cast("int")
    return total(F.slice("sums", F.lit(1), block)) + total(F.slice(values, block * 256 + 1, i - block * 256))


def _located(docs: DataFrame, pattern: str, possible: Column, out: str) -> DataFrame:
    """Add ``out``: matches of ``pattern`` with start, end (code points, end exclusive), and what is around them."""
    none = F.array().cast("array<string>")
    df = docs.withColumn("m", F.when(possible, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("p", F.when(F.size("m") > 0, F.split("text", pattern, -1)).otherwise(none))
    df = df.withColumn("g", F.zip_with("m", F.slice("p", F.lit(1), F.size("m")), lambda a, b: F.length(a) + F.length(b)))
    parts = F.sequence(F.lit(0), F.floor((F.size("m") - 1) / 256).cast("int"))
    sums = F.transform(parts, lambda b: F.aggregate(F.slice("g", b * 256 + 1, F.lit(256)), F.lit(0), lambda x, y: x + y))
    df = df.withColumn("sums", F.when(F.size("m") > 0, sums).otherwise(F.array().cast("array<int>")))

    def span(x: Column, i: Column) -> Column:
        start = _prefix(F.col("g"), i) + F.length(F.get("p", i))
        before, after = F.get("p", i), F.coalesce(F.get("p", i + 1), F.lit(""))
        return F.struct(start.cast("long").alias("start"), (start + F.length(x)).cast("long").alias("end"), x.alias("match"), F.right(before, F.lit(NEAR)).alias("before"), F.left(after, F.lit(NEAR)).alias("after"))

    return df.withColumn(out, F.transform("m", span)).drop("m", "p", "g", "sums")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))

    def add(total: Column, i: Column) -> Column:
        v = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(v > 9, v - 9).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, x: Column) -> Column:
    """The base rule for a match: everything else is dropped."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(x))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & F.when(n.between(13, 19), _luhn(x)).otherwise(False)


def _passes(kind: str, span: Column) -> Column:
    return _valid(kind, span["match"])


def _named(kind: str, span: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def _votes(kind: str, span: Column) -> list[Column]:
    """For (1), against (-1) or no opinion (0): strict form, context words, contrary context, gazetteer or shape, borders."""
    match, before, after = span["match"], span["before"], span["after"]
    vote = lambda yes, no=F.lit(False): F.when(yes, 1).when(no, -1).otherwise(0)
    strict = match.rlike("^(?:" + BASE[kind].replace(r"(?:\G|", "(?:^|") + ")$") & _valid(kind, match)
    shape = {
        "email": vote(match.rlike(DOMAINS), ~match.rlike("[A-Za-z]")),
        "ip": vote(~match.rlike(r"^(?:0|255)\b"), match.rlike(r"^0*0\.")),
        "card": vote(match.rlike("^[3-6]") & _luhn(match), ~_luhn(match)),
        "phone": vote(F.length(_digits(match)).between(10, 13), F.length(_digits(match)) < 9),
    }[kind]
    joined = before.rlike(r"[\p{L}\p{N}]$") | after.rlike(r"^[\p{L}\p{N}]")
    return [vote(strict, ~strict), vote(before.rlike(CONTEXT[kind])), vote(F.lit(False), before.rlike(AGAINST)), shape, vote(~joined, joined)]


def _marks(kind: str, span: Column, wide: bool) -> list[Column]:
    close = F.right(span["before"], F.lit(14)).rlike(CONTEXT[kind])
    return [F.lit(wide), span["before"].rlike(r"[:(<\"'=] ?$"), close, span["after"].rlike(r"^[)>\"',.;\s]|^$"), F.length(span["match"]) > 16]


def _em(rows: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Belief that a span with these votes is personal data, from counts of patterns of votes: independent labelers,
    their reliabilities by expectation-maximisation from PRIOR on."""
    votes = {v: n for v, n in rows}
    yes_share, tables = SHARE, [tuple(np.maximum(p, 0.01) for p in pair) for pair in PRIOR]
    belief = {}
    for _ in range(rounds):
        for v in votes:
            z = math.log(yes_share / (1 - yes_share)) + sum(math.log(yes[x + 1] / no[x + 1]) for x, (yes, no) in zip(v, tables))
            belief[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        yes, no = sum(belief[v] * n for v, n in votes.items()), sum((1 - belief[v]) * n for v, n in votes.items())
        yes_share = (yes + SHARE * STRENGTH) / (yes + no + STRENGTH)
        for j, (of_yes, of_no) in enumerate(PRIOR):
            seen = np.zeros((2, 3))
            for v, n in votes.items():
                seen[:, v[j] + 1] += n * belief[v], n * (1 - belief[v])
            tables[j] = tuple((s + STRENGTH * np.maximum(p, 0.01)) / (s.sum() + STRENGTH * np.maximum(p, 0.01).sum()) for s, p in zip(seen, (of_yes, of_no)))
    return belief


def _trained(rows: list[tuple[tuple[int, ...], tuple[bool, ...], int]], rounds: int = 30) -> list[float]:
    """Logistic regression of the label model's beliefs on votes and features, by Newton's steps with a ridge: a bias,
    the weight of each labeler's vote for and against, the weight of each feature."""
    belief = _em([(v, n) for v, _, n in rows])
    x = np.array([_row(v, m) for v, m, _ in rows], float)
    y, n = np.array([belief[v] for v, _, _ in rows]), np.array([float(k) for _, _, k in rows])
    n *= min(1.0, 10_000 / n.sum())
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - 0.05 * w
        w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w)), slope)
    return [float(v) for v in w]


def _row(votes: tuple[int, ...], marks: tuple[bool, ...]) -> list[float]:
    return [1.0, *(float(v == 1) for v in votes), *(float(v == -1) for v in votes), *map(float, marks)]


def personal_data(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Spans of personal data in every whole text of ``docs`` (doc_id, text); null texts count as empty.

    Returns one row per row: the columns in ``keep`` (doc_id by default), base (array of kind, start, end: the matches
    of the base patterns that pass their rules, always kept) and spans (base and what the method adds: matches of wider
    patterns that overlap no base span and that the trained classifier holds for personal data rather than not). Both are
    ordered by kind as in KINDS, then start; positions are code points, ends exclusive. Repeated rows give repeated rows; an
    empty table gives none. Labelers' reliabilities and the classifier are learned from the table itself, from priors
    that stand for small ones. Wider matches of a text are held against its base spans one by one: the cost of a text is
    the product of their numbers.
    """
    kept = keep or ["doc_id"]
    df = docs.select(*(c for c in kept if c != "text"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _located(df, BASE[kind], F.col("text").contains(HINT[kind]) if HINT[kind] else F.lit(True), f"base_{kind}")
        df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", partial(_passes, kind)))
        df = _located(df, WIDER[kind], F.col("text").rlike(WIDER_HINT[kind]), f"wide_{kind}")
    base = F.flatten(F.array(*(F.transform(f"base_{k}", partial(_named, k)) for k in KINDS)))
    df = df.withColumn("base", base)

    def voted(kind: str, column: str, fresh: bool) -> Column:
        new = F.filter(column, lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))) if fresh else F.col(column)
        return F.transform(new, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit(fresh).alias("fresh"), F.array(*_votes(kind, x)).alias("votes"), F.array(*_marks(kind, x, fresh)).alias("marks")))

    every = F.flatten(F.array(*(voted(k, f"{a}_{k}", a == "wide") for k in KINDS for a in ("base", "wide"))))
    found = written(df.select(*kept, "base", every.alias("candidates")), "pii-candidates")
    one = found.select(F.explode("candidates").alias("c"))
    key = [F.col(f"c.{x}").alias(x) for x in ("kind", "votes", "marks")]
    counts = one.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).collect()  # bounded by the patterns: 4 * 3^5 * 2^5 rows
    model = {}
    for kind in KINDS:
        rows = sorted((tuple(r.votes), tuple(r.marks), r.n) for r in counts if r.kind == kind)
        if rows:
            model[kind] = _trained(rows)

    def odds(c: Column) -> Column:
        out = F.lit(-100.0)
        for kind, (bias, *weights) in model.items():
            z = F.lit(bias)
            for j in range(len(VOTES)):
                vote = F.get(c["votes"], F.lit(j))
                z = z + F.when(vote == 1, weights[j]).when(vote == -1, weights[len(VOTES) + j]).otherwise(0.0)
            for j in range(len(MARKS)):
                z = z + F.when(F.get(c["marks"], F.lit(j)), weights[2 * len(VOTES) + j]).otherwise(0.0)
            out = F.when(c["kind"] == kind, z).otherwise(out)
        return out

    added = F.filter("candidates", lambda c: c["fresh"] & (odds(c) > 0))
    place = F.create_map(*(F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)))
    bare = lambda a: F.transform(a, lambda x: F.struct(place[x["kind"]].alias("nth"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    spans = F.transform(F.array_sort(F.concat(bare(F.col("base")), bare(added))), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return found.select(*kept, "base", spans.alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the leftmost stands."""
    by_start = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(a: Column, x: Column) -> Column:
        between = F.substring(F.col(text), (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        tag = F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        fresh = x["start"] >= a["at"]
        return F.struct(F.when(fresh, F.concat(a["out"], between, tag)).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    rest = lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(by_start, empty, step, rest)).otherwise(F.col(text))
