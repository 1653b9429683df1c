"""Personal data: base patterns, labelers that vote, EM reliabilities and a span classifier, in Spark expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattshelf.session import materialise

#: Base kinds in the order of the contract: name, pattern, cheap test. Possessive repeats and the start
#: conditions (start of a run, or end of the previous match) find the same matches in linear time.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
#: Further candidates that only the labelers judge: obfuscated addresses and numbers without a plus sign.
EXTRA = (
    ("email_like", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(] ?(?:at|AT) ?[\])] ?[A-Za-z0-9-]{2,63}(?: ?(?:[\[(] ?(?:dot|DOT) ?[\])]|\.) ?[A-Za-z0-9-]{2,63}){1,4}", "at"),
    ("phone_like", r"(?<![+0-9A-Za-z.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", None),
    ("id_like", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "-"),
)
KINDS = tuple(kind for kind, _, _ in BASE + EXTRA)
N_BASE = len(BASE)
CONTEXT = 24
#: Words before a span that speak for personal data, and such that speak against it.
CONTEXT_FOR = r"(?i)(?:e-?mails?|mail|mailto|contact|reach|write|phone|tel|telephone|call|fax|mobile|cell|card|visa|iban|account|ip|address|ssn|social security|id)[ :.#=(]{0,4}$"
CONTEXT_AGAINST = r"(?i)(?:version|v|isbn|issn|section|chapter|page|pages|fig|figure|table|step|serial|order|part|no|nr|sku|doi|rfc)[ :.#=(]{0,4}$"
#: Gazetteers: ends of host names, card issuers, reserved number ranges.
HOST_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "it", "nl", "eu", "ch", "at", "us", "ca", "au", "jp")
CARD_STARTS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|6011|65|35|62)"
LABELERS = ("pattern", "gazetteer", "context")
#: What the classifier sees besides kind and votes: length class, kinds of separators, a neighbour of the same kind.
LENGTHS = (12, 16, 24)
SHAPES = ("length", "separators", "neighbour")
N_SHAPES = len(LENGTHS) + 1 + 3 + 2
#: Spans of a text are handled in blocks of so many, so that long lists cost time in proportion.
BLOCK = 128
ROUNDS = 50
THRESHOLD = 0.9


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string is right."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, F.lit(0) + i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 1, F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2)).otherwise(value(i))
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + doubled(i))
    return total % 10 == 0


def base_valid(kind: str, span: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(span, r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    digits = digits_of(span)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def bound(value: Column, use) -> Column:
    """``use(value)``, with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_blocks(values: Column) -> Column:
    """An array as an array of arrays of at most ``BLOCK`` elements."""

    def cut(held):
        count = F.ceil(F.size(held) / F.lit(BLOCK)).cast("int")
        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK)))

    return bound(values, cut)


def running(values: Column, start: Column, step) -> Column:
    """For each element of an array of bigint, ``step`` over those before it, from ``start``."""
    empty = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(
        values, empty,
        lambda s, v: F.struct(step(s["at"], v).cast("bigint").alias("at"), F.array_append(s["out"], s["at"]).alias("out")),
        lambda s: s["out"],
    )


def occurrences(text: Column, kind: int, pattern: str, probe: str | None) -> Column:
    """All leftmost non-overlapping matches as array<struct(start, kind, end, span, before)>, in code points.

    ``split`` gives the pieces between matches, so positions are running sums of piece and match lengths: over blocks of
    matches, then inside each block. ``before`` is the end of the piece in front of a match.
    """
    pieces = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    entry = "struct<start:bigint,kind:int,end:bigint,span:string,before:string>"

    def step(state, pair):
        begin = state["at"] + F.length(pair["piece"])
        end = begin + F.length(pair["span"])
        item = F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["span"].alias("span"),
            F.right(pair["piece"], F.lit(CONTEXT)).alias("before"),
        )
        return F.struct(end.alias("at"), F.array_append(state["out"], item.cast(entry)).alias("out"))

    def listed_in(block, at):
        start = F.struct(at.alias("at"), F.array().cast(f"array<{entry}>").alias("out"))
        return F.aggregate(block, start, step, lambda state: state["out"])

    pairs = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, s: F.struct(p.alias("piece"), s.alias("span")))

    def placed(blocks):
        lengths = F.transform(
            blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda n, pair: n + F.length(pair["piece"]) + F.length(pair["span"]))
        )
        return F.flatten(F.zip_with(blocks, running(lengths, F.lit(0), lambda at, n: at + n), listed_in))

    listed = bound(in_blocks(pairs), placed)
    test = F.contains(text, F.lit(probe)) if probe else F.lit(True)
    digit = F.lit(True) if kind in (0, N_BASE) else text.rlike("[0-9]")
    return F.when(test & digit & text.rlike(pattern), listed).otherwise(F.array().cast(f"array<{entry}>"))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): all base matches and further candidates of each whole text, by start and kind."""
    text = F.coalesce("text", F.lit(""))
    found = [occurrences(text, i, pattern, probe) for i, (_, pattern, probe) in enumerate(BASE + EXTRA)]
    return docs.select("doc_id", F.array_sort(F.concat(*found)).alias("spans"))


def votes(span: Column) -> Column:
    """The labelers' votes on a candidate struct: 1 personal, 0 not, null abstains; plus the base verdict."""
    kind, text, before = span["kind"], span["span"], span["before"]
    digits = digits_of(text)
    valid = F.lit(None).cast("boolean")
    for i, (name, _, _) in enumerate(BASE):
        valid = F.when(kind == i, base_valid(name, text)).otherwise(valid)
    last = F.element_at(F.split(F.lower(text), r"[. \[\]()]+"), -1)
    repeated = digits.rlike(r"^(\d)\1*$")
    pattern = (
        F.when(kind < N_BASE, valid)
        .when(kind == 5, ~digits.rlike("^[01]") & ~repeated)
        .when(kind == 6, ~digits.rlike("^(?:000|666|9)") & ~digits.rlike("0000$") & ~repeated)
    )
    gazetteer = (
        F.when(kind.isin(0, 4), F.when(last.isin(*HOST_ENDS), True))
        .when(kind == 2, digits.rlike(CARD_STARTS))
        .when(kind == 1, F.when(text.rlike(r"^(?:0+|255)\."), False))
        .when(kind.isin(3, 5), F.when(repeated, False))
    )
    context = F.when(before.rlike(CONTEXT_FOR), True).when(before.rlike(CONTEXT_AGAINST), False)
    return F.struct(
        pattern.cast("int").alias("pattern"), gazetteer.cast("int").alias("gazetteer"), context.cast("int").alias("context"),
        F.coalesce(valid, F.lit(False)).alias("valid"), *shape(span),
    )


def shape(span: Column) -> list[Column]:
    """Small integers per candidate: its length class, its kinds of separators (2: two or more), whether another match of its kind is near."""
    separators = F.length(F.regexp_replace(span["span"], r"[A-Za-z0-9]|(.)(?=.*\1)", ""))
    near = (F.length(span["before"]) < CONTEXT) & (span["start"] > F.length(span["before"]))
    size = sum(((F.length(span["span"]) >= n).cast("int") for n in LENGTHS), F.lit(0))
    return [size.alias("length"), F.least(separators, F.lit(2)).alias("separators"), near.cast("int").alias("neighbour")]


class Reliability(NamedTuple):
    """What EM estimates per kind: the share of personal spans, and per labeler (P(1 | yes), P(1 | no))."""

    prior: float
    rates: tuple[tuple[float, float], ...]

    def posterior(self, pattern: Sequence[int | None]) -> float:
        yes, no = math.log(self.prior), math.log(1 - self.prior)
        for vote, (hit, false) in zip(pattern, self.rates):
            if vote is not None:
                yes += math.log(hit if vote else 1 - hit)
                no += math.log(false if vote else 1 - false)
        return 1 / (1 + math.exp(max(-500.0, min(500.0, no - yes))))


def estimate(patterns: Sequence[tuple[tuple[int | None, ...], int]], rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation for labelers that err independently, over counted vote patterns.

    There are at most 3 ^ labelers patterns, whatever the number of spans. Labelers start as better than
    chance; counts are smoothed by a prior of that belief, so that an unopposed labeler keeps it.
    """
    model = Reliability(0.5, tuple((0.8, 0.2) for _ in LABELERS))
    total = sum(n for _, n in patterns)
    for _ in range(rounds):
        weights = [(votes_, n, model.posterior(votes_)) for votes_, n in patterns]
        rates = []
        for i in range(len(LABELERS)):
            yes = sum(n * q for v, n, q in weights if v[i] is not None)
            no = sum(n * (1 - q) for v, n, q in weights if v[i] is not None)
            hit = sum(n * q for v, n, q in weights if v[i] == 1)
            false = sum(n * (1 - q) for v, n, q in weights if v[i] == 1)
            rates.append(((hit + 8) / (yes + 10), (false + 2) / (no + 10)))
        model = Reliability((sum(n * q for _, n, q in weights) + 5) / (total + 10), tuple(rates))
    return model


def shape_marks(shapes: Sequence[int]) -> list[float]:
    length, separators, neighbour = shapes
    return [float(length == i) for i in range(len(LENGTHS) + 1)] + [float(separators == i) for i in range(3)] + [float(neighbour == i) for i in range(2)]


def features(kind: int, pattern: Sequence[int | None], shapes: Sequence[int]) -> list[float]:
    """Of the span classifier: bias, kinds, two marks per labeler (for, against), and the marks of the shape."""
    marks = [float(vote == side) for vote in pattern for side in (1, 0)]
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], *marks, *shape_marks(shapes)]


Cell = tuple[int, tuple[int | None, ...], tuple[int, ...], int, float]


def train(cells: Sequence[Cell], rounds: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic regression by gradient descent on soft labels, over counted cells (kind, votes, shape, n, posterior).

    There are at most kinds x 27 x 24 cells, whatever the number of spans.
    """
    rows = [(features(kind, pattern, shapes), math.log1p(n), q) for kind, pattern, shapes, n, q in cells]
    weights = [0.0] * (1 + len(KINDS) + 2 * len(LABELERS) + N_SHAPES)
    total = sum(n for _, n, _ in rows) or 1.0
    for _ in range(rounds):
        slope = [0.001 * w for w in weights]
        for x, n, q in rows:
            error = 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x) if b))) - q
            for i, a in enumerate(x):
                if a:
                    slope[i] += error * n / total
        weights = [w - rate * g * 4 for w, g in zip(weights, slope)]
    return weights


def classifier(weights: Sequence[float], span: Column, vote: Column) -> Column:
    """The trained probability that a candidate is personal data, as a Spark expression."""
    score, at = F.lit(weights[0]), 1
    marks = [span["kind"] == k for k in range(len(KINDS))]
    marks += [vote[name] == side for name in LABELERS for side in (1, 0)]
    marks += [vote[name] == i for name, n in zip(SHAPES, (len(LENGTHS) + 1, 3, 2)) for i in range(n)]
    for at, mark in enumerate(marks, 1):
        score = score + F.when(mark, F.lit(weights[at])).otherwise(0.0)
    return 1 / (1 + F.exp(-score))


def clear_of(sure: Column, others: Column) -> Column:
    """Those of ``others`` (arrays of start, kind, end) that overlap none of ``sure``.

    Both are merged by start and looked at in blocks: a span meets the sure ones of its block, the furthest end
    before the block and the next start after it.
    """
    far = F.lit(1 << 40).cast("bigint")
    tagged = lambda spans, own: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(own).alias("sure")))
    merged = F.array_sort(F.concat(tagged(sure, True), tagged(others, False)))

    def chosen(blocks):
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(-1).cast("bigint"), lambda m, z: F.when(z["sure"], F.greatest(m, z["end"])).otherwise(m)))
        starts = F.transform(blocks, lambda b: F.aggregate(b, far, lambda m, z: F.when(z["sure"], F.least(m, z["start"])).otherwise(m)))
        before = running(ends, F.lit(-1), lambda m, e: F.greatest(m, e))
        after = F.reverse(running(F.reverse(starts), far, lambda m, e: F.least(m, e)))
        seen = F.zip_with(before, after, lambda b, a: F.struct(b.alias("before"), a.alias("after")))
        inside = lambda block, e: F.filter(
            block,
            lambda z: ~z["sure"] & (e["before"] <= z["start"]) & (e["after"] >= z["end"])
            & ~F.exists(block, lambda s: s["sure"] & (s["start"] < z["end"]) & (z["start"] < s["end"])),
        )
        return F.flatten(F.zip_with(blocks, seen, inside))

    left = bound(in_blocks(merged), chosen)
    return F.transform(left, lambda z: F.struct(z["start"].alias("start"), z["kind"].alias("kind"), z["end"].alias("end")))


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, weights.

    Base spans (their patterns and checks are fixed) always stand. Other candidates - base matches that
    failed their check, obfuscated addresses, numbers without a plus sign - stand if the span classifier
    gives them at least ``threshold``. The classifier learns from soft labels: three labelers vote on
    each candidate, EM estimates their reliabilities per kind from the counts of vote patterns in all
    documents. The classifier sees kind, votes, length, separators and neighbours. Only counts of such cells (at most
    7 x 27 x 24) come to the driver. Time grows in proportion to the spans of a text.
    ``spans`` lists kind:start:end by start, then kind; a candidate inside a span that stands is dropped.

    Null texts are empty; texts without spans give counts of 0, an empty list and its hash; repeated
    rows are searched each; an empty table gives no rows; other columns are ignored.
    """
    found = candidates(docs).withColumn("votes", F.transform("spans", votes))
    slim = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    held = materialise(found.select("doc_id", slim.alias("spans"), "votes"), "pii-candidates")
    counted = (
        held.select(F.explode(F.arrays_zip("spans", "votes")).alias("z"))
        .groupBy(F.col("z.spans.kind").alias("kind"), *[F.col(f"z.votes.{name}").alias(name) for name in (*LABELERS, *SHAPES)])
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("kind", *LABELERS, *SHAPES)
        .collect()
    )
    by_kind: dict[int, dict[tuple, int]] = {}
    for row in counted:
        patterns = by_kind.setdefault(row["kind"], {})
        pattern = tuple(row[name] for name in LABELERS)
        patterns[pattern] = patterns.get(pattern, 0) + row["n"]
    models = {kind: estimate(list(patterns.items())) for kind, patterns in by_kind.items()}
    cells = []
    for row in counted:
        pattern = tuple(row[name] for name in LABELERS)
        cells.append((row["kind"], pattern, tuple(row[name] for name in SHAPES), row["n"], models[row["kind"]].posterior(pattern)))
    weights = train(cells)
    zipped = F.arrays_zip("spans", "votes")
    sure = F.filter(zipped, lambda z: z["votes"]["valid"])
    likely = F.filter(zipped, lambda z: ~z["votes"]["valid"] & (classifier(weights, z["spans"], z["votes"]) >= threshold))
    order = lambda zs: F.array_sort(F.transform(zs, lambda z: z["spans"]))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )
    judged = (
        held.withColumn("_sure", sure)
        .withColumn("_base", order(F.col("_sure")))
        .withColumn("_likely", order(likely))
        .withColumn("_all", F.when(F.size("_likely") > 0, F.array_sort(F.concat("_base", clear_of(F.col("_base"), F.col("_likely"))))).otherwise(F.col("_base")))
    )
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("bigint")
    return judged.select(
        "doc_id",
        *[count(k).alias(f"n_{kind}") for k, (kind, _, _) in enumerate(BASE)],
        F.sha2(shown(F.col("_base")), 256).alias("base_sha256"),
        shown(F.col("_all")).alias("spans"),
        F.size("_all").cast("bigint").alias("n_spans"),
    )
