"""Personal data: generated candidates, boosted trees over their format and context, calibrated thresholds.

Everything on the way from texts to spans is built-in functions; only a table of
counts of a fixed size comes to the driver, where the trees are grown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce


from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import whole_text

# --- fixed values: kinds in their order, and the patterns that define them -----
KINDS = ("email", "ip", "card", "phone")
#: Possessive where nothing could be given back, so that long runs need neither time nor stack.
BASE = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators with more recall than the patterns: spelled-out addresses, national numbers, other separators.
WIDE = {
    "email": r"[A-Za-z0-9._%+-]++(?:\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "ip": r"[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}",
    "card": r"[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{2,6}){2,5}",
    "phone": r"\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-]{1,2}[0-9]{4}",
}
#: What must be in a text for a pattern to be tried: a part of every match.
BASE_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
WIDE_NEEDS = {"email": r"[(\[\x20]at[)\]\x20]", "ip": r"[0-9](?:\.|\[\.\])[0-9]", "card": r"[0-9]{4}", "phone": r"[0-9]{4}"}
CUES = r"(?i)(?:e-?mail|contact|mail|tel|phone|call|fax|mobile|card|visa|account|ip|host|server|address)[^A-Za-z0-9]*$"
CONTEXT = 24
#: A date at the beginning of a candidate for a card.
DATED = r"^(?:19|20)[0-9]{2}[\x20._/-]{0,2}(?:0[1-9]|1[0-2])[\x20._/-]{0,2}(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
#: Numbers of values of the features, which bound the table the trees are grown from.
LEVELS = {"kind": 4, "digits": 7, "groups": 4, "before": 4, "after": 4, "cue": 2, "length": 5}


def running(lengths: Column) -> Column:
    """Start of each length in the sum so far, in stretches of 256, so that long arrays take linear time."""
    stretch = 256
    cut = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / stretch).cast("int"))),
        lambda c: F.slice(lengths, c * stretch + 1, stretch),
    )
    inner = F.transform(
        cut,
        lambda part: F.reduce(
            part, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
        ),
    )
    ends = F.transform(inner, lambda a: F.element_at(a, -1))
    offsets = F.reduce(ends, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    return F.flatten(
        F.transform(
            F.arrays_zip(inner.alias("i"), F.slice(offsets, 1, F.size(ends)).alias("o")),
            lambda z: F.transform(F.slice(z["i"], 1, F.size(z["i"]) - 1), lambda v: v + z["o"]),
        )
    )


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit of a string of digits is right."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.when(d.cast("int") * 2 > 9, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)
        ),
    )
    return F.reduce(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def sound(kind: str, found: Column) -> Column:
    """Whether a match passes the check of its kind."""
    n = F.length(_digits(found))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(
            F.split(F.regexp_replace(found, r"\[\.\]", "."), r"\."),
            lambda p: (F.length(part(p)) <= 3) & (F.left(part(p), F.lit(3)).cast("int") <= 255),
        )
    if kind == "card":
        return n.between(14, 19) & luhn(F.when(n.between(14, 19), _digits(found)).otherwise(F.lit("")))
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, needs: str) -> Column:
    tried = text.rlike(needs)
    return F.when(tried, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _located(docs: DataFrame, kind: str, pattern: str, needs: str, name: str) -> DataFrame:
    """An array column of (start, end, text, before, after, sound) of all matches of a pattern.

    The pieces between matches are what splitting leaves, so the lengths of both
    give the places; a text without any is passed over.
    """
    found, between, starts = f"_{name}_m", f"_{name}_s", f"_{name}_p"
    text = F.col("_text")
    docs = docs.withColumn(found, _matches(text, pattern, needs))
    docs = docs.withColumn(between, F.when(F.size(found) > 0, F.split(text, pattern, -1)))
    docs = docs.withColumn(
        starts,
        F.when(
            F.col(between).isNotNull(),
            running(
                F.transform(
                    F.arrays_zip(F.col(between).alias("s"), F.concat(F.array(F.lit("")), F.col(found)).alias("m")),
                    lambda z: F.length(z["s"]) + F.length(z["m"]),
                )
            ),
        ),
    )
    # The i-th sum ends behind the i-th piece between and the match before it; the first match starts at sum 1.
    made = F.transform(
        F.col(found),
        lambda m, i: F.struct(
            (F.get(F.col(starts), i + 1)).alias("start"), (F.get(F.col(starts), i + 1) + F.length(m)).alias("end"),
            m.alias("found"), F.right(F.get(F.col(between), i), F.lit(CONTEXT)).alias("before"),
            F.left(F.get(F.col(between), i + 1), F.lit(1)).alias("after"), sound(kind, m).alias("sound"),
        ),
    )
    kind_of = "array<struct<start:int,end:int,found:string,before:string,after:string,sound:boolean>>"
    return docs.withColumn(name, F.when(F.col(between).isNotNull(), made).otherwise(F.array()).cast(kind_of)).drop(
        found, between, starts
    )


def _band(value: Column, *limits: int) -> Column:
    """How many of the ascending limits a value reaches."""
    return reduce(lambda a, b: a + b, [F.when(value >= x, 1).otherwise(0) for x in limits])


def _side(char: Column) -> Column:
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def traits(kind: str, c: Column) -> dict[str, Column]:
    """Format and context of a candidate, each a small number below its LEVELS."""
    found = c["found"]
    return {
        "kind": F.lit(KINDS.index(kind)),
        "digits": _band(F.length(_digits(found)), 1, 7, 10, 14, 16, 20),
        "groups": _band(F.size(F.split(found, r"[^A-Za-z0-9]+")), 2, 3, 5),
        "before": _side(F.right(c["before"], F.lit(1))),
        "after": _side(c["after"]),
        "cue": c["before"].rlike(CUES).cast("int"),
        "length": _band(F.length(found), 8, 12, 16, 24),
    }


def refuted(kind: str, c: Column) -> Column:
    """Whether its surroundings, or a date in front, tell that a candidate is part of something else."""
    within = (_side(F.right(c["before"], F.lit(1))) == 2) | (_side(c["after"]) == 2)
    return within | c["found"].rlike(DATED) if kind == "card" else within


# --- boosted trees --------------------------------------------------------------

@dataclass(frozen=True)
class Tree:
    """Splits on `feature > limit`; a leaf has a value only."""

    value: float = 0.0
    feature: str = ""
    limit: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def score(self, row: dict[str, int]) -> float:
        if not self.feature:
            return self.value
        return (self.high if row[self.feature] > self.limit else self.low).score(row)

    def column(self, row: dict[str, Column]) -> Column:
        if not self.feature:
            return F.lit(self.value)
        return F.when(row[self.feature] > self.limit, self.high.column(row)).otherwise(self.low.column(row))


@dataclass(frozen=True)
class SpanModel:
    """Trees whose sum is the log odds of a candidate, and the least odds at which a kind is redacted."""

    trees: tuple[Tree, ...] = ()
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, row: dict[str, int]) -> float:
        return sum(t.score(row) for t in self.trees)

    def column(self, row: dict[str, Column]) -> Column:
        return reduce(lambda a, b: a + b, [t.column(row) for t in self.trees], F.lit(0.0))


def _grow(rows: list[tuple[dict, float, float]], depth: int, ridge: float = 1.0) -> Tree:
    """The tree that best fits gradients g with curvatures h, by exact search over all splits."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = Tree(value=g / (h + ridge))
    if not depth:
        return leaf
    best, at = 1e-9, None
    for name, levels in LEVELS.items():
        for limit in range(levels - 1):
            low_g = sum(r[1] for r in rows if r[0][name] <= limit)
            low_h = sum(r[2] for r in rows if r[0][name] <= limit)
            gain = low_g**2 / (low_h + ridge) + (g - low_g) ** 2 / (h - low_h + ridge) - g * g / (h + ridge)
            if gain > best + 1e-12:
                best, at = gain, (name, limit)
    if at is None:
        return leaf
    low = [r for r in rows if r[0][at[0]] <= at[1]]
    high = [r for r in rows if r[0][at[0]] > at[1]]
    return Tree(feature=at[0], limit=at[1], low=_grow(low, depth - 1, ridge), high=_grow(high, depth - 1, ridge))


def boost(
    table: list[tuple[dict[str, int], int, int]], rounds: int = 20, depth: int = 3, rate: float = 0.4, precision: float = 0.95,
) -> SpanModel:
    """Gradient boosting on counts: rows of traits, how many with them are personal data, and how many are not.

    A kind's threshold is the least score from which on its known candidates are
    personal data in `precision` of cases (smoothed); without such a score the kind
    gets none.
    """
    if not table:
        return SpanModel()
    trees: list[Tree] = []
    scores = [0.0] * len(table)
    for _ in range(rounds):
        rows = []
        for (row, yes, no), s in zip(table, scores):
            p = 1 / (1 + math.exp(-s))
            rows.append((row, yes - (yes + no) * p, (yes + no) * p * (1 - p)))
        grown = _grow(rows, depth)
        trees.append(_scaled(grown, rate))
        scores = [s + trees[-1].score(row) for (row, _, _), s in zip(table, scores)]
    thresholds = {}
    for i, kind in enumerate(KINDS):
        ranked = sorted(((s, yes, no) for (row, yes, no), s in zip(table, scores) if row["kind"] == i), reverse=True)
        good = bad = 0
        for s, yes, no in ranked:
            good, bad = good + yes, bad + no
            if s > 0 and (good + 0.5) / (good + bad + 1) >= precision:
                thresholds[kind] = s
    return SpanModel(tuple(trees), thresholds)


def _scaled(tree: Tree, rate: float) -> Tree:
    if not tree.feature:
        return Tree(value=round(tree.value * rate, 9))
    return Tree(feature=tree.feature, limit=tree.limit, low=_scaled(tree.low, rate), high=_scaled(tree.high, rate))


def with_candidates(docs: DataFrame) -> DataFrame:
    """Columns base_<kind> and wide_<kind> with the matches of both patterns; expects the text in _text."""
    for kind in KINDS:
        docs = _located(docs, kind, BASE[kind], BASE_NEEDS[kind], f"base_{kind}")
        docs = _located(docs, kind, WIDE[kind], WIDE_NEEDS[kind], f"wide_{kind}")
    return docs


def train(docs: DataFrame) -> SpanModel:
    """A model from all documents, of candidates that pass the check of their kind.

    Labels come from the base patterns, which the trees do not see: a candidate
    of either generator is personal data if it lies on a base match of its kind
    that passes the check, and is not if it lies on one of another kind or on a
    base match that fails. What lies on neither is unlabelled and takes no part;
    it is what the model is asked about. The trees see format and context alone,
    the check is a filter before and after training. Only counts by traits come
    to the driver: at most the product of LEVELS rows, whatever the size of the data.
    """
    named = docs.select(whole_text().alias("_text")).filter(F.col("_text").rlike("[0-9]|@"))
    named = with_candidates(named)

    def on(c: Column, kind: str, passing: bool) -> Column:
        return F.exists(
            f"base_{kind}", lambda b: (b["sound"] == F.lit(passing)) & (b["start"] < c["end"]) & (c["start"] < b["end"])
        )

    def described(kind: str) -> Column:
        def counted(c, yes):
            return F.struct(*(v.cast("int").alias(n) for n, v in traits(kind, c).items()), yes.alias("yes"))

        own = F.transform(F.filter(f"base_{kind}", lambda c: c["sound"]), lambda c: counted(c, F.lit(True)))
        other = lambda c: reduce(lambda a, b: a | b, [on(c, k, True) for k in KINDS if k != kind], on(c, kind, False))
        known = F.filter(f"wide_{kind}", lambda c: c["sound"] & (on(c, kind, True) | other(c)))
        return F.concat(own, F.transform(known, lambda c: counted(c, on(c, kind, True))))

    every = F.concat(*map(described, KINDS))
    counts = (
        named.select(F.explode(every).alias("c")).groupBy(*(F.col(f"c.{n}").alias(n) for n in LEVELS))
        .agg(F.sum(F.col("c.yes").cast("long")).alias("yes"), F.count("*").alias("all")).collect()
    )
    rows = [({n: r[n] for n in LEVELS}, r.yes, r["all"] - r.yes) for r in counts]
    return boost(sorted(rows, key=lambda r: tuple(r[0].values())))


def _listed(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, joined by commas."""
    return F.array_join(
        F.transform(
            F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["order"], s["end"]))),
            lambda s: F.concat_ws(":", F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["order"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def _count(spans: str, order: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["order"] == order)).cast("long")


_SPAN = "array<struct<start:int,end:int,order:int,score:double>>"


def with_spans(docs: DataFrame, model: SpanModel) -> DataFrame:
    """Columns base (spans of the base patterns) and added (those the model adds); expects the text in _text.

    An added span overlaps no base span and no added one of a higher score; of
    equal scores the earlier, then the kind listed first, stays.
    """
    docs = with_candidates(docs)

    def scored(source: str, kind: str, score) -> Column:
        return F.transform(
            F.filter(f"{source}_{kind}", lambda c: c["sound"] & ~refuted(kind, c) if source == "wide" else c["sound"]),
            lambda c: F.struct(
                c["start"].alias("start"), c["end"].alias("end"), F.lit(KINDS.index(kind)).alias("order"),
                score(c).alias("score"),
            ),
        ).cast(_SPAN)

    def offer(kind: str) -> Column:
        every = scored("wide", kind, lambda c: model.column(traits(kind, c)))
        return F.filter(every, lambda c: c["score"] >= model.thresholds[kind])

    docs = docs.withColumn("base", F.concat(*(scored("base", kind, lambda c: F.lit(0.0)) for kind in KINDS)))
    offered = [offer(kind) for kind in KINDS if kind in model.thresholds]
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    if offered:
        docs = docs.withColumn("_free", F.filter(F.concat(*offered), lambda a: ~F.exists("base", lambda b: meets(a, b))))
        first = lambda a, b: (
            (b["score"] > a["score"])
            | ((b["score"] == a["score"]) & (F.struct(b["start"], b["order"]) < F.struct(a["start"], a["order"])))
        )
        docs = docs.withColumn("added", F.filter("_free", lambda a: ~F.exists("_free", lambda b: meets(a, b) & first(a, b))))
    else:
        docs = docs.withColumn("added", F.array().cast(_SPAN))
    return docs


def personal_data(docs: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document.

    The counts and the digest are of the base spans: leftmost matches, dropped if
    they fail the check of their kind. `spans` lists base and added ones. Places are
    code points, ends exclusive. All built-in functions on a single row, no shuffle.

    Null text is empty: no spans, the digest of an empty string. Rows with equal or
    null ids give a row each; an empty table gives none; other columns are ignored.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("_text"))
    found = with_spans(named, model).select("doc_id", "base", "added")
    return found.select(
        "doc_id",
        *(_count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS)),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", "added")).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redacted(docs: DataFrame, model: SpanModel) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, in all their columns; n_chars follows the text.

    Overlapping spans are replaced as one, by the kind of the first. A null text stays null.
    """
    own = {"text": whole_text()}
    kept = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    found = with_spans(docs.select(kept, own["text"].alias("_text")), model)
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"], s["order"], s["end"])))
    found = found.select("_row", "_text", order.alias("_spans"))
    merged = F.reduce(
        "_spans", F.array().cast("array<struct<start:int,order:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(
                    F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.try_element_at(acc, F.lit(-1))["order"].alias("order"),
                    F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"),
                )),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"))))),
    )
    found = found.withColumn("_spans", F.when(F.size("_spans") > 0, merged))
    label = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    pieces = F.transform(
        "_spans",
        lambda s, i: F.concat(
            F.substring(
                "_text", F.coalesce(F.get(F.col("_spans"), i - 1)["end"], F.lit(0)) + 1,
                s["start"] - F.coalesce(F.get(F.col("_spans"), i - 1)["end"], F.lit(0)),
            ),
            F.element_at(label, s["order"] + 1),
        ),
    )
    clean = F.when(
        F.col("_spans").isNotNull(),
        F.concat(F.array_join(pieces, ""), F.substring("_text", F.element_at("_spans", -1)["end"] + 1, F.length("_text"))),
    ).otherwise(F.col("_row")["text"])
    found = found.withColumn("_clean", clean)
    return found.select(*(
        F.col("_clean").alias(c) if c == "text"
        else F.coalesce(F.length("_clean").cast(t), F.col("_row")[c]).alias(c) if c == "n_chars"
        else F.col("_row")[c].alias(c)
        for c, t in docs.dtypes
    ))
