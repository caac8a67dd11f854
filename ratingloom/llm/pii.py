"""Find and redact personal data: overlapping candidates, boosted trees, calibrated thresholds.

Generators propose spans with high recall. Spans of the four base kinds that pass their check always count. A small
gradient-boosted model over format and context decides on the rest: its features take few values, so the candidates of all documents are
reduced to a table of cells by one Spark aggregation, the trees are fitted to the cells, and they become one Spark
expression. No labels of spans exist; the cells are labelled by rules (``_likely``) that see the value, while the trees see
only counted format and surroundings. A kind's threshold is the lowest score from which held-out cells are right in
``precision`` of all cases. A kind without such a score, be it for want of held-out cells, is decided by its rule.

All work is inside a row, in characters of the whole text. Null text is empty and has no spans; repeated rows get equal
results; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.arrays import let, matches

LOCAL = "A-Za-z0-9._%+-"
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret", "number", "email_at"]
# The base patterns in forms that find the same spans in linear time: a match starts after the last one or after another character.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}",
    "number": r"(?<![0-9])[0-9]{3}\)?[\x20.-][0-9]{2,3}[\x20.-][0-9]{4}(?![0-9])",
    "email_at": rf"(?<![{LOCAL}])[{LOCAL}]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
}
CUE = r"(?i)(token|key|secret|passw(or)?d|pwd|phone|tel|call|mail|contact|card|account|ssn|address)\W*$"
FEATURES = {"kind": len(KINDS), "valid": 3, "digits": 6, "letters": 3, "signs": 4, "cue": 2, "left": 3, "right": 3}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weighed(c: Column, i: Column) -> Column:
        n = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda t, n: t + n) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    """The check of a base kind."""
    size = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.when(size.between(12, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    return size.between(9, 15)


def _likely(kind: str, value: Column) -> Column:
    """Label of a candidate for fitting the trees."""
    if kind in BASE_KINDS:
        return _passes(kind, value)
    if kind == "secret":
        letters, digits = F.regexp_count(value, F.lit("[A-Za-z]")), F.regexp_count(value, F.lit("[0-9]"))
        hexadecimal = F.rlike(value, F.lit("^[0-9a-f]+$|^[0-9A-F]+$"))
        return (letters >= 4) & (digits >= 4) & (hexadecimal | ~F.rlike(value, F.lit("[A-Za-z]{8,}")))
    if kind == "number":
        return F.rlike(value, F.lit(r"^[0-9]{3}(\)\x20|[.-])[0-9]{3}[.-][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$"))
    return F.lit(True)


def _bucket(count: Column, limits: list[int]) -> Column:
    return reduce(lambda a, b: a + b, [(count >= n).cast("int") for n in limits])


def _edge(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit(r"^\s?$")), 0).when(F.rlike(c, F.lit(r"[\p{L}\p{N}_]")), 2).otherwise(1)


def _candidates(text: Column, kind: str) -> Column:
    def described(m: Column) -> Column:
        value = m["value"]
        valid = _passes(kind, value).cast("int") if kind in BASE_KINDS else F.lit(2)
        return F.struct(
            F.lit(KINDS.index(kind)).alias("kind"),
            m["start"].alias("start"),
            m["end"].alias("end"),
            valid.alias("valid"),
            _bucket(F.regexp_count(value, F.lit("[0-9]")), [7, 9, 12, 16, 20]).alias("digits"),
            _bucket(F.regexp_count(value, F.lit("[A-Za-z]")), [1, 5]).alias("letters"),
            _bucket(F.regexp_count(value, F.lit("[^A-Za-z0-9]")), [1, 3, 5]).alias("signs"),
            F.rlike(m["before"], F.lit(CUE)).cast("int").alias("cue"),
            _edge(F.right(m["before"], F.lit(1))).alias("left"),
            _edge(m["after"]).alias("right"),
            F.coalesce(_likely(kind, value), F.lit(False)).alias("likely"),
        )

    return F.transform(matches(text, PATTERNS[kind]), described)


def candidates(text: Column) -> Column:
    """All proposed spans of a text with their features."""
    whole = F.coalesce(text, F.lit(""))
    return let(whole, lambda t: F.concat(*[_candidates(t, kind) for kind in KINDS]))


@dataclass(frozen=True)
class Split:
    """``feature >= limit``; ``kind`` is compared for equality."""

    feature: str
    limit: int

    def holds(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        found = cells[self.feature]
        return found == self.limit if self.feature == "kind" else found >= self.limit

    def column(self, c: Column) -> Column:
        return c["kind"] == self.limit if self.feature == "kind" else c[self.feature] >= self.limit


Tree = tuple[Split, tuple[Split, float, float], tuple[Split, float, float]]  # root, when it holds, when not


@dataclass(frozen=True)
class Model:
    trees: tuple[Tree, ...]
    thresholds: dict[int, float]

    def column(self, c: Column) -> Column:
        def leaf(branch: tuple[Split, float, float]) -> Column:
            return F.when(branch[0].column(c), F.lit(branch[1])).otherwise(F.lit(branch[2]))

        scores = [F.when(root.column(c), leaf(yes)).otherwise(leaf(no)) for root, yes, no in self.trees]
        return reduce(lambda a, b: a + b, scores, F.lit(0.0))

    def accepts(self, c: Column) -> Column:
        if not self.thresholds:
            return c["likely"]
        least = F.element_at(F.create_map(*[F.lit(x) for kind, t in sorted(self.thresholds.items()) for x in (kind, t)]), c["kind"])
        return F.coalesce(self.column(c) >= least, c["likely"])


def boost(cells: dict[str, np.ndarray], y: np.ndarray, w: np.ndarray, rounds: int = 16, rate: float = 0.5) -> tuple[Tree, ...]:
    """Trees of depth two on weighted cells, by Newton steps of the logistic loss."""
    splits = [Split(f, n) for f, size in FEATURES.items() for n in range(0 if f == "kind" else 1, size)]
    held = np.array([s.holds(cells) for s in splits])
    score, trees = np.zeros(len(y)), []

    def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + 1.0)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = w * (y - p), w * p * (1 - p)

        def best(rows: np.ndarray, g: np.ndarray = g, h: np.ndarray = h) -> tuple[int, float, float]:
            gy, hy = (held & rows) @ g, (held & rows) @ h
            gn, hn = g[rows].sum() - gy, h[rows].sum() - hy
            n = int(np.argmax(worth(gy, hy) + worth(gn, hn)))
            return n, rate * float(gy[n] / (hy[n] + 1.0)), rate * float(gn[n] / (hn[n] + 1.0))

        root = best(np.ones(len(y), bool))[0]
        yes, no = best(held[root]), best(~held[root])
        trees.append((splits[root], (splits[yes[0]], *yes[1:]), (splits[no[0]], *no[1:])))
        score += np.where(held[root], np.where(held[yes[0]], yes[1], yes[2]), np.where(held[no[0]], no[1], no[2]))
    return tuple(trees)


def _scores(trees: tuple[Tree, ...], cells: dict[str, np.ndarray]) -> np.ndarray:
    total = np.zeros(len(cells["kind"]))
    for root, yes, no in trees:
        leaf = [np.where(b[0].holds(cells), b[1], b[2]) for b in (yes, no)]
        total += np.where(root.holds(cells), leaf[0], leaf[1])
    return total


def learn(docs: DataFrame, precision: float = 0.98, text: str = "text") -> Model:
    """Fit the trees and thresholds to the candidates of all documents; a third of the ids, chosen by a hash, is held out."""
    found = docs.select("doc_id", F.explode(candidates(F.col(text))).alias("c"))
    part = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("held_out")
    cells = found.groupBy(*[f"c.{f}" for f in FEATURES], "c.likely", part).count().collect()  # a cell per combination of small codes
    if not cells:
        return Model((), {})
    cells.sort()
    x = {f: np.array([c[f] for c in cells]) for f in FEATURES}
    y, w = np.array([float(c["likely"]) for c in cells]), np.array([float(c["count"]) for c in cells])
    out = np.array([c["held_out"] for c in cells])
    trees = boost({f: v[~out] for f, v in x.items()}, y[~out], np.sqrt(w[~out])) if (~out).any() else ()
    score, thresholds = _scores(trees, x), {}
    for kind in range(len(KINDS)):
        mine = (x["kind"] == kind) & out
        good = [
            t for t in np.unique(score[mine]) if t > 0 and (y * w)[mine & (score >= t)].sum() >= precision * w[mine & (score >= t)].sum()
        ]
        if good:
            thresholds[kind] = float(min(good)) - 1e-9
    return Model(trees, thresholds)


def spans(text: Column, model: Model) -> Column:
    """Spans as structs of start, kind number, end and whether a base rule gives it, in order."""

    def kept(found: Column) -> Column:
        base = lambda c: (c["kind"] < len(BASE_KINDS)) & (c["valid"] == 1)
        chosen = F.filter(found, lambda c: base(c) | model.accepts(c))
        made = F.transform(
            chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), base(c).alias("base"))
        )
        return F.array_sort(F.array_distinct(made))

    return let(candidates(text), kept)


def written(found: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(found, one), ",")


def redacted(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; spans that overlap become one."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    first = F.struct(F.lit("").alias("done"), F.lit(0).alias("end"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["end"] + 1, F.greatest(s["start"] - acc["end"], F.lit(0)))
        tag = F.when(s["start"] >= acc["end"], F.concat(gap, F.get(names, s["kind"]))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["done"], tag).alias("done"), F.greatest(acc["end"], s["end"]).alias("end"))

    whole = F.aggregate(found, first, step, lambda acc: F.concat(acc["done"], F.substring(text, acc["end"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, whole).otherwise(text)
