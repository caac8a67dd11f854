"""Quality rules: statistics of a text, and a decision list learned from labelled texts.

``statistics`` counts in one row with array functions. ``learn_rules`` takes at most ``bound`` labelled documents,
grows conjunctions of thresholds one after the other (sequential covering), prunes each on held-out rows and keeps it if
it is right often enough. The list becomes one ordered conditional expression, so filtering needs no Python worker and
no shuffle.

Null text has no words and fails the base rule. Repeated rows and ties get equal results. Other columns stay, those named
like a statistic too, since the statistics sit in one struct column of a name of the caller's choice. With no labelled rows, or labels of one kind
only, the list is empty and the base rule decides alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.arrays import indices, let, split_words
from ratingloom.staging import stage

BOUND = 8192
WINDOW = 5
FEATURES = ["symbol_rate", "bang_rate", "upper_rate", "repeat_rate", "dup_line_rate", "word_length", "n_words"]


def _repeated_words(words: Column) -> Column:
    """Words in windows of five whose words occur in the text twice or more.

    A window's hash and its place share one 64-bit number, so one sort of numbers brings equal windows together;
    neighbours with equal hashes are compared word by word.
    """

    def found(ws: Column) -> Column:
        bits = F.length(F.bin(F.size(ws).cast("long")))
        return let(
            F.struct(F.transform(ws, lambda w: F.xxhash64(w)).alias("h"), bits.alias("bits")),
            lambda x: let(_sorted_windows(x), lambda s: let(_repeats(ws, s, x["bits"]), _covered)),
        )

    def _sorted_windows(x: Column) -> Column:
        def window(i: Column) -> Column:
            hashed = F.xxhash64(*[F.get(x["h"], i + n) for n in range(WINDOW)])
            return F.call_function("shiftleft", hashed, x["bits"]).bitwiseOR(i.cast("long"))

        return F.array_sort(F.transform(indices(F.size(x["h"]) - WINDOW + 1), window))

    def _repeats(ws: Column, s: Column, bits: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def equal(one: Column, two: Column) -> Column:
            far = F.call_function("shiftright", one.bitwiseXOR(two), bits) == 0
            here, there = ((v.bitwiseAND(mask) + 1).cast("int") for v in (one, two))
            return far & (F.slice(ws, here, F.lit(WINDOW)) == F.slice(ws, there, F.lit(WINDOW)))

        kept = F.filter(
            s,
            lambda v, i: F.coalesce(equal(v, F.get(s, i + 1)), F.lit(False)) | ((i > 0) & F.coalesce(equal(v, F.get(s, i - 1)), F.lit(False))),
        )
        return F.array_sort(F.transform(kept, lambda v: v.bitwiseAND(mask)))

    def _covered(places: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))
        return F.aggregate(
            places,
            start,
            lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["total"] + p + WINDOW - F.greatest(acc["end"], p)).alias("total")),
            lambda acc: acc["total"],
        )

    return F.when(F.size(words) > WINDOW, found(words)).otherwise(F.lit(0).cast("long"))


def statistics(text: Column) -> Column:
    """A struct of counts of one text."""
    whole = F.coalesce(text, F.lit(""))

    def lines(found: Column) -> Column:
        return F.size(found) - F.size(F.array_distinct(found))

    dup_lines = let(F.filter(F.split(whole, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), lines)

    def body(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda t, w: t + F.length(w)).alias("word_chars"),
            F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup_lines.cast("long").alias("n_dup_lines"),
            _repeated_words(words).alias("n_repeat_words"),
            F.regexp_count(whole, F.lit("!")).cast("long").alias("n_bangs"),
            F.regexp_count(whole, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
            (F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        )

    return let(split_words(text), body)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def features(s: Column) -> dict[str, Column]:
    words, chars = F.greatest(s["n_words"], F.lit(1)), F.greatest(s["word_chars"], F.lit(1))
    return {
        "symbol_rate": s["n_symbols"] / words,
        "bang_rate": s["n_bangs"] / words,
        "upper_rate": s["n_upper"] / chars,
        "repeat_rate": s["n_repeat_words"] / words,
        "dup_line_rate": s["n_dup_lines"] / s["n_lines"],
        "word_length": s["word_chars"] / words,
        "n_words": s["n_words"].cast("double"),
    }


@dataclass(frozen=True)
class Test:
    """``feature >= limit``, or ``feature < limit``."""

    feature: str
    above: bool
    limit: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        column = x[:, FEATURES.index(self.feature)]
        return column >= self.limit if self.above else column < self.limit

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.limit if self.above else values[self.feature] < self.limit


Rule = tuple[Test, ...]


def _hits(rule: Rule, x: np.ndarray) -> np.ndarray:
    held = np.ones(len(x), bool)
    for test in rule:
        held &= test.holds(x)
    return held


def _grow(x: np.ndarray, bad: np.ndarray, limits: list[Test], longest: int) -> Rule:
    """Add the test with the largest information gain until no clean row is covered."""
    rule: Rule = ()
    while len(rule) < longest:
        held = _hits(rule, x)
        p, n = (held & bad).sum(), (held & ~bad).sum()
        if not n or not p:
            break
        best, gain = None, 1e-9
        for test in limits:
            now = held & test.holds(x)
            q, m = (now & bad).sum(), (now & ~bad).sum()
            if q and (g := q * (np.log2(q / (q + m)) - np.log2(p / (p + n)))) > gain:
                best, gain = test, g
        if best is None:
            break
        rule += (best,)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest of the best beginnings of a rule on held-out rows."""

    def worth(r: Rule) -> float:
        held = _hits(r, x)
        p, n = (held & bad).sum(), (held & ~bad).sum()
        return (p - n) / max(p + n, 1)

    return max((rule[: n + 1] for n in range(len(rule))), key=worth, default=())


def covering(x: np.ndarray, bad: np.ndarray, held_out: np.ndarray, precision: float = 0.97, longest: int = 3, most: int = 16) -> list[Rule]:
    """Ordered rules for low-quality rows, each learned on rows that the earlier ones leave."""
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most:
        fit, test = left & ~held_out, left & held_out
        if (bad & fit).sum() < 3:
            break
        limits = []
        for n, name in enumerate(FEATURES):
            column = np.unique(x[fit, n])
            middles = (column[1:] + column[:-1]) / 2
            picked = np.unique(middles[np.linspace(0, len(middles) - 1, 48).astype(int)]) if len(middles) else middles
            limits += [Test(name, above, float(v)) for v in picked for above in (True, False)]
        rule = _prune(_grow(x[fit], bad[fit], limits, longest), x[test], bad[test])
        held = _hits(rule, x) & left
        if not rule or (held & bad).sum() < max(3.0, precision * held.sum()):
            break
        rules.append(rule)
        left &= ~held
    return rules


def learn_rules(docs: DataFrame, labels: DataFrame, bound: int = BOUND, text: str = "text") -> list[Rule]:
    """A decision list from at most ``bound`` labelled documents, chosen by a hash of their id."""
    sample = (
        labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    # Written, or the filter below is pushed under the join and counts the words of every text.
    known = stage(docs.select("doc_id", F.col(text).alias("text")).join(F.broadcast(sample), "doc_id"), "labelled")
    stats = known.select("doc_id", "quality", statistics(F.col("text")).alias("s")).where(~base_failed(F.col("s")))
    values = features(F.col("s"))
    rows = (
        stats.select("doc_id", "quality", *[values[f].alias(f) for f in FEATURES])
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), *[F.min(f).alias(f) for f in FEATURES])
        .withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)))
        .orderBy("doc_id")
        .collect()  # at most ``bound`` rows of numbers
    )
    if not rows:
        return []
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    return covering(x, np.array([r["quality"] == 0 for r in rows]), np.array([r["part"] == 0 for r in rows]))


def verdict(s: Column, rules: list[Rule]) -> Column:
    """False where the base rule fails or a learned rule holds, tried in order."""
    values = features(s)
    kept = F.when(base_failed(s), F.lit(False))
    for rule in rules:
        whole = rule[0].column(values)
        for test in rule[1:]:
            whole &= test.column(values)
        kept = kept.when(whole, F.lit(False))
    return kept.otherwise(F.lit(True))


def judged(docs: DataFrame, rules: list[Rule], name: str = "quality_stats", text: str = "text") -> DataFrame:
    """``docs`` with its statistics, ``base_failed`` and ``kept`` in one struct column."""
    # One expression, so that a filter on the verdict counts every text once.
    whole = let(statistics(F.col(text)), lambda s: s.withField("base_failed", base_failed(s)).withField("kept", verdict(s, rules)))
    return docs.withColumn(name, whole)
