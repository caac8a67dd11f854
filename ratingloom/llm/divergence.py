"""Divergence of the sources of a language: how far apart the term shares of every two sources are, in exact integers.

Terms are counted per batch of texts before any shuffle. The terms kept by a language get dense numbers in the order
of language and term; a source becomes sorted lists of (term number, count), one per block of ``BLOCK`` numbers. For
every unordered pair of sources and block one task gets the two lists, searches the shorter in the longer, and prices
terms of both, of one side, and of neither. Sums of blocks are added up, and each pair is written both ways. A list
has at most ``BLOCK`` entries, however many rows a source has.

Null text, language and source are empty strings; groups without terms count; repeated rows count again; texts of any
length are read whole; an empty table gives an empty table. Ties rank by item in UTF-8 order. Only the text, language
and source are read, so names of other columns cannot clash. Totals must stay below 9 * 10^15.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.llm.blocks import slices
from ratingloom.llm.tables import map_batches, text_bytes, tidy
from ratingloom.staging import Workspace

PART = 1 << 22  # bytes of text counted together
BLOCK = 1 << 16  # term numbers whose counts lie in one list
STRIDE = 1 << 10  # entries of the shorter list between two leaps through the longer
SMOOTH, UNIT, STEP = 5, 1_000_000_000, 1000  # UNIT = STEP ** 3

_TERM = np.zeros(256, bool)
_TERM[0x80:] = True
_TERM[65:91] = _TERM[97:123] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

GROUP = ["lang", "source"]


def _counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of every term of every language and source in a batch."""
    data, bounds = text_bytes(batch.column(0))
    is_term = _TERM[data]
    first = is_term.copy()
    first[1:] &= ~is_term[:-1]
    edges = bounds[:-1][np.diff(bounds) > 0]
    first[edges] = is_term[edges]
    starts = np.flatnonzero(first)
    row = np.searchsorted(bounds, starts, "right") - 1
    # The letters of all terms end to end are a string column once each knows where it starts.
    offsets = np.append((np.cumsum(is_term) - is_term)[starts], np.count_nonzero(is_term)).astype(np.int32)
    letters = _LOWER[data[is_term]]
    terms = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(letters)).dictionary_encode()
    term, n_terms = terms.indices.to_numpy().astype(np.int64), len(terms.dictionary)
    langs, sources = (batch.column(c).dictionary_encode() for c in (1, 2))
    group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
    key, where, count = np.unique(row * n_terms + term, return_index=True, return_counts=True)
    pair, back = np.unique(group[row[where]] * n_terms + term[where], return_inverse=True)
    n = np.zeros(len(pair), np.int64)
    np.add.at(n, back, count)
    return pa.RecordBatch.from_pydict(
        {
            "lang": langs.dictionary.take(pa.array(pair // n_terms // len(sources.dictionary) if n_terms else pair)),
            "source": sources.dictionary.take(pa.array(pair // n_terms % len(sources.dictionary) if n_terms else pair)),
            "term": terms.dictionary.take(pa.array(pair % n_terms if n_terms else pair)),
            "n": pa.array(n),
            "docs": pa.array(np.bincount(back, minlength=len(pair))),
        }
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of all texts; ``docs`` has ``text, lang, source`` without nulls."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a, b in slices(text_bytes(batch.column(0))[1], PART):
            yield _counts(batch.slice(a, b - a))
        tidy()

    rows = docs.select("text", *GROUP)
    found = map_batches(rows, count, "lang string, source string, term string, n long, docs long")
    return found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price_column(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + SMOOTH) / total), divided digit group by digit group so that no step overflows."""
    price, rest = F.lit(0).cast("long"), count + SMOOTH
    for _ in range(3):
        price = price * STEP + F.call_function("div", rest * STEP, total)
        rest = (rest * STEP) % total
    return price + 1


def price(count: np.ndarray, total: int) -> np.ndarray:
    """The same of an array."""
    out, rest = np.zeros(len(count), np.int64), np.asarray(count, np.int64) + SMOOTH
    for _ in range(3):
        out = out * STEP + rest * STEP // total
        rest = rest * STEP % total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the entries of two sorted lists meet: places in each.

    Every stretch of the shorter list leaps to its own stretch of the longer, in doubling strides, and is searched there.
    """
    mine, other, low = [], [], 0
    for a in range(0, len(short), STRIDE):
        part = short[a : a + STRIDE]
        step = STRIDE
        while low + step < len(long) and long[low + step] <= part[-1]:
            step *= 2
        high = min(low + step + 1, len(long))
        at = low + np.searchsorted(long[low:high], part)
        hit = at < len(long)
        hit[hit] = long[at[hit]] == part[hit]
        mine.append(a + np.flatnonzero(hit))
        other.append(at[hit])
        low = int(at[-1]) if len(at) else low
    none = [np.zeros(0, np.int64)]
    return np.concatenate(mine or none), np.concatenate(other or none)


def divergence_of(
    left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], totals: tuple[int, int]
) -> tuple[int, int]:
    """Sum of price differences over the terms of either list, and how many terms those are."""
    (left_ids, left_n), (right_ids, right_n) = left, right
    p, q = price(left_n, totals[0]), price(right_n, totals[1])
    no_p, no_q = (int(price(np.zeros(1), t)[0]) for t in totals)
    if len(left_ids) <= len(right_ids):
        i, j = gallop(left_ids, right_ids)
    else:
        j, i = gallop(right_ids, left_ids)
    both = int(np.abs(p[i] - q[j]).sum())
    # One-sided terms: all of a side less those that met.
    only_left = int(np.abs(p - no_q).sum()) - int(np.abs(p[i] - no_q).sum())
    only_right = int(np.abs(q - no_p).sum()) - int(np.abs(q[j] - no_p).sum())
    return both + only_left + only_right, len(p) + len(q) - len(i)


def _numbered(kept: DataFrame, space: Workspace) -> DataFrame:
    """``kept`` with ``term_id``: 0, 1, 2, … in the order of language and term, by a range shuffle and sums of its parts."""
    parts = max(1, kept.count() // BLOCK)
    placed = (
        kept.repartitionByRange(parts, "lang", "term")
        .sortWithinPartitions("lang", "term")
        .withColumn("place", F.monotonically_increasing_id())
        .select("*", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND((1 << 33) - 1).alias("at"))
    )
    placed = space.stage(placed, "placed")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part of BLOCK terms
    sizes = placed.groupBy("part").agg(F.count("*").alias("size"))
    starts = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return placed.join(starts, "part").select("lang", "term", "total", (F.col("start") + F.col("at")).alias("term_id"))


def audit(docs: DataFrame, space: Workspace, least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to all other sources, and terms above their language's share."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)])
    groups = space.stage(docs.select(*GROUP).distinct(), "groups")
    counts = space.stage(term_counts(docs), "counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = space.stage(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    numbered = space.stage(_numbered(kept, space), "numbered")
    langs = numbered.groupBy("lang").agg(F.sum("total").alias("n"), F.count("*").alias("v"))
    langs = langs.select("lang", "v", (F.col("n") + SMOOTH * F.col("v")).alias("lang_total"))
    entries = space.stage(
        counts.drop("docs").join(numbered, ["lang", "term"]).select(*GROUP, "term", "term_id", "n", "total"), "entries"
    )
    sums = groups.join(entries.groupBy(*GROUP).agg(F.sum("n").alias("own")), GROUP, "left").join(langs, "lang", "left")
    sums = space.stage(
        sums.select(
            *GROUP,
            F.coalesce("v", F.lit(0)).alias("v"),
            "lang_total",
            (F.coalesce("own", F.lit(0)) + SMOOTH * F.coalesce("v", F.lit(0))).alias("total"),
        ),
        "sums",
    )
    return _ranked(pair_values(entries, sums, space), "pair").unionByName(_terms(entries, sums, most_terms))


def pair_values(entries: DataFrame, sums: DataFrame, space: Workspace) -> DataFrame:
    """``lang, source, item, value`` for every ordered pair of sources of a language; each is worked out once."""
    one = sums.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "v")
    two = sums.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = space.stage(one.join(two, "lang").where(F.col("a") < F.col("b")), "pairs")
    lists = entries.groupBy(*GROUP, F.shiftright("term_id", BLOCK.bit_length() - 1).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("term_id", "n"))).alias("list")
    )
    lists = space.stage(
        lists.select(*GROUP, "block", F.col("list.term_id").alias("ids"), F.col("list.n").alias("counts")), "lists"
    )

    def side(name: str) -> DataFrame:
        named = lists.withColumnRenamed("source", name).join(pairs, ["lang", name])
        # Aliases give the two sides columns of their own.
        return named.select(*[F.col(c).alias(c) for c in ("lang", "a", "b", "block", "total_a", "total_b", "ids", "counts")])

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        some = left if left.num_rows else right
        lang, a, b, _, total_a, total_b = (some.column(c)[0].as_py() for c in range(6))
        value, n = divergence_of(*map(_list, (left, right)), (total_a, total_b))
        return pa.table({"lang": [lang], "a": [a], "b": [b], "value": pa.array([value]), "met": pa.array([n])})

    key = ["lang", "a", "b", "block"]
    met = side("a").groupBy(*key).cogroup(side("b").groupBy(*key))
    met = met.applyInArrow(merge, "lang string, a string, b string, value long, met long")
    met = met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    neither = F.abs(price_column(F.lit(0), F.col("total_a")) - price_column(F.lit(0), F.col("total_b")))
    absent = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("met", F.lit(0))) * neither).otherwise(0)
    done = space.stage(
        pairs.join(met, ["lang", "a", "b"], "left").select(
            "lang", "a", "b", (F.coalesce("value", F.lit(0)) + absent).alias("value")
        ),
        "pair-values",
    )
    there = done.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    return there.unionByName(done.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def _list(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    if not side.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, counts = (side.column(c).combine_chunks().flatten().to_numpy() for c in ("ids", "counts"))
    return ids, counts


def _terms(entries: DataFrame, sums: DataFrame, most: int) -> DataFrame:
    over = price_column(F.col("n"), F.col("group_total")) - price_column(F.col("total"), F.col("lang_total"))
    priced = entries.join(sums.select(*GROUP, F.col("total").alias("group_total"), "lang_total"), GROUP)
    priced = priced.select(*GROUP, F.col("term").alias("item"), over.alias("value")).where(F.col("value") > 0)
    return _ranked(priced, "term").where(F.col("rank") <= most)


def _ranked(values: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    return values.select(*GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
