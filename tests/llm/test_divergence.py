"""Divergence of sources against SQL, exact fractions and plain loops."""

from __future__ import annotations

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle_check import differences
from ratingloom.llm import divergence
from ratingloom.llm.divergence import audit, divergence_of, gallop, price, price_column
from ratingloom.llm.q_divergence import QUERIES, SQL
from ratingloom.staging import Workspace


def brute(rows, least: int = 30, most: int = 50) -> list[tuple]:
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for t, a, b in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(w for d in mine for w in set(d[2]))
        kept = sorted(w for w, n in seen.items() if n >= least)
        by = {s: Counter(w for d in mine if d[1] == s for w in d[2] if seen[w] >= least) for s in {d[1] for d in mine}}
        whole = sum(by.values(), Counter())

        def shares(c):
            total = sum(c.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // total for w in kept}

        p, q = {s: shares(c) for s, c in by.items()}, shares(whole)
        for s in by:
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in by if o != s]
            terms = [(w, p[s][w] - q[w]) for w in kept if by[s][w] and p[s][w] > q[w]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, most)):
                ordered = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, item, v, n + 1) for n, (item, v) in enumerate(ordered)]
    return sorted(out)


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


ids = st.lists(st.integers(0, 400), unique=True, max_size=120).map(sorted)


@settings(max_examples=150, deadline=None)
@given(ids, ids, st.integers(1, 9))
def test_gallop_finds_all_meetings(one, two, stride):
    kept, divergence.STRIDE = divergence.STRIDE, stride
    try:
        i, j = gallop(np.array(one, np.int64), np.array(two, np.int64))
    finally:
        divergence.STRIDE = kept
    assert [one[n] for n in i] == [two[n] for n in j] == sorted(set(one) & set(two))


@settings(max_examples=100, deadline=None)
@given(ids, ids, st.integers(0, 10**6))
def test_both_one_sided_and_absent_terms(one, two, extra):
    c, d = ({w: (w * k) % 17 + 1 for w in x} for x, k in ((one, 7), (two, 11)))
    v = 420
    totals = (sum(c.values()) + 5 * v + extra, sum(d.values()) + 5 * v)

    def share(n, total):
        return 1 + 10**9 * (n + 5) // total

    want = sum(abs(share(c.get(w, 0), totals[0]) - share(d.get(w, 0), totals[1])) for w in range(v))
    sides = [(np.array(list(x), np.int64), np.array(list(x.values()), np.int64)) for x in (c, d)]
    value, met = divergence_of(*sides, totals)
    assert value + (v - met) * abs(share(0, totals[0]) - share(0, totals[1])) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**14), min_size=1, max_size=5), st.integers(0, 8 * 10**15))
def test_prices_of_large_counts_are_exact(counts, more):
    total = sum(counts) + 5 * len(counts) + more
    total = min(total, 9 * 10**15)
    assert price(np.array(counts, np.int64), total).tolist() == [1 + 10**9 * (n + 5) // total for n in counts]


def test_price_column_equals_fractions(spark):
    rows = [(0, 5), (0, 9 * 10**15), (10**14, 9 * 10**15), (8 * 10**15, 9 * 10**15), (123456789, 987654321)]
    made = spark.createDataFrame(rows, "n long, total long").select("n", "total", price_column(F.col("n"), F.col("total")).alias("p"))
    assert all(r["p"] == 1 + 10**9 * (r["n"] + 5) // r["total"] for r in made.collect())


def test_edge_rows_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    rows = [(t, lang, s) for t in ("Alpha beta, GAMMA!", "été straße ÉTÉ", "beta 日本 a1b", None, "", "... 123") for lang in ("x", None, "y") for s in ("s1", "s2", None)]
    rows += [("alpha " * 5000 + "ω" * 3000, "x", "s3"), ("delta epsilon zeta", "x", "S"), ("only here", "z", "lone"), (None, "w", "p"), ("", "w", "q")]
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows * 2], "text string, lang string, source string, term string, n int")
    for least in (1, 3, 4):
        assert got(audit(docs, Workspace(spark), least)) == brute(rows * 2, least)


def test_repeated_rows_and_ties(spark):
    rows = [(f"w{chr(97 + n % 26)} common", "x", f"s{n % 3}") for n in range(200)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    found = got(audit(docs, Workspace(spark), 5, 3))
    assert found == brute(rows, 5, 3)
    assert max(r[5] for r in found if r[2] == "term") == 3


def test_empty_table(spark):
    found = audit(spark.createDataFrame([], "text string, lang string, source string, v int"), Workspace(spark))
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert found.count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_whole_table_equals_sql(spark, name):
    rows, different = differences(spark, "/root/testdata/sf0.01", QUERIES[name], SQL[name])
    assert rows > 4 * 20 * 19
    assert different == []


def test_ordered_ranks_have_no_gap(spark):
    rows = sorted((r["lang"], r["source"], r["part"], r["rank"]) for r in QUERIES["op12_divergence"](spark, "/root/testdata/sf0.001").collect())
    for _, found in groupby(rows, key=lambda r: r[:3]):
        ranks = [r[3] for r in found]
        assert ranks == list(range(1, len(ranks) + 1))
