"""Fill-in-middle against Python strings, on whole tables against SQL, and on edge rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from oracle_check import differences
from ratingloom.llm.middle import Recipe, UnitIndex, fill_in_middle, restore
from ratingloom.llm.q_middle import QUERIES, SQL, digests

SF_DIR = "/root/testdata/sf0.001"


def brute(doc_id: int | None, text: str | None) -> tuple:
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        form, out = "plain", text
    elif h[3] % 100 < 20:
        form, out = "spm", f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    else:
        form, out = "psm", f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"
    cut = form != "plain"
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in (out, text)]
    return doc_id, n, form, a if cut else None, b - a if cut else None, *sha


def by_text(rows) -> list:
    return sorted(map(str, map(tuple, rows)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=12))
def test_rank_and_select_find_every_code_point(texts):
    parts = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    index = UnitIndex(np.frombuffer(b"".join(parts), np.uint8))
    rank = index.rank(bounds)
    assert np.diff(rank).tolist() == [len(t) for t in texts]
    for r, text in enumerate(texts):
        ends = (bounds[r] + np.cumsum([len(c.encode()) for c in text])).astype(np.int64)
        assert index.select(rank[r] + np.arange(1, len(text) + 1)).tolist() == ends.tolist()


def test_edge_rows_equal_python(spark):
    texts = [None, "", "a", "é", "\U0001f600", "a<P>b", "<M>", "<P", "<<S", "ends with <", "\x00\x7f", "é" * 9]
    texts += ["x" * 300_000, "日本" * 100_000, " \n\t", "<S>" * 2, "m>"]
    rows = [(n, t, "x") for n, t in enumerate(texts * 25)] + [(None, "null id", None), (3, "same id", "z"), (3, "same id", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    got = by_text(digests(docs).collect())
    assert got == by_text(brute(i, t) for i, t, _ in rows)
    assert {r[2] for r in (brute(i, t) for i, t, _ in rows)} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, form string, n int")
    found = fill_in_middle(docs)
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert found.count() == 0


def test_another_recipe_restores_its_texts(spark):
    recipe = Recipe(seed=7, plain_percent=0, suffix_first_percent=50, prefix="[a]", suffix="[b.*]", middle="(c)")
    docs = spark.createDataFrame([(f"k{n}", f"wört {n} [b] <P> " * (n % 5 + 1)) for n in range(60)], "name string, body string")
    made = fill_in_middle(docs, recipe, key="name", text="body")
    rows = made.join(docs, "name").select("form", (restore("output", "form", recipe) == F.col("body")).alias("same")).collect()
    assert {r["form"] for r in rows} == {"psm", "spm"}
    assert len(rows) == 60 and all(r["same"] for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_whole_table_equals_sql(spark, name):
    rows, different = differences(spark, SF_DIR, QUERIES[name], SQL[name])
    assert rows >= 200
    assert different == []
