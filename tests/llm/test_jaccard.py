"""Components of similar documents against brute force and SQL; groups of classes against plain loops."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from oracle_check import differences
from ratingloom.llm import jaccard
from ratingloom.llm.jaccard import Runs, similar_documents
from ratingloom.llm.q_jaccard import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"


def brute(rows, num=3, den=4) -> list[tuple]:
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    low = {}
    for x, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            low[find(x)] = min(low.get(find(x), doc_id), doc_id)
    return sorted(((i, len(s), low.get(find(x)) if s else i) for x, ((i, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def families():
    rng = random.Random(12)
    vocabulary = [f"w{n}" for n in range(3000)]
    texts = []
    for size, n, edits in ((60, 90, 6), (60, 40, 3), (200, 50, 12), (12, 30, 1), (30, 8, 2)):
        texts += family(rng, rng.choices(vocabulary, k=size), n, edits)
    # Chains: each is near the one before, far from the first.
    chain = rng.choices(vocabulary, k=80)
    for step in range(25):
        chain[3 * step % 80] = f"c{step}"
        texts.append(" ".join(chain))
    passage = " ".join(rng.choices(vocabulary, k=25))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=rng.choice((8, 9, 60)))) for _ in range(60)]
    texts += [" ".join(rng.choices(vocabulary, k=40)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small, block", [(24, 2048), (3, 4)])
def test_families_chains_and_shared_passages(spark, families, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "HELD", 500 * block)
    docs = spark.createDataFrame(families, "doc_id long, text string")
    assert got(similar_documents(docs)) == brute(families)


def test_edge_rows(spark):
    texts = [None, "", " \n", "one", "ONE", "one two three", "One  Two\tThree", "a b c d e", "a b c d e f", "é É ß", "\x00 x"]
    texts += ["same words " * 20_000, "same words " * 20_001, "x" * 300_000, "x" * 300_000 + " y"]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "one"), (None, None), (3, "a b c d e"), (5, "one two three"), (5, "one two three")]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, ref int, grp string")
    assert got(similar_documents(docs)) == brute(rows)


def test_empty_table(spark):
    assert similar_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_whole_table_equals_sql(spark, name):
    rows, different = differences(spark, SF_DIR, QUERIES[name], SQL[name])
    assert rows >= 200 and different == []


rows_of_keys = st.lists(st.tuples(st.integers(0, 12), st.integers(0, 9)), max_size=80)


@settings(max_examples=200, deadline=None)
@given(rows_of_keys, st.integers(1, 9), st.sampled_from([2, 3, 1 << 16]))
def test_groups_are_the_classes_of_each_key(rows, step, long):
    rows.sort()
    kept, jaccard.LONG = jaccard.LONG, long
    try:
        runs, found = Runs(), []
        for n in range(0, len(rows), step):
            key, ref = np.array(rows[n : n + step], np.int64).reshape(-1, 2).T.copy()
            found += list(runs.add(key, ref))
        found += list(runs.end())
    finally:
        jaccard.LONG = kept
    members: dict[int, set[int]] = {}
    for batch in found:
        assert isinstance(batch, pa.RecordBatch)
        for grp, ref in zip(*(batch.column(c).to_pylist() for c in range(2)), strict=True):
            members.setdefault(grp, set()).add(ref)
    by_key: dict[int, set[int]] = {}
    for key, ref in rows:
        by_key.setdefault(key, set()).add(ref)
    assert set(map(frozenset, members.values())) == {frozenset(v) for v in by_key.values() if len(v) > 1}


def test_rows_do_not_depend_on_the_number_of_partitions(spark, families):
    docs = spark.createDataFrame(families, "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    stage = jaccard.Workspace.stage

    def counted(self, df, label):
        out = stage(self, df, label)
        seen[-1][label] = seen[-1].get(label, 0) + out.count()
        return out

    try:
        jaccard.Workspace.stage = counted
        for n in ("2", "23"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append({})
            similar_documents(docs).count()
    finally:
        jaccard.Workspace.stage = stage
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {k: seen[0][k] for k in ("groups", "members", "near", "open")} == {k: seen[1][k] for k in ("groups", "members", "near", "open")}
