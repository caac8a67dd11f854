"""op5's operator: a text that joins a component by asking is compared with those that asked with it."""

from __future__ import annotations

import random

import numpy as np
import pytest

from ratingloom.llm import jaccard

PREFIX = [f"c{k}" for k in range(20)]


def documents(seed, families):
    rng, docs = random.Random(seed), []
    for _ in range(families):
        base = PREFIX[: rng.randrange(12, 21)] + [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 9))]
        docs.append(base)
        for _ in range(rng.randrange(1, 9)):
            text = list(rng.choice([base, docs[-1]]))
            for _ in range(rng.randrange(3)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9999)}"
            docs.append(text + [f"y{rng.randrange(9999)}" for _ in range(rng.randrange(4))])
    rng.shuffle(docs)
    return docs


def smallest_reached(docs):
    sets = [{tuple(t[p : p + 5]) for p in range(len(t) - 4)} for t in docs]
    low = list(range(len(docs)))

    def find(k):
        while low[k] != k:
            k = low[k]
        return k

    for x, one in enumerate(sets):
        for y in range(x):
            common = len(one & sets[y])
            if 100 * common >= 75 * (len(one) + len(sets[y]) - common):
                a, b = find(x), find(y)
                low[max(a, b)] = min(a, b)
    return {k: find(k) for k in range(len(docs))}


def test_no_link_is_left_out(spark):
    docs = documents(5, 120)
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    want = smallest_reached(docs)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(table).collect()}
    assert found == want


@pytest.mark.parametrize("small", [24, 1])
def test_one_apart_meets_one_that_joined(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    sketch = jaccard.sketch(np.arange(20, dtype=np.uint64))
    classes = spark.createDataFrame([(ref, 20, sketch) for ref in (4, 7, 9)], "ref long, size long, sketch binary")
    # Of the members that asked component 1, 4 and 9 have joined it and 7 is still apart.
    asked = [(5, 4, 1, 1, 4), (5, 7, 1, 7, 4), (5, 9, 1, 1, 4)]
    members = spark.createDataFrame(asked, "grp long, ref long, inside long, root long, n long")
    found = jaccard._remaining(members, classes, 3, 4).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [(4, 7), (7, 9)]
