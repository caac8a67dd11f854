"""Nearest neighbours against all pairs."""

from __future__ import annotations

import numpy as np

from ratingloom.llm.neighbours import build, search, usable
from ratingloom.staging import Workspace

WIDTH, COPIES = 16, 1_100


def recall(spark, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int = 20) -> np.ndarray:
    """Per asked row the share of ``k`` results whose true score is not below the true k-th score."""
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = build(table, Workspace(spark), wanted=k)
    wanted = spark.createDataFrame([(int(ids[r]),) for r in asked], "query_id long")
    queries = usable(table).withColumnRenamed("vec_id", "query_id").join(wanted, "query_id")
    found: dict[int, list[int]] = {}
    for row in search(index, queries, k=k).collect():
        found.setdefault(row["query_id"], []).append(row["vec_id"])
    place = {int(i): n for n, i in enumerate(ids)}
    exact = vectors.astype(np.float64)
    out = []
    for r in asked:
        score = exact @ exact[r]
        score[r] = -np.inf
        least = np.sort(score)[-k] - 1e-9
        mine = found.get(int(ids[r]), [])
        assert len(set(mine)) == len(mine) <= k and int(ids[r]) not in mine
        out.append(sum(score[place[v]] >= least for v in mine) / k)
    return np.array(out)


def test_copies_and_separate_groups_find_their_neighbours(spark):
    """150 groups without links between them, one vector held by 1,100 rows; the last copies find the other copies."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(150, WIDTH))
    centres *= 5 / np.linalg.norm(centres, axis=1, keepdims=True)
    vectors = (np.repeat(centres, 45, axis=0) + 0.1 * draw.normal(size=(150 * 45, WIDTH))).astype(np.float32)
    copied = vectors[77 * 45]
    vectors = np.concatenate([vectors, np.repeat(copied[None], COPIES, axis=0)])
    ids = np.arange(len(vectors)) + 5
    last, others = np.arange(len(vectors) - 40, len(vectors)), np.arange(0, 150 * 45, 45)
    shares = recall(spark, vectors, ids, np.concatenate([last, others]))
    assert shares[: len(last)].mean() >= 0.9
    assert shares[len(last) :].mean() >= 0.9
