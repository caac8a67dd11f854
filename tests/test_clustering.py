from __future__ import annotations

import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.linalg import Vectors

import __spark_entry__ as entry
from ratingloom.operators import clustering
from ratingloom.operators.clustering import kmeans_item_clusters
from ratingloom.operators.items import item_facts, leader_weights, with_facts
from ratingloom.operators.split import hash_split
from ratingloom.plans.recommenders import cluster_cf, group_cf, item_clusters
from ratingloom.schema import RATINGS
from ratingloom.staging import Workspace


def vectors_of(weights):
    vectors = defaultdict(dict)
    for r in weights.collect():
        vectors[r["leader"]][r["userId"]] = r["weight"]
    return vectors


def cost_and_centres(vectors, labels):
    size = Counter(labels.values())
    centres = defaultdict(lambda: defaultdict(float))
    for item, v in vectors.items():
        for u, w in v.items():
            centres[labels[item]][u] += w / size[labels[item]]

    def distance(v, c):
        return sum((v.get(u, 0.0) - c.get(u, 0.0)) ** 2 for u in set(v) | set(c))

    return sum(distance(v, centres[labels[i]]) for i, v in vectors.items()), centres, distance


@pytest.fixture(scope="module")
def split(spark):
    return hash_split(entry.order_ratings(spark, "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def clustered(split):
    weights = leader_weights(with_facts(split[0], item_facts(split[0])))
    labels = {r["leader"]: r["cluster"] for r in kmeans_item_clusters(weights, 10).collect()}
    return vectors_of(weights), labels


def test_every_item_is_with_its_nearest_centre(clustered):
    vectors, labels = clustered
    assert set(labels) == set(vectors) and set(labels.values()) <= set(range(10))
    _, centres, distance = cost_and_centres(vectors, labels)
    for item, v in vectors.items():
        near = min(distance(v, c) for c in centres.values())
        assert distance(v, centres[labels[item]]) == pytest.approx(near, abs=1e-6)


def test_cost_is_as_good_as_the_library_one(spark, clustered):
    vectors, labels = clustered
    size = max(u for v in vectors.values() for u in v) + 1
    rows = [(i, Vectors.sparse(size, sorted(v.items()))) for i, v in vectors.items()]
    df = spark.createDataFrame(rows, ["leader", "features"])
    theirs = {r["leader"]: r["prediction"] for r in KMeans(k=10, seed=42).fit(df).transform(df).collect()}
    assert cost_and_centres(vectors, labels)[0] <= 1.05 * cost_and_centres(vectors, theirs)[0]


def test_parallel_start_costs_no_more_than_the_library(spark, split):
    weights = leader_weights(with_facts(split[0], item_facts(split[0])))
    vectors = vectors_of(weights)
    labels = {r["leader"]: r["cluster"] for r in kmeans_item_clusters(weights, 10, start="parallel").collect()}
    size = max(u for v in vectors.values() for u in v) + 1
    df = spark.createDataFrame([(i, Vectors.sparse(size, sorted(v.items()))) for i, v in vectors.items()], ["leader", "features"])
    theirs = {r["leader"]: r["prediction"] for r in KMeans(k=10, seed=42).fit(df).transform(df).collect()}
    assert cost_and_centres(vectors, labels)[0] <= 1.02 * cost_and_centres(vectors, theirs)[0]


def test_parallel_start_separates_more_far_groups(spark):
    # Eight groups without a common user; the first holds 120 of 141 items. Items of a group differ in one rating.
    sizes = [120, 3, 3, 3, 3, 3, 3, 3]
    items = [(group, n) for group, size in enumerate(sizes) for n in range(size)]
    rows = [
        (group * 4 + u, 1000 * group + n, 5.0 if u < 3 else 0.5 + 0.001 * n) for group, n in items for u in range(4)
    ]
    ratings = spark.createDataFrame(rows, RATINGS)

    def alone(start):
        """Groups that share no cluster with another one."""
        found = item_clusters(ratings, k=8, max_iter=1, start=start).collect()
        assert len(found) == len(items)
        groups = defaultdict(set)
        for r in found:
            groups[r["cluster"]].add(r["itemId"] // 1000)
        shared = {g for members in groups.values() if len(members) > 1 for g in members}
        return len(sizes) - len(shared)

    # Draws of one doubling do not see each other, so a group may be missed, but far fewer than by one draw of items.
    assert alone("parallel") >= 6 > alone("weighted")


@pytest.mark.parametrize("start", ["weighted", "parallel"])
def test_fewer_distinct_vectors_than_clusters(spark, start):
    rows = [(u, i, 3.0) for i in range(6) for u in ([0, 1] if i % 2 else [2, 3])]
    found = item_clusters(spark.createDataFrame(rows, RATINGS), k=5, start=start).collect()
    assert len(found) == 6
    assert len({r["cluster"] for r in found}) == 2
    assert len({r["cluster"] for r in found if r["itemId"] % 2}) == 1


def test_cluster_predictions_are_group_predictions(split):
    train, test = split
    clusters = item_clusters(train, k=12, max_iter=3).withColumnRenamed("cluster", "grp")
    by_group = sorted(map(tuple, group_cf(train, test, clusters).collect()))
    by_cluster = sorted(map(tuple, cluster_cf(train, test, k=12, max_iter=3, heavy_items=10, block_items=8).collect()))
    assert [r[:3] for r in by_cluster] == [r[:3] for r in by_group]
    assert [r[3] for r in by_cluster] == pytest.approx([r[3] for r in by_group])


def test_a_round_reads_no_more_than_what_moved(spark, tmp_path, monkeypatch):
    draws = random.Random(7)
    rows = [(u, i, draws.randint(1, 10) / 2) for i in range(400) for u in draws.sample(range(150), 6)]
    ratings = spark.createDataFrame(rows, RATINGS)
    weights = leader_weights(with_facts(ratings, item_facts(ratings)))
    monkeypatch.setattr(clustering, "remove_path", lambda spark, path: None)
    space = Workspace(spark, str(tmp_path))
    found = kmeans_item_clusters(weights, 6, space=space).collect()
    assert len(found) == len({r["leader"] for r in found}) == 400
    written = [spark.read.parquet(str(path.parent)) for path in sorted(Path(space.root).rglob("_SUCCESS"))]
    by_user = [df.count() for df in written if "userId" in df.columns]
    assert len(by_user) > 3 and by_user[-1] < max(by_user) / 4


def test_moving_back_and_forth_leaves_no_products(spark):
    weights = spark.createDataFrame([(1, 1, 0.6), (1, 2, 0.8), (2, 1, 1.0), (3, 2, 1.0)], "leader long, userId long, weight double")
    state = spark.createDataFrame([(i, 1, None, i % 2, True) for i in (1, 2, 3)], "leader long, copies int, before int, cluster int, moved boolean")
    dots = clustering.cluster_dots(weights, clustering.user_sums(weights, clustering.moves(state)), None)
    there = {(r["leader"], r["cluster"]): r["dot"] for r in dots.collect()}
    assert there == {(1, 1): pytest.approx(1.8), (1, 0): pytest.approx(0.6), (2, 1): pytest.approx(0.6), (2, 0): 1.0, (3, 1): pytest.approx(1.8)}
    back = state.selectExpr("leader", "copies", "cluster AS before", "1 - cluster AS cluster", "moved")
    again = clustering.cluster_dots(weights, clustering.user_sums(weights, clustering.moves(back)), dots)
    swapped = {(r["leader"], 1 - r["cluster"]): pytest.approx(r["dot"]) for r in again.collect()}
    assert swapped == there


def test_bad_cluster_counts(spark):
    with pytest.raises(ValueError):
        kmeans_item_clusters(spark.createDataFrame([], "leader long, userId long, weight double, n_raters long"), 0)
    some = spark.createDataFrame([(1, 1, 1.0, 1, 1)], "leader long, userId long, weight double, n_raters long, copies long")
    with pytest.raises(ValueError):
        kmeans_item_clusters(some, 1, start="unknown")
    with pytest.raises(ValueError):
        kmeans_item_clusters(some, 20_000, start="parallel")
