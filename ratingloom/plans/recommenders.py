"""Recommenders: from a train and a test table to scored test rows.

``train`` and ``test`` hold ``userId, itemId, rating`` with one row per user and item each. Each function returns
``userId, itemId, actual_rating, pred_rating`` for the test rows that have a similar rated item. Where a test pair is also
in ``train``, the rating there does not count for its own prediction. What a run writes lies in ``space``, whose owner
removes it; without one it lies in a folder of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.scores import default_cluster_count, distance_to_cosine
from ratingloom.operators.clustering import kmeans_item_clusters
from ratingloom.operators.items import item_facts, leader_weights, owned_ratings, with_facts
from ratingloom.operators.lsh import lsh_similarity_join
from ratingloom.operators.pairing import BLOCK_ITEMS
from ratingloom.operators.prediction import (
    HEAVY_ITEMS,
    all_neighbor_sums,
    neighbor_ratings,
    predict_ratings,
    targets_of,
    weighted_rating_sums,
)
from ratingloom.operators.similarity import symmetric_similarities
from ratingloom.staging import Workspace, stage


def _prepare(
    train: DataFrame, groups: DataFrame | None = None, space: Workspace | None = None
) -> tuple[DataFrame, DataFrame]:
    """Item facts and the train rows with them, written once because every later step reads them."""
    train = stage(train, "train", space)
    facts = stage(item_facts(train, groups), "facts", space)
    return facts, stage(with_facts(train, facts), "rated", space)


def group_cf(
    train: DataFrame,
    test: DataFrame,
    groups: DataFrame | None = None,
    heavy_items: int = HEAVY_ITEMS,
    block_items: int = BLOCK_ITEMS,
    space: Workspace | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Neighbours are all co-rated items of the same group: ``groups`` has ``itemId, grp``."""
    facts, rated = _prepare(train, groups, space)
    sums = all_neighbor_sums(
        targets_of(test, facts, rated), leader_weights(rated), owned_ratings(rated), heavy_items, block_items, space, plan
    )
    return predict_ratings(sums)


def exact_cf(
    train: DataFrame,
    test: DataFrame,
    heavy_items: int = HEAVY_ITEMS,
    block_items: int = BLOCK_ITEMS,
    space: Workspace | None = None,
    plan: str | None = None,
) -> DataFrame:
    """Neighbours are all co-rated items."""
    return group_cf(train, test, None, heavy_items, block_items, space, plan)


def item_clusters(
    train: DataFrame, k: int | None = None, seed: int = 42, max_iter: int = 20, start: str = "weighted"
) -> DataFrame:
    """``itemId, cluster`` by KMeans on the unit vectors of the items."""
    facts, rated = _prepare(train)
    clusters = kmeans_item_clusters(leader_weights(rated), k or cluster_count(facts), seed, max_iter, start=start)
    return facts.join(clusters, "leader").select("itemId", "cluster")


def cluster_count(facts: DataFrame) -> int:
    return facts.agg(default_cluster_count(F.count("*"))).first()[0]


def cluster_cf(
    train: DataFrame,
    test: DataFrame,
    k: int | None = None,
    seed: int = 42,
    max_iter: int = 20,
    heavy_items: int = HEAVY_ITEMS,
    block_items: int = BLOCK_ITEMS,
    space: Workspace | None = None,
) -> DataFrame:
    """Neighbours are the co-rated items of the same KMeans cluster."""
    facts, rated = _prepare(train, None, space)
    clusters = kmeans_item_clusters(leader_weights(rated), k or cluster_count(facts), seed, max_iter, space)
    # Copies have one vector and so one cluster: the leaders found without groups stay valid.
    groups = clusters.withColumnRenamed("cluster", "grp")
    facts, rated = facts.join(groups, "leader"), rated.join(groups, "leader")
    sums = all_neighbor_sums(
        targets_of(test, facts, rated), leader_weights(rated), owned_ratings(rated), heavy_items, block_items, space
    )
    return predict_ratings(sums)


def lsh_cf(
    train: DataFrame,
    test: DataFrame,
    bucket_length: float = 1.5,
    num_hash_tables: int = 8,
    max_distance: float = 1.0,
    seed: int = 42,
    block_items: int = BLOCK_ITEMS,
    space: Workspace | None = None,
) -> DataFrame:
    """Neighbours are the items closer than ``max_distance`` that the hashing finds."""
    facts, rated = _prepare(train, None, space)
    near = lsh_similarity_join(
        leader_weights(rated), max_distance, bucket_length, num_hash_tables, seed, block_items, block_items, unrelated=False
    )
    cosines = near.select("i", "j", distance_to_cosine(F.col("distance")).alias("cosine_sim"))
    similarities = symmetric_similarities(stage(cosines, "similarities", space))
    neighbors = neighbor_ratings(
        targets_of(test, facts, rated), similarities, owned_ratings(rated), sparse=True
    )
    return predict_ratings(weighted_rating_sums(neighbors))
