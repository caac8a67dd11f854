
from __future__ import annotations

import importlib
import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracles
from ratingloom.functions.scores import distance_to_cosine
from ratingloom.operators.clustering import assign_items, kmeans_item_clusters
from ratingloom.operators.dense import dense_lsh_hashes, unit_vectors
from ratingloom.operators.evaluation import evaluate_predictions
from ratingloom.operators.items import item_facts, leader_weights, with_facts
from ratingloom.operators.lsh import hashes_of_items, lsh_item_hashes, lsh_similarity_join
from ratingloom.operators.prediction import (
    neighbor_ratings,
    predict_ratings,
    scored_predictions,
    targets_of,
    weighted_rating_sums,
)
from ratingloom.operators.profile import dataset_stats, default_cluster_count, preview
from ratingloom.operators.similarity import (
    item_cosine,
    pair_cosines,
    symmetric_similarities,
    within_group_cosine,
    within_group_pairs,
)
from ratingloom.operators.split import hash_split, split_sizes
from ratingloom.operators.vectors import item_user_ratings, item_vectors, normalized_item_vectors, vector_entries
from ratingloom.plans.experiment import run_experiment
from ratingloom.plans.recommenders import cluster_cf, exact_cf, group_cf, item_clusters, lsh_cf
from ratingloom.sources.order_ratings import order_lines, order_ratings
from ratingloom.sources.ratings_files import (
    convert_all,
    convert_dat,
    csv_columns,
    load_ratings,
    quarantine_dat,
    read_ratings_csv,
)
from ratingloom.sources.summaries import read_summary
from ratingloom.staging import Workspace, fresh_path, stage

SPARSE, DENSE = "l_partkey", "l_suppkey"
GROUPS, SLICE = oracles.GROUPS, oracles.SLICE


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: F.round(name, 6) for name in names})


def _split(spark: SparkSession, sf: str, item: str = SPARSE) -> tuple[DataFrame, DataFrame]:
    return hash_split(order_ratings(spark, sf, item))


def _groups(train: DataFrame) -> DataFrame:
    return train.select("itemId").distinct().withColumn("grp", F.col("itemId") % GROUPS)


def _scored(df: DataFrame) -> DataFrame:
    return _rounded(df.select("userId", "itemId", "pred_rating", "actual_rating"), "pred_rating")


def _with_copies(spark: SparkSession, sf: str, item: str = SPARSE) -> tuple[DataFrame, DataFrame]:
    """The split, with a copy of every tenth item added to its training side."""
    train, test = _split(spark, sf, item)
    copied = train.where("itemId % 10 = 0").withColumn("itemId", F.col("itemId") + oracles.COPY)
    return train.unionByName(copied), test


def _overlap(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The split, with some training rows in the test side as well."""
    train, test = _split(spark, sf)
    return train, test.unionByName(train.where("(userId + itemId) % 7 = 0"))


def _leaders(train: DataFrame) -> tuple[DataFrame, DataFrame]:
    facts = stage(item_facts(train), "facts")
    return facts, leader_weights(with_facts(train, facts))


def _scan_ratings(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "ratings-csv")
    csv_columns(order_lines(spark, sf)).write.csv(path, header=True)
    return read_ratings_csv(spark, path)


def _convert_dat(spark: SparkSession, sf: str) -> DataFrame:
    raw, out = fresh_path(spark, "ratings-dat"), fresh_path(spark, "ratings-converted")
    order_lines(spark, sf).select(F.concat_ws("::", "userId", "itemId", "rating", "ts")).write.text(raw)
    convert_dat(spark, raw, out)
    return spark.read.csv(out, header=True, schema="userId bigint, movieId bigint, rating double, timestamp bigint")


def _named_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Raw files of a named dataset, converted and loaded by name."""
    base = Workspace(spark).path("data")
    order_lines(spark, sf).select(F.concat_ws("::", "userId", "itemId", "rating", "ts")).write.text(
        f"{base}/ml-1m/ratings.dat"
    )
    convert_all(spark, base)
    return load_ratings(spark, "ml-1m", base)


def _experiment_summary(spark: SparkSession, sf: str, method: str = "exact", **params: float) -> DataFrame:
    """A summary row with all columns but the time."""
    out = fresh_path(spark, "summary")
    run_experiment(spark, order_ratings(spark, sf), method, params, out=out, dataset="orders")
    return _rounded(read_summary(spark, out).drop("Execution Time (s)"), "RMSE", "MAE")


_LSH = {"bucket_length": oracles.BUCKET, "num_hash_tables": oracles.TABLES, "max_distance": oracles.SPARSE_DISTANCE}


def _item_user_ratings(spark: SparkSession, sf: str) -> DataFrame:
    rated = F.col("user_ratings")
    return item_user_ratings(_split(spark, sf)[0], SLICE).select(
        "itemId",
        "slice",
        F.size(rated).alias("n_users"),
        F.get(rated, 0)["userId"].alias("first_user"),
        F.element_at(rated, -1)["userId"].alias("last_user"),
        F.aggregate(rated, F.lit(0.0), lambda total, e: total + e["rating"]).alias("rating_sum"),
    )


def _item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return vector_entries(item_vectors(_split(spark, sf)[0], SLICE), SLICE)


def _normalized_item_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = normalized_item_vectors(item_vectors(_split(spark, sf)[0], SLICE))
    return _rounded(vector_entries(vectors, SLICE), "value")


def _item_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(item_cosine(_split(spark, sf)[0]), "cosine_sim")


def _within_group_pairs(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    return within_group_pairs(train, _groups(train))


def _group_cosines(spark: SparkSession, sf: str) -> DataFrame:
    train, _ = _split(spark, sf)
    return within_group_cosine(train, _groups(train))


def _lsh_item_hashes(train: DataFrame) -> DataFrame:
    facts, weights = _leaders(train)
    hashes = hashes_of_items(lsh_item_hashes(weights, oracles.BUCKET, oracles.TABLES, oracles.SEED), facts)
    return hashes.select("itemId", F.posexplode("hashes").alias("tbl", "bucket"))


def _lsh_pairs(train: DataFrame, distance: float = oracles.DENSE_DISTANCE, bucket: float = oracles.BUCKET,
               tables: int = oracles.TABLES, **how: int | str) -> DataFrame:
    facts, weights = _leaders(train)
    return lsh_similarity_join(weights, distance, bucket, tables, oracles.SEED, facts=facts, **how)


def _distance_to_cosine(spark: SparkSession, sf: str) -> DataFrame:
    pairs = _lsh_pairs(_split(spark, sf, DENSE)[0]).withColumn("cosine_sim", distance_to_cosine(F.col("distance")))
    return _rounded(pairs, "distance", "cosine_sim")


def _neighbors(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    train = stage(train, "train")
    facts = stage(item_facts(train, _groups(train)), "facts")
    rated = stage(with_facts(train, facts), "rated")
    similarities = symmetric_similarities(pair_cosines(leader_weights(rated), within=["grp"]))
    owned = rated.select("userId", "grp", "leader", "itemId", "rating")
    return neighbor_ratings(targets_of(test, facts, train), similarities, owned)


def _neighbor_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return _neighbors(spark, sf).select(
        "userId",
        F.col("itemId").alias("target_item"),
        F.col("neighbor_itemId").alias("neighbor_item"),
        F.round("cosine_sim", 6).alias("cosine_sim"),
        "neighbor_rating",
    )


def _weighted_rating_sums(spark: SparkSession, sf: str) -> DataFrame:
    sums = weighted_rating_sums(_neighbors(spark, sf)).withColumnRenamed("itemId", "target_item")
    return _rounded(
        sums.select("userId", "target_item", "weighted_rating_sum", "similarity_sum"),
        "weighted_rating_sum",
        "similarity_sum",
    )


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return predict_ratings(weighted_rating_sums(_neighbors(spark, sf))).select("userId", "itemId", "pred_rating")


def _scored_predictions(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(scored_predictions(_predictions(spark, sf), _split(spark, sf)[1]))


def _evaluate(spark: SparkSession, sf: str, item: str = SPARSE) -> DataFrame:
    return _rounded(evaluate_predictions(exact_cf(*_split(spark, sf, item))), "rmse", "mae")


def _group_cf(spark: SparkSession, sf: str) -> DataFrame:
    train, test = _split(spark, sf)
    return _scored(group_cf(train, test, _groups(train)))


def _lsh_cf(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(
        lsh_cf(*_split(spark, sf), oracles.BUCKET, oracles.TABLES, oracles.SPARSE_DISTANCE, oracles.SEED)
    )


def _quarantined_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that fit and lines that do not, of a file whose highest ratings are spelled out."""
    raw, out = fresh_path(spark, "ratings-dat"), fresh_path(spark, "ratings-sorted-out")
    spelled = F.when(F.col("rating") == 5, "five").otherwise(F.col("rating").cast("string"))
    order_lines(spark, sf).select(F.concat_ws("::", "userId", "itemId", spelled, "ts")).write.text(raw)
    clean, rejected = quarantine_dat(spark, raw, out)
    counts = [df.agg(F.lit(kind).alias("kind"), F.count("*").alias("n_rows")) for kind, df in (("clean", clean), ("rejected", rejected))]
    return counts[0].unionByName(counts[1])


def _assign_new_items(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers, as items that the clustering of parts has not seen, by its kept centres."""
    train, model = _split(spark, sf)[0], fresh_path(spark, "kmeans-model")
    _, weights = _leaders(train)
    k = default_cluster_count(train).first()["k"]
    kmeans_item_clusters(weights, k, oracles.SEED, oracles.KMEANS_ROUNDS, model=model)
    return assign_items(order_ratings(spark, sf, DENSE), model)


def _lsh_hashes_of_new_items(spark: SparkSession, sf: str) -> DataFrame:
    train = _split(spark, sf)[0]
    _, weights = _leaders(order_ratings(spark, sf, DENSE))
    users = train.select("userId").distinct()
    hashes = lsh_item_hashes(weights, oracles.BUCKET, oracles.TABLES, oracles.SEED, users)
    return hashes.select(F.col("leader").alias("itemId"), F.posexplode("hashes").alias("tbl", "bucket"))


def _embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")


def _dense_unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    units = unit_vectors(_embeddings(spark, sf), "embedding").select("vec_id", F.posexplode("unit").alias("idx", "value"))
    return _rounded(units, "value")


def _dense_lsh_hashes(spark: SparkSession, sf: str) -> DataFrame:
    found = dense_lsh_hashes(
        _embeddings(spark, sf), "embedding", oracles.DIMS, oracles.DENSE_BUCKET, oracles.TABLES, oracles.SEED
    )
    return found.select("vec_id", F.posexplode("hashes").alias("tbl", "bucket"))


def entry(spark: SparkSession) -> DataFrame:
    """Predict the held-out ratings from all co-rated items."""
    return exact_cf(*_split(spark, "/root/testdata/sf0.001"))


try:
    llm_registry = importlib.import_module("ratingloom.llm.registry")
except ModuleNotFoundError as missing:
    if not (missing.name or "").startswith(("ratingloom.llm", "corpus_pipeline", "public_tokenizers", "tokenizers")):
        raise
    llm_registry = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One entry per operator; the ``*_hot_users`` entries force the plans made for skewed data."""
    return {
        "scan_ratings": _scan_ratings,
        "convert_dat": _convert_dat,
        "experiment_summary": _experiment_summary,
        "preview": lambda s, d: preview(order_ratings(s, d), 5, "userId", "itemId"),
        "train_split": lambda s, d: _split(s, d)[0],
        "test_split": lambda s, d: _split(s, d)[1],
        "split_sizes": lambda s, d: split_sizes(order_ratings(s, d)),
        "dataset_stats": lambda s, d: _rounded(dataset_stats(order_ratings(s, d)), "avg_rating"),
        "default_cluster_count": lambda s, d: default_cluster_count(order_ratings(s, d)),
        "item_user_ratings": _item_user_ratings,
        "item_vectors": _item_vectors,
        "normalized_item_vectors": _normalized_item_vectors,
        "item_cosine": _item_cosine,
        "within_group_pairs": _within_group_pairs,
        "within_group_cosine": lambda s, d: _rounded(_group_cosines(s, d), "cosine_sim"),
        "symmetric_similarities": lambda s, d: _rounded(symmetric_similarities(_group_cosines(s, d)), "cosine_sim"),
        "kmeans_item_clusters": lambda s, d: item_clusters(_split(s, d)[0], max_iter=oracles.KMEANS_ROUNDS),
        "lsh_item_hashes": lambda s, d: _lsh_item_hashes(_split(s, d)[0]),
        "lsh_similarity_join": lambda s, d: _rounded(_lsh_pairs(_split(s, d, DENSE)[0]), "distance"),
        "lsh_similarity_join_hot_users": lambda s, d: _rounded(
            _lsh_pairs(_split(s, d, DENSE)[0], block_items=16, prune_above=8), "distance"
        ),
        "lsh_similarity_join_buckets": lambda s, d: _rounded(
            _lsh_pairs(_split(s, d, DENSE)[0], plan="buckets", block_items=16), "distance"
        ),
        "lsh_similarity_join_far": lambda s, d: _rounded(
            _lsh_pairs(_split(s, d)[0], oracles.FAR_DISTANCE, oracles.FAR_BUCKET, oracles.FAR_TABLES), "distance"
        ),
        "distance_to_cosine": _distance_to_cosine,
        "neighbor_ratings": _neighbor_ratings,
        "weighted_rating_sums": _weighted_rating_sums,
        "predict_ratings": lambda s, d: _rounded(_predictions(s, d), "pred_rating"),
        "scored_predictions": _scored_predictions,
        "evaluate_predictions": _evaluate,
        "evaluate_predictions_dense": lambda s, d: _evaluate(s, d, DENSE),
        "exact_cf": lambda s, d: _scored(exact_cf(*_split(s, d))),
        "exact_cf_hot_users": lambda s, d: _scored(exact_cf(*_split(s, d), heavy_items=32, block_items=8)),
        "exact_cf_touched": lambda s, d: _scored(exact_cf(*_split(s, d), plan="touched")),
        "exact_cf_wanted_pairs": lambda s, d: _scored(exact_cf(*_split(s, d), plan="pairs")),
        "group_cf": _group_cf,
        "kmeans_parallel_start": lambda s, d: item_clusters(
            _split(s, d)[0], oracles.PARALLEL_K, max_iter=oracles.PARALLEL_ITERATIONS, start="parallel"
        ),
        "cluster_cf": lambda s, d: _scored(cluster_cf(*_split(s, d), max_iter=oracles.KMEANS_ROUNDS)),
        "lsh_cf": _lsh_cf,
        "experiment_summary_lsh": lambda s, d: _experiment_summary(s, d, "lsh", **_LSH),
        "experiment_summary_cluster": lambda s, d: _experiment_summary(s, d, "cluster", max_iter=oracles.KMEANS_ROUNDS),
        "named_datasets": _named_datasets,
        "quarantined_lines": _quarantined_lines,
        "assign_new_items": _assign_new_items,
        "lsh_hashes_of_new_items": _lsh_hashes_of_new_items,
        "dense_unit_vectors": _dense_unit_vectors,
        "dense_lsh_hashes": _dense_lsh_hashes,
        "exact_cf_overlap": lambda s, d: _scored(exact_cf(*_overlap(s, d))),
        "exact_cf_overlap_hot_users": lambda s, d: _scored(exact_cf(*_overlap(s, d), heavy_items=32, block_items=8)),
        "exact_cf_copies": lambda s, d: _scored(exact_cf(*_with_copies(s, d))),
        "exact_cf_copies_hot_users": lambda s, d: _scored(exact_cf(*_with_copies(s, d), heavy_items=32, block_items=8)),
        "item_cosine_copies": lambda s, d: _rounded(item_cosine(_with_copies(s, d, DENSE)[0]), "cosine_sim"),
        "within_group_pairs_copies": lambda s, d: within_group_pairs(
            (t := _with_copies(s, d)[0]), _groups(t)
        ),
        "lsh_item_hashes_copies": lambda s, d: _lsh_item_hashes(_with_copies(s, d)[0]),
        "lsh_similarity_join_copies": lambda s, d: _rounded(_lsh_pairs(_with_copies(s, d, DENSE)[0]), "distance"),
        "kmeans_item_clusters_copies": lambda s, d: item_clusters(
            _with_copies(s, d)[0], max_iter=oracles.KMEANS_ROUNDS
        ),
        **(llm_registry.queries() if llm_registry else {}),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql() | (llm_registry.oracle_sql() if llm_registry else {})
