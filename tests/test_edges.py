"""Hand-made inputs at the edges of the contracts."""

from __future__ import annotations

import math

import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from brute_force import predictions, scored_map
from ratingloom.functions.hashing import gaussian, uniform
from ratingloom.functions.scores import default_cluster_count, distance_to_cosine, weighted_mean
from ratingloom.operators.evaluation import evaluate_predictions
from ratingloom.operators.items import item_facts, leader_weights, with_facts
from ratingloom.operators.lsh import lsh_similarity_join
from ratingloom.operators.profile import dataset_stats, preview
from ratingloom.operators.similarity import item_cosine, symmetric_similarities
from ratingloom.operators.split import hash_split, random_split, split_sizes
from ratingloom.operators.vectors import item_norms, item_vectors, ml_vectors, normalized_item_vectors, vector_entries
from ratingloom.plans.recommenders import cluster_cf, exact_cf, lsh_cf
from ratingloom.schema import RATINGS
from ratingloom.sources.ratings_files import canonical_ratings


def frame(spark, rows):
    return spark.createDataFrame([(u, i, float(r)) for u, i, r in rows], RATINGS)


# Items 0 and 1 are alike, item 2 overlaps, item 3 is apart, item 4 is all zero.
FIVE = [(0, 0, 3), (1, 0, 4), (0, 1, 3), (1, 1, 4), (0, 2, 5), (2, 2, 1), (3, 3, 2), (1, 4, 0)]


def weights_of(df):
    return leader_weights(with_facts(df, item_facts(df)))


def test_cosines_of_the_five_items(spark):
    found = {(r["i"], r["j"]): r["cosine_sim"] for r in item_cosine(frame(spark, FIVE)).collect()}
    near = pytest.approx(15 / (5 * math.sqrt(26)))
    assert found == {(0, 1): pytest.approx(1.0), (0, 2): near, (1, 2): near}


def test_distance_of_the_five_items_and_strict_threshold(spark):
    weights = weights_of(frame(spark, FIVE))
    distance = 0.9073605618335503
    near = lsh_similarity_join(weights, 1.0, num_hash_tables=60).collect()
    assert [(r["i"], r["j"], round(r["distance"], 12)) for r in near] == [(0, 2, round(distance, 12))]
    half = frame(spark, [(0, 0, 1), (1, 0, 1), (1, 1, 1), (2, 1, 1)])  # cosine 1/2, distance exactly 1
    assert lsh_similarity_join(weights_of(half), 1.0, num_hash_tables=60).count() == 0
    assert lsh_similarity_join(weights_of(half), 1.0001, num_hash_tables=60).count() == 1


@pytest.mark.parametrize("method", [exact_cf, lsh_cf, cluster_cf])
def test_empty_and_single_inputs(spark, method):
    empty = frame(spark, [])
    assert method(empty, empty).count() == 0
    one_item = frame(spark, [(0, 7, 3), (1, 7, 4)])
    assert method(one_item, frame(spark, [(2, 7, 1)])).count() == 0
    one_user = frame(spark, [(0, 1, 3), (0, 2, 4)])
    assert method(one_user, frame(spark, [(0, 3, 1)])).count() == 0


def test_gaps_unknown_users_and_unknown_items(spark):
    train = [(0, 5, 3), (0, 900, 4), (10**12, 5, 2), (10**12, 900, 5), (10**12, 6, 1), (0, 6, 0)]
    test = [(7, 5, 3), (0, 12345, 2), (10**12, 77, 1)]
    assert scored_map(exact_cf(frame(spark, train), frame(spark, test))) == {}
    train += [(3, 5, 1), (3, 6, 2)]
    test += [(3, 900, 4)]
    assert scored_map(exact_cf(frame(spark, train), frame(spark, test))) == predictions(train, test) != {}


def test_duplicates_keep_the_largest_rating(spark):
    found = canonical_ratings(frame(spark, [(1, 1, 2), (1, 1, 4), (1, 2, 3)])).collect()
    assert sorted(map(tuple, found)) == [(1, 1, 4.0), (1, 2, 3.0)]


def test_split_is_stable_and_complete(spark):
    rows = frame(spark, [(u, i, 1) for u in range(60) for i in range(50)])
    train, test = hash_split(rows)
    again = hash_split(rows.repartition(7))[1]
    assert set(map(tuple, test.collect())) == set(map(tuple, again.collect()))
    assert train.count() + test.count() == 3000
    assert 200 < test.count() < 400
    assert hash_split(rows, seed=1)[1].exceptAll(test).count() > 0
    assert {r["is_test"]: r["n_rows"] for r in split_sizes(rows).collect()} == {True: test.count(), False: train.count()}
    a, b = random_split(rows)
    assert a.count() + b.count() == 3000


def test_stats_of_nothing_and_of_something(spark):
    nothing = dataset_stats(frame(spark, [])).first()
    assert (nothing["n_ratings"], nothing["n_users"], nothing["n_items"], nothing["avg_rating"]) == (0, 0, 0, None)
    row = dataset_stats(frame(spark, FIVE)).first()
    assert (row["n_ratings"], row["n_users"], row["n_items"]) == (8, 4, 5)
    assert (row["avg_rating"], row["min_rating"], row["max_rating"]) == (pytest.approx(22 / 8), 0.0, 5.0)


def test_preview(spark):
    assert [r["userId"] for r in preview(frame(spark, FIVE), 2, "userId", "itemId").collect()] == [0, 0]
    assert preview(frame(spark, FIVE), 3).count() == 3


def test_metrics_of_nothing(spark):
    rows = spark.createDataFrame([], "pred_rating double, actual_rating double")
    assert tuple(evaluate_predictions(rows).first()) == (0, None, None)


def test_formulas(spark):
    row = spark.range(1).select(
        distance_to_cosine(F.lit(1.0)).alias("half"),
        weighted_mean(F.lit(3.0), F.lit(0.0)).alias("undefined"),
        weighted_mean(F.lit(3.0), F.lit(2.0)).alias("mean"),
        *[default_cluster_count(F.lit(n)).alias(f"k{n}") for n in (0, 50, 3706, 59047)],
    ).first()
    assert tuple(row) == (0.5, None, 1.5, 10, 10, 60, 100)


def test_symmetric_pairs_appear_once_each_way(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25)], "i long, j long, cosine_sim double")
    found = sorted(map(tuple, symmetric_similarities(pairs).collect()))
    assert found == [(1, 2, 0.5), (1, 3, 0.25), (2, 1, 0.5), (3, 1, 0.25)]


def test_vector_slices_hold_every_entry_and_stay_small(spark):
    rows = [(u, i, (u + i) % 9 + 1) for u in range(0, 100, 3) for i in range(4)]
    vectors = item_vectors(frame(spark, rows), width=16)
    assert max(r["n"] for r in vectors.select(F.size("indices").alias("n")).collect()) <= 16
    assert sorted(map(tuple, vector_entries(vectors, 16).collect())) == sorted((i, u, float(r)) for u, i, r in rows)
    lengths = normalized_item_vectors(vectors).groupBy("itemId").agg(
        F.sum(F.aggregate("values", F.lit(0.0), lambda t, v: t + v * v)).alias("n")
    )
    assert all(r["n"] == pytest.approx(1.0) for r in lengths.collect())
    zero = normalized_item_vectors(item_vectors(frame(spark, [(1, 4, 0)])))
    assert zero.first()["values"] == [0.0]


def test_slices_as_ml_vectors_feed_the_library_operators(spark):
    df = frame(spark, FIVE)
    vectors = ml_vectors(item_vectors(df, 16), 16)
    scaled = Normalizer(inputCol="features", outputCol="unit", p=2.0).transform(vectors)
    norms = {r["itemId"]: r["norm"] for r in item_norms(df).collect()}
    for row in scaled.select("itemId", vector_to_array("features").alias("f"), vector_to_array("unit").alias("u")).collect():
        n = norms[row["itemId"]] or 1.0
        assert row["u"] == pytest.approx([v / n for v in row["f"]])
    lsh = BucketedRandomProjectionLSH(inputCol="unit", outputCol="h", bucketLength=1.5, numHashTables=40, seed=42)
    joined = lsh.fit(scaled).approxSimilarityJoin(scaled, scaled, 1.0, "distance")
    theirs = {
        (r["i"], r["j"]): r["distance"]
        for r in joined.select(F.col("datasetA.itemId").alias("i"), F.col("datasetB.itemId").alias("j"), "distance").collect()
        if r["i"] < r["j"]
    }
    assert theirs == {(0, 1): 0.0, (0, 2): pytest.approx(0.9073605618335503), (1, 2): pytest.approx(0.9073605618335503)}


def test_random_columns_look_random(spark):
    draws = spark.range(20000).select(
        uniform("id", 42).alias("u"), gaussian("id", 3, 42).alias("g"), gaussian("id", 4, 42).alias("h")
    )
    row = draws.agg(
        F.avg("u").alias("mu"), F.avg("g").alias("m"), F.stddev("g").alias("s"), F.corr("g", "h").alias("c"),
        F.avg((F.abs("g") < 1).cast("double")).alias("within"), F.corr("u", "g").alias("ug"),
    ).first()
    assert row["mu"] == pytest.approx(0.5, abs=0.02)
    assert row["m"] == pytest.approx(0, abs=0.03) and row["s"] == pytest.approx(1, abs=0.03)
    assert row["within"] == pytest.approx(0.6827, abs=0.02)
    assert abs(row["c"]) < 0.03 and abs(row["ug"]) < 0.03
