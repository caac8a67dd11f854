"""Data with one hot user, one hot item and a mass of copies; forced splitting gives equal results."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brute_force import by_item, cosine, predictions, scored_map
from ratingloom.operators import lsh
from ratingloom.operators.items import item_facts, leader_weights, with_facts
from ratingloom.operators.lsh import bucket_pairs, lsh_item_hashes, lsh_similarity_join
from ratingloom.operators.pairing import corated
from ratingloom.operators.similarity import similar_pairs, strong_entries
from ratingloom.plans.recommenders import exact_cf, group_cf, lsh_cf
from ratingloom.schema import RATINGS


def skewed_rows(seed):
    rng = random.Random(seed)
    rows = {(1, item): rng.randint(1, 10) / 2 for item in range(60)}  # hot user
    rows |= {(user, 3): rng.randint(1, 10) / 2 for user in range(40)}  # hot item
    rows |= {(2, item): 4.0 for item in range(100, 130)}  # copies: one rater, one rating
    while len(rows) < 330:
        rows[rng.randrange(40), rng.randrange(60)] = rng.randint(1, 10) / 2
    rows = [(u, i, r) for (u, i), r in rows.items()]
    rng.shuffle(rows)
    held = [r for n, r in enumerate(rows) if n % 8 == 0]
    return [r for n, r in enumerate(rows) if n % 8], held


@pytest.fixture(scope="module", params=[1])
def skewed(spark, request):
    train, test = skewed_rows(request.param)
    return train, test, spark.createDataFrame(train, RATINGS), spark.createDataFrame(test, RATINGS)


@pytest.mark.parametrize("limits", [{}, {"heavy_items": 6, "block_items": 3}])
def test_exact_predictions(skewed, limits):
    train, test, train_df, test_df = skewed
    assert scored_map(exact_cf(train_df, test_df, **limits)) == predictions(train, test)


@pytest.mark.parametrize("limits", [{"heavy_items": 6, "block_items": 2}])
def test_group_predictions(skewed, limits):
    train, test, train_df, test_df = skewed
    groups = train_df.select("itemId", (F.col("itemId") % 3).alias("grp")).distinct()
    want = predictions(train, test, lambda i, j, s: s > 0 and i % 3 == j % 3)
    assert scored_map(group_cf(train_df, test_df, groups, **limits)) == want


@pytest.mark.parametrize("limits", [{}, {"block_items": 4}])
def test_lsh_predictions(skewed, limits):
    train, test, train_df, test_df = skewed
    # 60 tables: a pair this close misses every bucket with a chance below 1e-12.
    found = lsh_cf(train_df, test_df, max_distance=1.1, num_hash_tables=60, **limits)
    assert scored_map(found) == predictions(train, test, lambda i, j, s: s > 1 - 1.1**2 / 2)


def weights_of(df):
    return leader_weights(with_facts(df, item_facts(df)))


def test_copies_share_a_leader(skewed):
    train, _, train_df, _ = skewed
    facts = {r["itemId"]: r["leader"] for r in item_facts(train_df).collect()}
    vectors = by_item(train)
    for i in vectors:
        assert facts[i] == min(j for j in vectors if vectors[j] == vectors[i])
    assert len({facts[i] for i in vectors if i >= 100}) == 1


@pytest.mark.parametrize("block_items", [4, 1000])
def test_every_pair_of_a_user_once(skewed, block_items):
    train, _, train_df, _ = skewed
    rated = train_df.withColumnRenamed("itemId", "leader")
    met = corated(rated, ["rating"], block_items=block_items).collect()
    found = [(r["userId"], r["a_leader"], r["b_leader"], r["a_rating"], r["b_rating"]) for r in met]
    want = {(u, i, j, r, s) for u, i, r in train for v, j, s in train if u == v and i < j}
    assert len(found) == len(want) and set(found) == want


@pytest.mark.parametrize("min_cosine, prune_above", [(0.0, 1), (0.2, 1), (0.5, 1), (0.8, 1), (0.5, 1000)])
def test_threshold_join_equals_all_pairs(skewed, min_cosine, prune_above):
    train, _, train_df, _ = skewed
    leaders = {r["leader"] for r in item_facts(train_df).collect()}
    vectors = {i: v for i, v in by_item(train).items() if i in leaders}
    want = {(i, j): round(s, 9) for i in vectors for j in vectors if i < j and (s := cosine(vectors[i], vectors[j])) > min_cosine}
    rows = similar_pairs(weights_of(train_df), min_cosine, block_items=5, prune_above=prune_above).collect()
    assert {(r["i"], r["j"]): round(r["cosine_sim"], 9) for r in rows} == want
    assert len(rows) == len(want)


def test_hot_user_keeps_few_strong_entries(skewed):
    _, _, train_df, _ = skewed
    weights = weights_of(train_df)
    strong = strong_entries(weights, 0.5).where("userId = 1").count()
    assert strong < weights.where("userId = 1").count() / 2


def test_lsh_pairs_are_near_and_share_a_bucket(skewed):
    train, _, train_df, _ = skewed
    vectors = by_item(train)
    some = lsh_similarity_join(weights_of(train_df), 1.2, num_hash_tables=1).collect()
    every = lsh_similarity_join(weights_of(train_df), 1.2, num_hash_tables=60).collect()
    assert {(r["i"], r["j"]) for r in some} < {(r["i"], r["j"]) for r in every}
    for r in every:
        assert r["i"] < r["j"] and r["distance"] < 1.2
        assert r["distance"] == pytest.approx((2 - 2 * cosine(vectors[r["i"]], vectors[r["j"]])) ** 0.5)


LIMITS = [{}, {"heavy_items": 1, "block_items": 2}]


@pytest.mark.parametrize("limits", LIMITS)
def test_negative_ratings_at_every_size(spark, limits):
    rows = [(u, i, float((u * 5 + i * 3) % 7 - 3)) for u in range(6) for i in range(6) if (u, i) != (0, 0)]
    test = [(0, 0, 1.0), (3, 4, 2.0)]
    found = exact_cf(spark.createDataFrame(rows, RATINGS), spark.createDataFrame(test, RATINGS), **limits)
    assert scored_map(found) == predictions(rows, test, lambda i, j, s: True)


@pytest.mark.parametrize("limits", LIMITS)
def test_own_ratings_and_copies_at_every_size(skewed, spark, limits):
    train, test, train_df, _ = skewed
    both = test + train[::9] + [(2, 100, 1.0), (2, 129, 4.0)]
    both = [(u, i, r) for (u, i), r in {(u, i): r for u, i, r in both}.items()]
    found = exact_cf(train_df, spark.createDataFrame(both, RATINGS), **limits)
    assert scored_map(found) == predictions(train, both)


def bucket_mates(weights, tables, length, seed=42):
    """Pairs that share a bucket, from the hashes themselves."""
    found = {r["leader"]: r["hashes"] for r in lsh_item_hashes(weights, length, tables, seed).collect()}
    return {(i, j) for i in found for j in found if i < j and any(x == y for x, y in zip(found[i], found[j], strict=True))}


def test_far_pairs_of_negative_ratings_are_found(spark):
    rows = [(u, i, float((u * 5 + i * 3) % 7 - 3)) for u in range(6) for i in range(6)]
    vectors = by_item(rows)
    train = spark.createDataFrame(rows, RATINGS)
    facts = item_facts(train)
    weights = leader_weights(with_facts(train, facts))
    leader = {r["itemId"]: r["leader"] for r in facts.collect()}
    mates = bucket_mates(weights, 3, 0.8)
    near = {(i, j): (2 - 2 * cosine(vectors[i], vectors[j])) ** 0.5 for i in vectors for j in vectors if i < j}
    want = {
        (i, j) for (i, j), d in near.items()
        if d < 1.6 and (leader[i] == leader[j] or tuple(sorted((leader[i], leader[j]))) in mates)
    }
    found = lsh_similarity_join(weights, 1.6, 0.8, 3, facts=facts)
    pairs = {(r["i"], r["j"]): r["distance"] for r in found.collect()}
    assert set(pairs) == want and any(d > 2**0.5 for d in pairs.values())


@pytest.mark.parametrize(
    "plan, block_items, max_distance", [("buckets", 5, 0.4), ("buckets", 5, 1.45), (None, 1000, 1.2), ("raters", 5, 1.45)]
)
def test_both_plans_find_the_pairs_of_the_buckets(skewed, plan, block_items, max_distance):
    train, _, train_df, _ = skewed
    weights = weights_of(train_df)
    vectors = by_item(train)
    want = {}
    for i, j in bucket_mates(weights, 3, 0.15):
        common = cosine(vectors[i], vectors[j])
        if (2 - 2 * common) ** 0.5 < max_distance:
            want[i, j] = round((2 - 2 * common) ** 0.5, 6)
    if plan == "raters" and max_distance > 2**0.5:
        with pytest.raises(ValueError):
            lsh_similarity_join(weights, max_distance, 0.15, 3, plan=plan)
        want = {k: d for k, d in want.items() if cosine(vectors[k[0]], vectors[k[1]]) > 0}
    found = lsh_similarity_join(
        weights, max_distance, 0.15, 3, block_items=block_items, plan=plan, unrelated=plan != "raters"
    ).collect()
    assert {(r["i"], r["j"]): round(r["distance"], 6) for r in found} == want
    assert len(found) == len(want)
    if max_distance > 2**0.5 and plan != "raters":
        assert any(cosine(vectors[i], vectors[j]) == 0 for i, j in want)


@pytest.mark.parametrize("tables, block_items", [(1, 6), (3, 6), (2, 1000)])
def test_far_pairs_are_named_without_a_row_that_is_shuffled_or_written(spark, monkeypatch, tables, block_items):
    def refuse(*args):
        raise AssertionError("all pairs of a bucket are written and measured")

    # Groups of items without a common user, one item everywhere, opposite ratings, and copies.
    rows = [(3 * group + u, 4 * group + n, 0.5 + (group * n + u) % 9 / 2) for group in range(15) for n in range(4) for u in range(3)]
    rows += [(u, 500, 1.0 + u % 5) for u in range(45)]
    rows += [(0, 600, 2.0), (1, 600, -2.0), (0, 601, 3.0), (1, 601, 3.0)]
    rows += [(7, copy, 4.0) for copy in range(700, 705)]
    vectors = by_item(rows)
    train = spark.createDataFrame(rows, RATINGS)
    facts = item_facts(train)
    weights = leader_weights(with_facts(train, facts))
    leader = {r["itemId"]: r["leader"] for r in facts.collect()}
    mates = bucket_mates(weights, tables, 0.2)
    want = {}
    for i in vectors:
        for j in vectors:
            if i < j and (leader[i] == leader[j] or tuple(sorted((leader[i], leader[j]))) in mates):
                distance = max(2 - 2 * cosine(vectors[i], vectors[j]), 0.0) ** 0.5
                if distance < 1.45:
                    want[i, j] = round(distance, 6)
    monkeypatch.setattr(lsh, "bucket_pairs", refuse)
    found = lsh_similarity_join(weights, 1.45, 0.2, tables, block_items=block_items, facts=facts).collect()
    assert len(found) == len(want)
    assert {(r["i"], r["j"]): round(r["distance"], 6) for r in found} == want
    assert 2 * sum(d == 1.414214 for d in want.values()) > len(want)


def test_a_full_bucket_is_cut_without_losing_a_near_pair(spark):
    rng = random.Random(4)
    rows = [(n, [0, 0], [rng.uniform(-1, 1), rng.uniform(-1, 1)]) for n in range(300)]
    hashed = spark.createDataFrame(rows, "leader long, hashes array<int>, splits array<double>")
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and max(abs(p - q) for p, q in zip(x, y, strict=True)) < 0.1}
    found = [(r["i"], r["j"]) for r in bucket_pairs(hashed, 0.1, block_items=4).collect()]
    assert len(found) == len(want) and set(found) == want


def test_finer_order_sets_entries_aside_where_all_users_are_alike(spark):
    rng = random.Random(6)
    rows = [(u, i, rng.randint(1, 10) / 2) for u in range(60) for i in rng.sample(range(120), 40)]
    weights = weights_of(spark.createDataFrame(rows, RATINGS))
    assert strong_entries(weights, 0.5).count() <= 0.85 * weights.count()
