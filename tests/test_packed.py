"""Sums and cosines whose rows travel as lists: the same results, and no row per pair is shuffled."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from brute_force import by_item, cosine, predictions, scored_map
from ratingloom.operators import lsh, prediction, similarity
from ratingloom.operators.items import item_facts, leader_weights, owned_ratings, with_facts
from ratingloom.operators.prediction import all_neighbor_sums, neighbor_ratings, predict_ratings, targets_of
from ratingloom.operators.similarity import item_cosine, packed_pairs, pair_cosines, similar_pairs, symmetric_similarities
from ratingloom.plans.recommenders import exact_cf
from ratingloom.schema import RATINGS
from test_skew import skewed_rows


def shuffle_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)


@pytest.mark.parametrize("far", [0, 2**33])
@pytest.mark.parametrize(("reach", "block"), [(1 << 21, 1024), (20, 3)])
def test_users_plan(spark, monkeypatch, far, reach, block):
    monkeypatch.setattr(prediction, "REACH", reach)
    monkeypatch.setattr(prediction, "LIST_RATERS", block)
    train, test = ([(u + far * (u % 2), i, r) for u, i, r in rows] for rows in skewed_rows(3))
    test += train[::9]
    found = exact_cf(spark.createDataFrame(train, RATINGS), spark.createDataFrame(test, RATINGS), plan="users")
    assert scored_map(found) == predictions(train, test)


def test_users_and_item_pairs_mixed(spark):
    train, test = skewed_rows(4)
    found = exact_cf(spark.createDataFrame(train, RATINGS), spark.createDataFrame(test, RATINGS), 6, 3, plan="all")
    assert scored_map(found) == predictions(train, test)


def test_a_full_test_side_shuffles_no_row_per_pair(spark):
    rows = spark.range(4000).select(F.col("id") % 100, F.floor(F.col("id") / 10), F.col("id") % 9 / 2 + 0.5)
    train, test = (rows.toDF("userId", "itemId", "rating").where(f"userId % 10 {op} 3") for op in ("<>", "="))
    train = train.unionByName(test.where("itemId % 2 = 0"))
    facts = item_facts(train)
    rated = with_facts(train, facts)
    sums = all_neighbor_sums(targets_of(test, facts, train), leader_weights(rated), owned_ratings(rated))
    assert not [key for key in shuffle_keys(sums) if "other#" in key or "a_leader#" in key]
    assert predict_ratings(sums).count() > 0


def pairs_of(df):
    rows = df.collect()
    found = {(r["i"], r["j"]): round(r["cosine_sim"], 9) for r in rows}
    assert len(found) == len(rows)
    return found


def cosines(train):
    vectors = by_item(train)
    found = {(i, j): cosine(vectors[i], vectors[j]) for i in vectors for j in vectors if i < j}
    return {pair: round(s, 9) for pair, s in found.items() if s > 0}


@pytest.mark.parametrize("far", [0, 2**33])
@pytest.mark.parametrize(("reach", "block"), [(1 << 21, 1024), (20, 4)])
def test_packed_pairs(spark, monkeypatch, far, reach, block):
    monkeypatch.setattr(similarity, "REACH", reach)
    train = [(u, i + far * (i % 2), r) for u, i, r in skewed_rows(6)[0]]
    df, want = spark.createDataFrame(train, RATINGS), cosines(train)
    weights = leader_weights(with_facts(df, item_facts(df)))
    leaders = {r[0] for r in weights.select("leader").distinct().collect()}
    among = {pair: s for pair, s in want.items() if leaders >= set(pair)}
    found = pair_cosines(weights, block_items=block)
    assert pairs_of(found) == among
    assert not [key for key in shuffle_keys(found) if "j#" in key or "b_leader#" in key]
    assert pairs_of(item_cosine(df)) == want
    some = weights.where("leader % 3 = 0")
    both = among | {(j, i): s for (i, j), s in among.items()}
    directed = pairs_of(packed_pairs(some, weights, block_items=block))
    assert directed == {pair: s for pair, s in both.items() if pair[0] % 3 == 0}


def test_candidates_that_are_most_pairs_are_not_looked_up(spark, monkeypatch):
    train = skewed_rows(7)[0]
    df = spark.createDataFrame(train, RATINGS)
    weights = leader_weights(with_facts(df, item_facts(df))).cache()
    monkeypatch.setattr(similarity, "exact_cosines", None)
    leaders = {r[0] for r in weights.select("leader").distinct().collect()}
    want = {pair: s for pair, s in cosines(train).items() if s > 0.2 and leaders >= set(pair)}
    assert pairs_of(similar_pairs(weights, 0.2, block_items=4, prune_above=2)) == want


def test_neighbours_are_met_inside_the_group(spark):
    train, test = skewed_rows(8)
    train, test = spark.createDataFrame(train, RATINGS), spark.createDataFrame(test, RATINGS)
    facts = item_facts(train, train.select("itemId", (F.col("itemId") % 5).alias("grp")).distinct())
    rated = with_facts(train, facts)
    near = symmetric_similarities(pair_cosines(leader_weights(rated), ["grp"]))
    targets = targets_of(test, facts, train)
    columns = ["userId", "leader", "itemId", "rating"]
    found = neighbor_ratings(targets, near, rated.select("grp", *columns), 10**6)
    assert re.search(r"\(grp#\d+L? = grp#\d+L?\)", found._jdf.queryExecution().optimizedPlan().toString())
    whole = neighbor_ratings(targets, near, rated.select(*columns), 10**6)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect())) != []


def test_a_missing_rating_loses_no_pair(spark, monkeypatch):
    train = skewed_rows(9)[0]
    df = spark.createDataFrame(train + [(50, item, None) for item in range(0, 60, 4)], "userId long, itemId long, rating double")
    weights = leader_weights(with_facts(df, item_facts(df))).cache()
    plain = pairs_of(similar_pairs(weights, 0.3))
    monkeypatch.setattr(similarity, "PRUNED", 0)
    assert pairs_of(similar_pairs(weights, 0.3, block_items=4, prune_above=2)) == plain != {}


@pytest.mark.parametrize("most", [1024, 3])
def test_wanted_pairs_by_lists(spark, monkeypatch, most):
    def look_up(pairs, weights):
        assert most == 3, "pairs of ordinary items are looked up rater by rater"
        return similarity.exact_cosines(pairs, weights)

    monkeypatch.setattr(prediction, "LIST_RATERS", most)
    monkeypatch.setattr(prediction, "exact_cosines", look_up)
    train, test = skewed_rows(5)
    test += train[::9]
    found = exact_cf(spark.createDataFrame(train, RATINGS), spark.createDataFrame(test, RATINGS), plan="pairs")
    assert scored_map(found) == predictions(train, test)


def test_wide_buckets_form_no_more_than_corated_pairs(spark, monkeypatch):
    def refuse(*args):
        raise AssertionError("all items of a bucket meet")

    # Sixty groups of items without a common user, in buckets as wide as a sign.
    rows = [(3 * group + u, 4 * group + n, 0.5 + (group * n + u) % 9 / 2) for group in range(60) for n in range(4) for u in range(3)]
    train = spark.createDataFrame(rows, RATINGS)
    weights = leader_weights(with_facts(train, item_facts(train)))
    wanted = pairs_of(lsh.lsh_similarity_join(weights, 1.25, 1.5, 8, plan="raters").withColumnRenamed("distance", "cosine_sim"))
    monkeypatch.setattr(lsh, "bucket_pairs", refuse)
    found = lsh.lsh_similarity_join(weights, 1.25, 1.5, 8, plan="buckets")
    assert pairs_of(found.withColumnRenamed("distance", "cosine_sim")) == wanted and len(wanted) > 200
