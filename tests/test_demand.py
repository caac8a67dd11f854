"""Predictions for a small test side: the same sums from fewer rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from brute_force import predictions, scored_map
from ratingloom.operators.items import item_facts, leader_weights, owned_ratings, with_facts
from ratingloom.operators.pairing import corated, met_between
from ratingloom.operators.prediction import _sums_by_item_pair, demand_plan, predict_ratings, targets_of
from ratingloom.schema import RATINGS


def some_ratings(users=150, items=400, each=30, seed=8):
    rng = random.Random(seed)
    rows = [(u, i, rng.randint(1, 10) / 2) for u in range(users) for i in rng.sample(range(items), each)]
    return rows + [(u, i + 1000, r) for u, i, r in rows if i == 7] + [(0, i, 3.0) for i in range(400, 460)]


@pytest.fixture(scope="module")
def sides(spark):
    rows = some_ratings()
    train = spark.createDataFrame(rows, RATINGS).cache()
    facts = item_facts(train).cache()
    rated = with_facts(train, facts)
    return rows, train, facts, leader_weights(rated).cache(), owned_ratings(rated).cache()


def held_out(kind):
    """1 % of the items, or 1 % of the rows: none of them is in the training side."""
    rng = random.Random(2)
    if kind == "items":
        return [(u, i, 2.0) for i in (7, 11, 300, 1007) for u in rng.sample(range(150), 11)]
    return [(rng.randrange(150), rng.randrange(400), 4.0) for _ in range(45)]


@pytest.mark.parametrize("kind", ["items", "rows"])
def test_plans_give_the_same_sums(spark, sides, kind):
    rows, train, facts, weights, owned = sides
    test = list({(u, i): (u, i, r) for u, i, r in held_out(kind)}.values())
    targets = targets_of(spark.createDataFrame(test, RATINGS), facts, train)
    want = predictions(rows, test)
    for plan, block_items in (("all", 1024), ("touched", 1024), ("touched", 4), ("pairs", 1024), (None, 1024)):
        sums = _sums_by_item_pair(targets, weights, owned, [], block_items, None, plan)
        assert scored_map(predict_ratings(sums)) == want


def test_a_small_test_side_makes_few_rows(spark, sides):
    _, train, facts, weights, owned = sides
    whole = corated(weights, ["weight"]).count()
    targets = targets_of(spark.createDataFrame(held_out("items"), RATINGS), facts, train)
    assert demand_plan(targets, weights, owned, []) != "all"
    asked = weights.join(targets.select("leader").distinct(), "leader", "left_semi")
    offered = owned.join(targets.select("userId").distinct(), "userId", "left_semi").select("leader").distinct()
    met = met_between(asked, weights.join(offered, "leader", "left_semi"), ["weight"])
    assert 0 < met.count() <= whole / 10
    everything = targets_of(train.select("userId", "itemId", "rating"), facts, train)
    assert demand_plan(everything, weights, owned, []) == "all"


@pytest.mark.parametrize("block_items", [3, 1000])
def test_two_sides_meet_once_in_order(spark, sides, block_items):
    _, _, _, weights, _ = sides
    left, right = weights.where("leader % 9 = 0"), weights.where("leader % 5 = 0")
    found = [tuple(r) for r in met_between(left, right, [], block_items=block_items).select("userId", "a_leader", "b_leader").collect()]
    entries = [(r["userId"], r["leader"]) for r in weights.select("userId", "leader").collect()]
    by_user: dict[int, list[int]] = {}
    for user, leader in entries:
        by_user.setdefault(user, []).append(leader)
    want = {(u, a, b) for u, items in by_user.items() for a in items for b in items if a % 9 == 0 and b % 5 == 0 and a != b}
    assert len(found) == len(want) and set(found) == want


def test_blocks_of_a_user_are_counted_within_a_group(spark, sides):
    _, _, _, weights, _ = sides
    grouped = weights.withColumn("grp", F.col("leader") % 10)
    met = corated(grouped, [], within=["grp"], block_items=2)
    same = corated(grouped, [], within=["grp"])
    assert met.count() == same.count() > 0
