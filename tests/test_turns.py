"""Lists that take turns, hold what is needed in few bytes, and leave out what nobody asks for: the same results."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from brute_force import by_item, cosine, predictions, scored_map
from ratingloom import staging
from ratingloom.operators import lsh, prediction, similarity
from ratingloom.operators.items import item_facts, leader_weights, owned_ratings, with_facts
from ratingloom.operators.prediction import targets_of, touched_cosines
from ratingloom.operators.similarity import near_pairs, packed_pairs
from ratingloom.plans.recommenders import exact_cf
from ratingloom.schema import RATINGS
from test_skew import skewed_rows


@pytest.fixture
def turns(monkeypatch):
    """How often tables were made in more than one turn."""
    seen = []

    def counted(n, *args):
        seen.append(n)
        return staging.in_turns(n, *args)

    for module in (prediction, similarity, lsh):
        monkeypatch.setattr(module, "in_turns", counted)
    return seen


def weights_of(spark, rows):
    train = spark.createDataFrame(rows, RATINGS)
    return leader_weights(with_facts(train, item_facts(train)))


def pairs_of(df):
    rows = [(r["i"], r["j"], round(r["cosine_sim"], 9)) for r in df.collect()]
    assert len({(i, j) for i, j, _ in rows}) == len(rows)
    return set(rows)


@pytest.mark.parametrize("known", [1024, 2])
@pytest.mark.parametrize("plan", ["users", "touched", "all"])
def test_predictions_in_turns(spark, monkeypatch, turns, plan, known):
    monkeypatch.setattr(prediction, "AT_ONCE", 700)
    monkeypatch.setattr(prediction, "KNOWN", known)
    monkeypatch.setattr(similarity, "KNOWN", known)
    train, test = skewed_rows(3)
    test += train[::9]
    found = exact_cf(spark.createDataFrame(train, RATINGS), spark.createDataFrame(test, RATINGS), plan=plan)
    assert scored_map(found) == predictions(train, test)
    assert max(turns) > 1


@pytest.mark.parametrize("block", [1024, 4])
def test_near_pairs_in_turns(spark, monkeypatch, turns, block):
    weights = weights_of(spark, skewed_rows(6)[0]).cache()
    whole = pairs_of(near_pairs(weights, 0.2, block))
    monkeypatch.setattr(similarity, "AT_ONCE", 700)
    assert pairs_of(near_pairs(weights, 0.2, block)) == whole != set()
    assert turns[0] <= 1 < turns[1]


def test_a_turn_leaves_no_shuffle_files(spark):
    left = []

    def part(turn):
        time.sleep(2)  # files are removed by a thread of their own
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        left.append(sum("shuffle" in blocks.apply(n).toString() for n in range(blocks.size())))
        return spark.range(2000).repartition(7, F.col("id") % (5 + turn)).groupBy("id").count()

    assert staging.in_turns(4, "rows", part).count() == 8000
    assert max(left[1:]) <= left[0]


@pytest.mark.parametrize(("step", "narrow"), [(0.5, True), (0.3, False), (200.0, False)])
def test_lists_are_narrow_where_nothing_is_lost(spark, step, narrow):
    rows = [(u, i, step * (1 + (u * i) % 9)) for u in range(30) for i in range(u % 7, 60, 5)]
    found = packed_pairs(weights_of(spark, rows))
    vectors, leaders = by_item(rows), {r[0] for r in weights_of(spark, rows).select("leader").distinct().collect()}
    want = {(i, j, round(cosine(vectors[i], vectors[j]), 9)) for i in leaders for j in leaders if i < j}
    assert pairs_of(found) == {pair for pair in want if pair[2] > 0}
    assert ("as tinyint)" in found._jdf.queryExecution().analyzed().toString()) == narrow


def test_only_wanted_pairs_are_unpacked(spark):
    rows = [(u, i, 1.0 + (u + i) % 4) for u in range(60) for i in range(u % 5, 300, 7)]
    train = spark.createDataFrame(rows, RATINGS)
    facts = item_facts(train)
    rated = with_facts(train, facts)
    test = spark.createDataFrame([(u, 299 - u, 3.0) for u in range(10)], RATINGS)
    targets, owned = targets_of(test, facts, train), owned_ratings(rated)
    wanted = targets.select("userId", F.col("leader").alias("target")).join(owned, "userId").select("target", "leader").distinct()
    found = touched_cosines(targets, leader_weights(rated), owned, []).select("target", "leader")
    assert 0 < found.count() <= wanted.count()
    assert found.join(wanted, ["target", "leader"], "left_anti").isEmpty()


def test_a_full_bucket_is_sent_to_few_blocks(spark, monkeypatch, turns):
    monkeypatch.setattr(lsh, "JOINED", 50)
    rows = [(u, i, 1.0 + (u + i) % 5) for i in range(120) for u in (i % 31, 31 + i % 29)]
    weights = weights_of(spark, rows).cache()

    def found():
        return {(r["i"], r["j"], round(r["distance"], 9)) for r in lsh.lsh_similarity_join(weights, 1.45, 5.0, 2, block_items=4).collect()}

    monkeypatch.setattr(lsh, "MOST_BLOCKS", 3)
    some = found()
    hashed = lsh.lsh_item_hashes(weights, 5.0, 2)
    places = lsh.block_places(hashed, 4).select(F.explode("places").alias("at"))
    assert places.agg(F.max("at.n_blocks")).first()[0] == 3
    monkeypatch.setattr(lsh, "MOST_BLOCKS", 1000)
    assert found() == some and len(some) > 100 and max(turns) > 1
