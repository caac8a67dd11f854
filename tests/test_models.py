"""Kept centres and hashes for new items, vectors as columns, sums without an order, one-pass figures."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ratingloom.operators.clustering import assign_items, kmeans_item_clusters
from ratingloom.operators.dense import dense_lsh_hashes, unit_vectors
from ratingloom.operators.evaluation import evaluate_predictions
from ratingloom.operators.items import item_facts, leader_weights, with_facts
from ratingloom.operators.lsh import lsh_item_hashes
from ratingloom.operators.profile import dataset_stats
from ratingloom.plans.recommenders import exact_cf
from ratingloom.schema import RATINGS, RAW_RATINGS
from ratingloom.sources.ratings_files import quarantine_dat
from ratingloom.sources.summaries import append_summary, read_summary, summary_row
from ratingloom.staging import Workspace, shared_folder

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ratings(spark):
    rng = random.Random(9)
    rows = [(u, i, rng.randint(1, 10) / 2) for u in range(30) for i in rng.sample(range(40), 12)]
    return spark.createDataFrame(rows, RATINGS).cache()


@pytest.fixture(scope="module")
def weights(ratings):
    return leader_weights(with_facts(ratings, item_facts(ratings))).cache()


@pytest.mark.parametrize("how", [{}, {"max_iter": 2}, {"max_iter": 0}, {"tolerance": 0.2}])
def test_kept_centres_give_training_items_their_cluster(spark, ratings, weights, how, tmp_path):
    model = str(tmp_path / "model")
    found = {r["leader"]: r["cluster"] for r in kmeans_item_clusters(weights, 5, model=model, **how).collect()}
    again = {r["itemId"]: r["cluster"] for r in assign_items(ratings, model).collect()}
    if how.get("max_iter") == 0:
        assert {i: again[i] for i in found} == found  # the seeds alone
    else:
        assert {i: again[i] for i in found} == found and set(again) >= set(found)
    new = [(0, 900, 4.0), (1, 900, 2.0), (10**6, 901, 3.0), (3, 902, 0.0), (10**6, 900, 0.5)]
    others = {r["itemId"]: r["cluster"] for r in assign_items(spark.createDataFrame(new, RATINGS), model).collect()}
    assert set(others) == {900, 901} and set(others.values()) <= set(again.values())
    assert assign_items(spark.createDataFrame([], RATINGS), model).count() == 0


def test_a_wide_tolerance_stops_early(ratings, weights, spark):
    spaces = {t: Workspace(spark) for t in (0.0, 10.0)}
    for tolerance, space in spaces.items():
        kmeans_item_clusters(weights, 5, space=space, tolerance=tolerance)
    assert spaces[10.0]._count <= 5 < spaces[0.0]._count  # items, and two tables a round


def test_new_items_are_hashed_on_the_old_axes(spark, ratings, weights):
    users = ratings.select("userId").distinct()
    whole = {r["leader"]: r["hashes"] for r in lsh_item_hashes(weights, 0.1, 4).collect()}
    one = weights.where(F.col("leader").isin(3, 4))
    strange = one.limit(1).withColumn("userId", F.lit(10**6).cast("long"))
    found = {r["leader"]: r["hashes"] for r in lsh_item_hashes(one.unionByName(strange), 0.1, 4, users=users).collect()}
    assert found == {i: whole[i] for i in found} and found


VECTORS = [[3.0, 4.0], [0.0, 0.0], None, [1.0, None], [float("nan"), 1.0], [float("inf"), 1.0], [], [1.0, 2.0, 3.0], [-1.0, 1e-30]]


def test_unit_vectors_of_odd_arrays(spark):
    df = spark.createDataFrame([(n, v, "x") for n, v in enumerate(VECTORS)], "id long, v array<double>, norm string")
    out = unit_vectors(df, "v")
    found = {r["id"]: r["unit"] for r in out.collect()}
    assert found[0] == pytest.approx([0.6, 0.8]) and found[1] == [0.0, 0.0] and found[6] == []
    assert [found[n] for n in (2, 3, 4, 5)] == [None] * 4
    assert found[7] == pytest.approx([x / math.sqrt(14) for x in (1, 2, 3)])
    assert out.columns == ["id", "v", "norm", "unit"]
    hashes = {r["id"]: r["hashes"] for r in dense_lsh_hashes(df, "v", 2, 0.1, 3).collect()}
    assert all(len(hashes[n]) == 3 for n in (0, 1, 8)) and all(hashes[n] is None for n in (2, 3, 4, 5, 6, 7))
    assert dense_lsh_hashes(df.where("false"), "v", 2).count() == 0


def test_dense_hashes_equal_those_of_the_same_sparse_items(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(1, 10) / 2 for _ in range(12)]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    entries = spark.createDataFrame([(u, i, x) for i, v in rows for u, x in enumerate(v)], RATINGS)
    sparse = lsh_item_hashes(leader_weights(with_facts(entries, item_facts(entries))), 0.2, 4)
    want = {r["leader"]: r["hashes"] for r in sparse.collect()}
    assert {r["id"]: r["hashes"] for r in dense_lsh_hashes(df, "v", 12, 0.2, 4).collect()} == want
    plan = dense_lsh_hashes(df, "v", 12)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Generate" not in plan and "Join" not in plan


def test_sums_are_the_same_bits_in_any_order(spark, ratings):
    test = spark.createDataFrame([(u, i, 3.0) for u in range(30) for i in range(u % 5, 40, 5)], RATINGS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for n in (1, 8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            scored = exact_cf(ratings.repartition(n, F.rand(n)), test.repartition(n, F.rand(n + 1)))
            rows = sorted((r["userId"], r["itemId"], r["pred_rating"].hex()) for r in scored.collect())
            errors = evaluate_predictions(scored).first()
            seen.append((rows, errors["rmse"].hex(), errors["mae"].hex()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and seen[0][0]


def test_figures_come_from_one_scan_and_one_shuffle_of_rows(spark, tmp_path):
    path = str(tmp_path / "ratings")
    rows = [(1, 1, 2.0), (1, 2, None), (None, 2, 3.0), (2, None, 5.0), (2, 1, 2.0)]
    spark.createDataFrame(rows, RATINGS).write.parquet(path)
    found = dataset_stats(spark.read.parquet(path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    assert tuple(found.first()) == (5, 3.0, 2.0, 5.0, 2, 2)
    assert tuple(dataset_stats(spark.createDataFrame([], RATINGS)).first()) == (0, None, None, None, 0, 0)


def test_bad_lines_are_set_aside_with_their_text(spark, tmp_path):
    lines = ["1::2::3.5::7", "1::x::3.5::7", "1::2", "", "1::2::3::4::5", "5::6::0.5::9"]
    (tmp_path / "ratings.dat").write_text("\n".join(lines))
    clean, rejected = quarantine_dat(spark, str(tmp_path / "ratings.dat"), str(tmp_path / "out"))
    assert sorted(map(tuple, clean.collect())) == [(1, 2, 3.5, 7), (5, 6, 0.5, 9)]
    assert sorted(r[0] for r in rejected.collect()) == ["1::2", "1::2::3::4::5", "1::x::3.5::7"]
    assert clean.columns == RAW_RATINGS.fieldNames()


def test_a_repeated_append_leaves_one_row(spark, tmp_path):
    path = str(tmp_path / "summary")
    for rmse in (1.0, 0.5):
        append_summary(summary_row(spark, {"Dataset": "a", "RMSE": rmse}), path, run="one")
    append_summary(summary_row(spark, {"Dataset": "b"}), path, run="two")
    append_summary(summary_row(spark, {"Dataset": "b"}), path)
    assert sorted((r["Dataset"], r["RMSE"]) for r in read_summary(spark, path).collect() if r["RMSE"]) == [("a", 0.5)]
    assert read_summary(spark, path).count() == 3


def test_a_cluster_needs_a_shared_folder():
    assert shared_folder("/shared/", "file:/w", "yarn") == "/shared"
    assert shared_folder(None, "file:/w/", "local[8]") == "file:/w/_staged"
    assert shared_folder(None, "hdfs://store/w", "yarn") == "hdfs://store/w/_staged"
    for warehouse in ("file:/w", "/w", "file:///w"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_folder(None, warehouse, "spark://host:7077")


def test_figures_are_taken_while_a_table_is_written(spark, ratings):
    with Workspace(spark) as space:
        kept, figures = space.stage_observed(ratings, "ratings", rows=F.count("*"), top=F.max("rating"))
        assert figures == {"rows": kept.count(), "top": 5.0}


def test_registered_queries_leave_the_dense_vectors_whole(spark):
    assert entry.queries()["dense_lsh_hashes"](spark, SF_DIR).count() % 8 == 0
