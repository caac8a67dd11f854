from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException

import __spark_entry__ as entry
from ratingloom.plans.experiment import run_experiment
from ratingloom.operators.split import hash_split
from ratingloom.schema import RATINGS, SUMMARY
from ratingloom.sources.ratings_files import convert_all, convert_dat, dataset_path, load_ratings, read_ratings_csv, read_ratings_dat
from ratingloom.sources.summaries import append_summary, read_summary, summary_row

TWO_LINES = "1::1193::5::978300760\n1::661::3::978302109\n"


def test_raw_lines_and_their_conversion(spark, tmp_path):
    source = tmp_path / "ratings.dat"
    source.write_text(TWO_LINES)
    raw = sorted(map(tuple, read_ratings_dat(spark, str(source)).collect()))
    assert raw == [(1, 661, 3.0, 978302109), (1, 1193, 5.0, 978300760)]
    convert_dat(spark, str(source), str(tmp_path / "out"))
    header = next((tmp_path / "out").glob("part-*")).read_text().splitlines()[0]
    assert header == "userId,movieId,rating,timestamp"


def test_all_named_datasets_are_converted_and_missing_ones_skipped(spark, tmp_path):
    for folder in ("ml-1m", "ml-10m"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "ratings.dat").write_text(TWO_LINES)
    assert convert_all(spark, str(tmp_path)) == ["ml-1m", "ml-10m"]
    found = load_ratings(spark, "ml-1m", str(tmp_path))
    assert found.schema.names == RATINGS.names
    assert sorted(map(tuple, found.collect())) == [(1, 661, 3.0), (1, 1193, 5.0)]
    with pytest.raises(AnalysisException):  # the targets exist now
        convert_all(spark, str(tmp_path))


def test_unknown_and_missing_datasets(spark, tmp_path):
    with pytest.raises(ValueError, match="unknown dataset"):
        dataset_path("ml-2m")
    with pytest.raises(AnalysisException) as error:
        load_ratings(spark, "small", str(tmp_path))
    assert error.value.getCondition() == "PATH_NOT_FOUND"


def test_summary_rows_of_all_methods_line_up(spark, tmp_path):
    out = str(tmp_path / "summary")
    append_summary(summary_row(spark, {"Dataset": "a", "Clustering": "KMeans (k=96)", "RMSE": 0.5}), out)
    append_summary(summary_row(spark, {"Dataset": "b", "Num Hash Tables": 8, "RMSE": 0.25}), out)
    first, second = read_summary(spark, out).orderBy("Dataset").collect()
    assert (first["Clustering"], first["Num Hash Tables"], first["RMSE"]) == ("KMeans (k=96)", None, 0.5)
    assert (second["Clustering"], second["Num Hash Tables"], second["RMSE"]) == (None, 8, 0.25)
    with pytest.raises(ValueError, match="not a summary column"):
        summary_row(spark, {"Other": 1})


def test_experiments_append_their_rows(spark, tmp_path):
    out = str(tmp_path / "runs")
    ratings = entry.order_ratings(spark, "/root/testdata/sf0.001", "l_suppkey")
    run_experiment(spark, ratings, "lsh", {"max_distance": 1.25, "num_hash_tables": 4}, out, "orders")
    run_experiment(spark, ratings, "cluster", {"k": 3, "max_iter": 2}, out, "orders")
    rows = {r["Similarity"]: r for r in read_summary(spark, out).collect()}
    assert rows["Cosine (approximated with LSH)"]["Similarity Threshold"] == 1.25
    assert rows["Cosine (within cluster)"]["Clustering"] == "KMeans (k=3)"
    for row in rows.values():
        assert (row["Train Size"], row["Test Size"]) == (1314, 130)
        assert 0 < row["Scored Rows"] <= 144 and row["Execution Time (s)"] > 0 and row["RMSE"] >= row["MAE"]
    assert read_summary(spark, out).schema.names == SUMMARY.names
    with pytest.raises(ValueError, match="unknown method"):
        run_experiment(spark, ratings, "other")


def test_columns_are_read_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("movieId,timestamp,userId,rating\n7,1,2,4.5\n")
    assert [tuple(r) for r in read_ratings_csv(spark, str(tmp_path / "a.csv")).collect()] == [(2, 7, 4.5)]
    (tmp_path / "b.csv").write_text("userId,rating\n2,4.5\n")
    with pytest.raises(ValueError, match="movieId"):
        read_ratings_csv(spark, str(tmp_path / "b.csv"))


@pytest.mark.parametrize("line", ["abc::2::4::100", "1::7"])
def test_lines_that_do_not_fit_are_errors(spark, tmp_path, line):
    (tmp_path / "r.dat").write_text(f"1::2::3::4\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        convert_dat(spark, str(tmp_path / "r.dat"), str(tmp_path / "out"))


def test_split_seeds_differ(spark):
    rows = spark.range(40_000).selectExpr("id % 400 AS userId", "id DIV 400 AS itemId", "1.0D AS rating")
    held = [{(r["userId"], r["itemId"]) for r in hash_split(rows, seed)[1].collect()} for seed in (42, 52)]
    assert all(3_700 < len(h) < 4_300 for h in held)
    assert len(held[0] & held[1]) < 500
    users = [sum(1 for u, i in held[0] if i == item) for item in range(20)]
    assert all(15 < n < 70 for n in users)
