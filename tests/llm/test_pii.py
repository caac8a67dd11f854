"""Personal data: rare kinds and large tables."""

from __future__ import annotations

import inspect

from pyspark.sql import functions as F

from ratingloom.llm.pii import learn, spans, written

NUMBER, SECRET, ADDRESS = "SSN: 123-45-6789.", "token=a1b2c3d4e5f6a7b8c9d0e1f2", "ann (at) mail.example.org"


def found(spark, rows: list[tuple[int, str]]) -> dict[int, str]:
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = docs.select("doc_id", written(spans(F.col("text"), learn(docs))).alias("s"))
    return {r["doc_id"]: r["s"] for r in made.where("s <> ''").collect()}


def test_one_span_of_a_kind_counts_wherever_its_document_falls(spark):
    rows = [(n, "nothing to see") for n in range(200)]
    for at in range(6):
        assert found(spark, [*rows, (1_000 + at, NUMBER)]) == {1_000 + at: "number:5:16"}
    assert found(spark, [*rows, (1_001, SECRET)]) == {1_001: "secret:6:30"}
    assert found(spark, [*rows, (1_002, ADDRESS)]) == {1_002: "email_at:0:25"}


def test_rare_spans_count_among_more_documents_than_the_former_sample(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("plain words").alias("text"))
    rare = spark.createDataFrame([(30_000 + n, t) for n, t in enumerate([NUMBER, SECRET, ADDRESS] * 4)], "doc_id long, text string")
    docs = many.unionByName(rare)
    got = docs.select(written(spans(F.col("text"), learn(docs))).alias("s")).where("s <> ''")
    assert got.count() == 12


def test_empty_and_null(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (None, NUMBER)]) == {None: "number:5:16"}
    assert "sample" not in inspect.signature(learn).parameters
