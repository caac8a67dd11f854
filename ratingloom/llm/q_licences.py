"""Query op4: licence phrases and labels of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.licences import scanned
from ratingloom.llm.tables import table


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), "l")
    return found.select(
        "doc_id",
        "l.n_words",
        F.size("l.base_starts").cast("long").alias("n_base"),
        F.array_min("l.base_starts").alias("first_word"),
        F.array_max("l.base_starts").alias("last_word"),
        "l.base_labels",
        "l.labels",
        "l.score",
    )


QUERIES = {"op4_licences": op4_licences}
SQL: dict[str, str] = {}
