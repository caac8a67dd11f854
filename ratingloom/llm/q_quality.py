"""Query op1: statistics of every document and whether it is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm.quality import judged, learn_rules
from ratingloom.llm.tables import table

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = judged(docs, learn_rules(docs, labels), "s")
    return found.select("doc_id", *[f"s.{c}" for c in COLUMNS])


QUERIES = {"op1_quality": op1_quality}
SQL: dict[str, str] = {}
