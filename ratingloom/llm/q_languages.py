"""Query op6: the language of every document, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.languages import identified, learn
from ratingloom.llm.tables import table


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = learn(docs.where(part != 2))
    found = identified(docs.select("doc_id", "text", F.coalesce(part == 2, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col("language.lang").alias("lang_pred"), "language.score", "language.rejected")


QUERIES = {"op6_languages": op6_languages}
SQL: dict[str, str] = {}
