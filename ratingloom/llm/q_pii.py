"""Query op9: personal data in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.pii import BASE_KINDS, learn, spans, written
from ratingloom.llm.tables import table


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", spans(F.col("text"), learn(docs)).alias("found"))
    base = F.filter("found", lambda s: s["base"])
    of = lambda kind: F.size(F.filter("found", lambda s: s["base"] & (s["kind"] == BASE_KINDS.index(kind)))).cast("long")
    return found.select(
        "doc_id",
        *[of(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("found")).alias("spans"),
    )


QUERIES = {"op9_pii": op9_pii}
SQL: dict[str, str] = {}
