"""Query op3: the 20 nearest found of every twentieth vector."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm.neighbours import build, search, usable
from ratingloom.llm.tables import table
from ratingloom.staging import Workspace


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    index = build(vectors, Workspace(spark), wanted=20)
    return search(index, usable(vectors).where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), k=20)


QUERIES = {"op3_neighbours": op3_neighbours}
SQL: dict[str, str] = {}
