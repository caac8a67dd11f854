"""Ratings derived from order lines: a customer rates a part or a supplier by quantity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.sources.ratings_files import canonical_ratings


def order_lines(spark: SparkSession, sf_dir: str, item: str = "l_partkey") -> DataFrame:
    """One row per order line: ``userId, itemId, rating, ts``."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("o_custkey").cast("bigint").alias("userId"),
        F.col(item).cast("bigint").alias("itemId"),
        (F.ceil(F.col("l_quantity") / 5).cast("double") / 2).alias("rating"),
        (F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400).alias("ts"),
    )


def order_ratings(spark: SparkSession, sf_dir: str, item: str = "l_partkey") -> DataFrame:
    return canonical_ratings(order_lines(spark, sf_dir, item))
