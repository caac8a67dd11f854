"""Connected components of a table of edges by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.staging import Workspace


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """``node`` and the smallest node it reaches, ``root``, for every node of the edges ``a``, ``b``.

    Each round hooks a node's larger neighbours to its smallest one, then its smaller ones, and writes the edges.
    A node's neighbours are never gathered; only minima are.
    """

    def hook(e: DataFrame, larger: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        side = both if larger else both.where("b < a")
        least = side.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        near = side.join(least, "a")
        moved = near.where("b > a" if larger else "b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        if not larger:
            moved = moved.unionByName(least.select("a", F.col("low").alias("b")))
        return moved.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now = space.stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen, now = mark, space.stage(hook(hook(now, True), False), "edges")
