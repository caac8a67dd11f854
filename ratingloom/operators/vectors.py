"""Items as sparse vectors with one dimension per user.

An item may hold a third of all ratings, so its vector is never one value: it is kept as slices
of ``width`` consecutive user ids, and a row holds at most ``width`` entries however popular the
item is. Norms and dot products are sums over slices, so nothing needs a whole vector.
"""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_WIDTH = 65536


def item_user_ratings(ratings: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Per item and slice, the array of ``(userId, rating)`` sorted by user."""
    entry = F.struct("userId", "rating")
    return ratings.groupBy("itemId", F.floor(F.col("userId") / width).cast("bigint").alias("slice")).agg(
        F.array_sort(F.collect_list(entry)).alias("user_ratings")
    )


def item_vectors(ratings: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """``itemId, slice, indices, values``: sparse slices, indices counted from the slice start."""
    sliced = item_user_ratings(ratings, width)
    start = F.col("slice") * width
    return sliced.select(
        "itemId",
        "slice",
        F.transform("user_ratings", lambda e: (e["userId"] - start).cast("int")).alias("indices"),
        F.transform("user_ratings", lambda e: e["rating"]).alias("values"),
    )


def item_norms(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("itemId").agg(F.sqrt(F.sum(F.col("rating") * F.col("rating"))).alias("norm"))


def normalized_item_vectors(vectors: DataFrame) -> DataFrame:
    """Slices scaled so that each whole item has length one; an all-zero item stays all-zero."""
    square = F.aggregate("values", F.lit(0.0), lambda total, v: total + v * v)
    norms = vectors.groupBy("itemId").agg(F.sqrt(F.sum(square)).alias("norm"))
    scaled = F.transform("values", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(v))
    return vectors.join(norms, "itemId").select("itemId", "slice", "indices", scaled.alias("values"))


def vector_entries(vectors: DataFrame, width: int = SLICE_WIDTH) -> DataFrame:
    """Slices back to one row per entry: ``itemId, idx, value``."""
    entry = F.explode(F.arrays_zip("indices", "values")).alias("e")
    return vectors.select("itemId", "slice", entry).select(
        "itemId",
        (F.col("slice") * width + F.col("e.indices")).alias("idx"),
        F.col("e.values").alias("value"),
    )


def ml_vectors(vectors: DataFrame, width: int = SLICE_WIDTH, column: str = "features") -> DataFrame:
    """The slices as ML sparse vectors of size ``width``, built without Python workers."""
    as_json = F.to_json(
        F.struct(F.lit(0).alias("type"), F.lit(width).alias("size"), "indices", "values")
    )
    holder = T.StructType([T.StructField("v", VectorUDT())])
    wrapped = F.from_json(F.concat(F.lit('{"v":'), as_json, F.lit("}")), holder)
    return vectors.select("itemId", "slice", wrapped["v"].alias(column))
