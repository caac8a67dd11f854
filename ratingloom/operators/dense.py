"""Vectors held as a column of arrays: norms, unit vectors and random-projection hashes without exploding them.

A vector that is null, or holds a null or a number that is not finite, has no unit vector and no hashes (null). An
all-zero vector stays as it is. Extra columns come through; a column of the result's name is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.hashing import gaussian_sql


def dot(x: Column, y: Column) -> Column:
    """Inner product in double precision, added up from the first element on."""
    products = F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, p: total + p)


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit(x: Column) -> Column:
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = _once(norm(x), lambda n: F.transform(x, lambda v: F.when(n > 0, v.cast("double") / n).otherwise(v.cast("double"))))
    return F.when(finite, scaled)


def unit_vectors(vectors: DataFrame, column: str, out: str = "unit") -> DataFrame:
    """``vectors`` with the column scaled to length one."""
    return vectors.withColumn(out, unit(F.col(column)))


def dense_lsh_hashes(
    vectors: DataFrame,
    column: str,
    dims: int,
    bucket_length: float = 1.5,
    num_hash_tables: int = 8,
    seed: int = 42,
    out: str = "hashes",
) -> DataFrame:
    """``vectors`` with the bucket of their unit vector's projection per table; null for vectors of other lengths.

    The directions are the same numbers that ``lsh_item_hashes`` gives users 0 … dims - 1. They are worked out once,
    as a scalar subquery of ``num_hash_tables`` arrays.
    """
    axes = [
        F.expr(f"transform(sequence(0, {dims - 1}), i -> {gaussian_sql('i', t, seed)})") for t in range(num_hash_tables)
    ]
    directions = vectors.sparkSession.range(1).select(F.array(*[unit(a) for a in axes]).alias("directions")).scalar()
    drawn = f"directions_{uuid.uuid4().hex}"
    hashes = _once(
        unit(F.col(column)),
        lambda u: F.when(u.isNotNull(), F.transform(drawn, lambda d: F.floor(dot(u, d) / bucket_length).cast("int"))),
    )
    hashed = vectors.withColumn(drawn, directions).withColumn(out, F.when(F.size(column) == dims, hashes))
    return hashed.drop(drawn)
