"""Train/test split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.hashing import mixed


def is_test(seed: int = 42, tenths: int = 1) -> Column:
    """True for about ``tenths`` out of ten rows; depends on the row's key and the seed only.

    The user is mixed with the seed and the item with the result, so neither neighbouring ids nor neighbouring seeds go together.
    """
    user = F.transform(F.array("userId"), lambda u: mixed(u, 2 * seed))
    both = F.transform(user, lambda h: mixed(h + F.pmod("itemId", F.lit(1 << 31)), 2 * seed + 1))
    return F.get(both, F.lit(0)) % 10 < tenths


def hash_split(ratings: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """90/10 split by key. Rerunning a lost task or changing the partitioning moves no row."""
    held_out = is_test(seed)
    # Rows without a key are on neither side; said openly, the scan can leave them out.
    keyed = ratings.where(F.col("userId").isNotNull() & F.col("itemId").isNotNull())
    return keyed.where(~held_out), keyed.where(held_out)


def random_split(
    ratings: DataFrame, weights: tuple[float, float] = (0.9, 0.1), seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Spark's sampled split. Its rows depend on the partitioning of the input."""
    train, test = ratings.randomSplit(list(weights), seed=seed)
    return train, test


def split_sizes(ratings: DataFrame, seed: int = 42) -> DataFrame:
    return ratings.groupBy(is_test(seed).alias("is_test")).agg(F.count("*").alias("n_rows"))
