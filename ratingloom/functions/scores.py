"""Scalar formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance_to_cosine(distance: Column) -> Column:
    """Cosine of two unit vectors at the given Euclidean distance."""
    return F.lit(1.0) - F.pow(distance, F.lit(2.0)) / 2


def cosine_to_distance(cosine: Column) -> Column:
    """Euclidean distance of two unit vectors with the given cosine."""
    return F.sqrt(F.greatest(F.lit(2.0) - cosine * 2, F.lit(0.0)))


def weighted_mean(weighted_sum: Column, weight: Column) -> Column:
    """``weighted_sum / weight``, or null when there is no positive weight."""
    return F.when(weight > 0, weighted_sum / weight)


def default_cluster_count(n_items: Column) -> Column:
    """Square root of the item count, kept within 10 and 100."""
    root = F.floor(F.sqrt(n_items.cast("double")))
    return F.greatest(F.lit(10), F.least(F.lit(100), root)).cast("int")
