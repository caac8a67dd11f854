"""Sums that do not depend on the order of their rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits of a term: 16 after the point, 22 before it. Sums of decimals are exact, so any partitioning, merge order
# or retry gives the same bits.
TERM = "decimal(38, 16)"


def exact_sum(value: Column) -> Column:
    """Sum of finite doubles, each rounded to 16 decimals."""
    return F.sum(value.cast(TERM)).cast("double")


def exact_mean(value: Column) -> Column:
    return exact_sum(value) / F.count(value)
