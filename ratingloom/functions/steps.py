"""Ratings and squared lengths as small whole numbers, where they are: arrays of them are a fraction of arrays of doubles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ratings are steps of a half as a rule, and sums of their squares steps of a quarter.
RATING_STEP, NORM_STEP = 0.5, 0.25


def in_steps(value: Column, step: float) -> Column:
    """Aggregate: true where every value is a whole number of steps, nulls aside."""
    return F.bool_and(value / step == F.floor(value / step))


@dataclass(frozen=True)
class Narrow:
    """How values are kept in arrays: as a number of steps of an integer type, or as they are. Nothing is rounded."""

    step: float = 1.0
    type: str = "double"

    def pack(self, value: Column) -> Column:
        return value if self.type == "double" else (value / self.step).cast(self.type)

    def unpack(self, value: Column) -> Column:
        return value if self.type == "double" else value * F.lit(self.step)


def narrow(fits: bool | None, largest: float | None, step: float) -> Narrow:
    """The smallest type that holds all values, of which ``largest`` is the largest size, if they are whole numbers of steps."""
    for bits, name in ((8, "tinyint"), (16, "smallint"), (32, "int")):
        if fits and largest / step < 2 ** (bits - 1):
            return Narrow(step, name)
    return Narrow()
