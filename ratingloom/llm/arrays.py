"""Column helpers for work inside one row: no Python workers, no shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[\x20\x09-\x0D]+"
BLOCK = 512
AROUND = 24


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often ``body`` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(count: Column) -> Column:
    """0 … count - 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def split_words(text: Column, white: str = WHITE) -> Column:
    """Words of a text; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), white), lambda w: w != "")


def running(lengths: Column) -> Column:
    """Sum of all earlier elements, for each element; blocks keep the work near-linear for long arrays."""
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("at"), F.lit(0).alias("total"))

    def block(b: Column) -> Column:
        return F.aggregate(
            F.slice(lengths, b + 1, F.lit(BLOCK)),
            start,
            lambda acc, x: F.struct(F.array_append(acc["at"], acc["total"]).alias("at"), (acc["total"] + x).alias("total")),
        )

    blocks = F.transform(
        F.when(F.size(lengths) > 0, F.sequence(F.lit(0), F.size(lengths) - 1, F.lit(BLOCK))).otherwise(empty), block
    )
    done = F.aggregate(
        blocks,
        F.struct(F.array().cast("array<array<int>>").alias("at"), F.lit(0).alias("total")),
        lambda acc, x: F.struct(
            F.array_append(acc["at"], F.transform(x["at"], lambda y: y + acc["total"])).alias("at"),
            (acc["total"] + x["total"]).alias("total"),
        ),
    )
    return F.flatten(done["at"])


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: value, start and end in characters, and the text around up to the next match."""
    found = let(
        F.struct(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
            F.split(text, pattern, -1).alias("rest"),
        ),
        lambda m: let(
            running(F.zip_with(F.slice(m["rest"], F.lit(1), F.size(m["value"])), m["value"], lambda r, v: F.length(r) + F.length(v))),
            lambda at: F.transform(
                m["value"],
                lambda v, i: let(
                    F.get(at, i) + F.length(F.get(m["rest"], i)),
                    lambda s: F.struct(
                        v.alias("value"),
                        s.alias("start"),
                        (s + F.length(v)).alias("end"),
                        F.right(F.get(m["rest"], i), F.lit(AROUND)).alias("before"),
                        F.left(F.get(m["rest"], i + 1), F.lit(1)).alias("after"),
                    ),
                ),
            ),
        ),
    )
    none = F.array().cast("array<struct<value:string,start:int,end:int,before:string,after:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(none)
