"""Deterministic pseudo-random columns.

Plain integer arithmetic below 2**63, so every engine, partitioning and retry gives the same
value. Two rounds of squaring modulo a prime break up the order of consecutive ids. The formulas
are SQL text over the name of an integer column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus (a Mersenne prime) and multipliers of the mixing rounds.
PRIME = 2147483647
SPREAD = 48271
SALT_SPREAD = 69621
ROUND_ONE = 7919
ROUND_TWO = 104729


def _mixed(key: str, salt: int) -> str:
    """Integer in [0, PRIME) that depends on ``key`` and ``salt``."""
    salt %= 1000003
    start = f"pmod(pmod({key}, {PRIME}L) * {SPREAD} + {salt * SALT_SPREAD + 12345}L, {PRIME}L)"
    once = f"(({start} * {start} + {start} * {ROUND_ONE} + {salt}) % {PRIME}L)"
    return f"(({once} * {once} + {once} * {ROUND_TWO} + 1) % {PRIME}L)"


def mixed(key: Column, salt: int) -> Column:
    """The same for a column: each round is a step of its own, so ``key`` is computed once."""
    salt %= 1000003
    prime = F.lit(PRIME).cast("bigint")

    def turn(h: Column, factor: int, add: int) -> Column:
        return (h * h + h * factor + add) % prime

    start = F.pmod(F.pmod(key, prime) * SPREAD + (salt * SALT_SPREAD + 12345), prime)
    once = F.transform(F.array(start), lambda h: turn(h, ROUND_ONE, salt))
    return F.get(F.transform(once, lambda h: turn(h, ROUND_TWO, 1)), F.lit(0))


def _uniform(key: str, salt: int) -> str:
    return f"((CAST({_mixed(key, salt)} AS DOUBLE) + 0.5D) / {float(PRIME)}D)"


def uniform(key: str, salt: int) -> Column:
    """Double in (0, 1)."""
    return F.expr(_uniform(key, salt))


def gaussian_sql(key: str, stream: int, seed: int) -> str:
    """Standard normal value of ``key`` in random stream ``stream`` (Box-Muller), as SQL text."""
    salt = seed * 1009 + 2 * stream
    radius = f"sqrt(-2.0D * ln({_uniform(key, salt)}))"
    return f"{radius} * cos({2.0 * math.pi!r}D * {_uniform(key, salt + 1)})"


def gaussian(key: str, stream: int, seed: int) -> Column:
    """The same as a column."""
    return F.expr(gaussian_sql(key, stream, seed))
