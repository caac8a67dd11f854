"""Pairs of items rated by one user, without a hot task for a hot user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A user's items are cut into blocks of about this many; one task joins two blocks at most.
BLOCK_ITEMS = 1024


def largest_user(rated: DataFrame) -> int:
    """Most items of any one user (a grouped count; one number reaches the driver)."""
    return rated.groupBy("userId").count().agg(F.max("count")).first()[0] or 0


def corated(
    rated: DataFrame,
    carry: list[str],
    *,
    within: list[str] | None = None,
    block_items: int = BLOCK_ITEMS,
    max_items: int | None = None,
) -> DataFrame:
    """Join each user's items with each other, every unordered pair once.

    ``rated`` has ``userId, leader`` and the ``carry`` columns, which come back as ``a_*`` and
    ``b_*``; ``within`` adds columns that must be equal. A user with more than ``block_items``
    items (of equal ``within``) is cut into blocks by item hash and the blocks are paired as separate join keys, so the
    work of one user spreads over many tasks. ``max_items`` is the largest number of items of a
    user, or any bound above it, when it is known; if it fits one block, there are no blocks.
    """
    within = within or []
    if max_items is None:
        max_items = largest_user(rated)
    base = ["userId", *within]
    columns = [F.col(c) for c in ["leader", *carry]]

    def side(df: DataFrame, prefix: str, keys: list[str]) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(f"{prefix}_{c}") for c in ["leader", *carry]])

    if max_items <= block_items:
        plain = rated.select(*base, *columns)
        met = side(plain, "a", base).join(side(plain, "b", base), base)
        return met.where(F.col("a_leader") < F.col("b_leader"))

    blocks = rated.groupBy(*base).agg(F.ceil(F.count("*") / block_items).alias("n_blocks"))
    placed = rated.join(blocks, base).withColumn("block", F.pmod(F.xxhash64("leader"), F.col("n_blocks")))
    # The pair of blocks (x, y), x <= y, receives block x on the left and block y on the right.
    left = placed.withColumn("y", F.explode(F.sequence("block", F.col("n_blocks") - 1))).withColumn("x", F.col("block"))
    right = placed.withColumn("x", F.explode(F.sequence(F.lit(0).cast("bigint"), "block"))).withColumn("y", F.col("block"))
    keys = [*base, "x", "y"]
    met = side(left, "a", keys).join(side(right, "b", keys), keys)
    once: Column = (F.col("x") < F.col("y")) | (F.col("a_leader") < F.col("b_leader"))
    ordered = F.col("a_leader") < F.col("b_leader")
    swapped = [
        F.when(ordered, F.col(f"{p}_{c}")).otherwise(F.col(f"{q}_{c}")).alias(f"{p}_{c}")
        for p, q in (("a", "b"), ("b", "a"))
        for c in ["leader", *carry]
    ]
    return met.where(once).select(*base, *swapped)


def met_between(
    left: DataFrame,
    right: DataFrame,
    carry: list[str],
    *,
    within: list[str] | None = None,
    block_items: int = BLOCK_ITEMS,
) -> DataFrame:
    """Each user's items of ``left`` with its other items of ``right``: ``a_*`` and ``b_*``, in this order.

    Both have ``userId, leader``, the ``within`` columns and ``carry``. A user is cut into blocks on either side, and
    every block of one meets every block of the other as a join key of its own.
    """
    base = ["userId", *(within or [])]

    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*base).agg(F.ceil(F.count("*") / block_items).cast("int").alias(name))

    # Only users on both sides matter, which also leaves out all others before they are shuffled by key.
    cut = blocks(left, "n_x").join(blocks(right, "n_y"), base)

    def side(df: DataFrame, prefix: str, own: str, other: str) -> DataFrame:
        placed = df.join(cut, base).withColumns(
            {
                own: F.pmod(F.xxhash64("leader"), F.col(f"n_{own}")).cast("int"),
                other: F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)),
            }
        )
        return placed.select(*base, "x", "y", *[F.col(c).alias(f"{prefix}_{c}") for c in ["leader", *carry]])

    met = side(left, "a", "x", "y").join(side(right, "b", "y", "x"), [*base, "x", "y"])
    return met.where(F.col("a_leader") != F.col("b_leader")).drop("x", "y")
