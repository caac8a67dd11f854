"""Per-item facts that every neighbour search starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.operators.pairing import corated


def item_facts(train: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """``itemId, leader, copies, n_raters, norm2[, grp]``, one row per item with a non-zero vector.

    Items rated alike by exactly the same users are copies: they share every similarity. The
    smallest id among them (inside a group, if ``groups(itemId, grp)`` is given) leads, and pairs
    are first formed between leaders, so a mass of copies does not meet itself pair by pair; ``expand_pairs``
    gives the pairs of all items.
    Two independent 64-bit checksums over the (user, rating) set identify a vector; they combine
    on the map side, so a popular item is not gathered anywhere.
    """
    facts = (
        train.groupBy("itemId")
        .agg(
            F.count("*").alias("n_raters"),
            F.sum(F.col("rating") * F.col("rating")).alias("norm2"),
            F.expr("bit_xor(xxhash64(userId, rating))").alias("sum_a"),
            F.expr("bit_xor(xxhash64(rating, 1, userId))").alias("sum_b"),
        )
        .where("norm2 > 0")
    )
    same = ["n_raters", "sum_a", "sum_b"]
    kept = ["itemId", "leader", "copies", "n_raters", "norm2"]
    if groups is not None:
        facts = facts.join(groups.select("itemId", "grp"), "itemId")
        same, kept = same + ["grp"], kept + ["grp"]
    leaders = facts.groupBy(*same).agg(F.min("itemId").alias("leader"), F.count("*").alias("copies"))
    return facts.join(leaders, same).select(*kept)


def with_facts(train: DataFrame, facts: DataFrame) -> DataFrame:
    """Ratings with the facts of their item and the unit-vector weight ``rating / norm``."""
    return train.join(facts, "itemId").withColumn("weight", F.col("rating") / F.sqrt("norm2"))


def leader_weights(rated: DataFrame) -> DataFrame:
    """Unit-vector entries of the leaders: the vectors that similarities are computed on."""
    return rated.where(F.col("itemId") == F.col("leader"))


def owned_ratings(rated: DataFrame) -> DataFrame:
    """What each user rated, by leader: total rating and number of rated copies."""
    keys = ["userId", "leader"] + (["grp"] if "grp" in rated.columns else [])
    return rated.groupBy(*keys).agg(F.sum("rating").alias("rating_sum"), F.count("*").alias("n_owned"))


def expand_pairs(pairs: DataFrame, facts: DataFrame, **alike: Column) -> DataFrame:
    """Pairs of leaders ``i, j, ...`` as pairs of items (i < j), with the pairs inside every set of copies.

    ``alike`` gives the further columns of two copies, from columns of ``facts``. Sets of copies are cut into blocks like the
    items of a user, so a large set is spread over many tasks. Pairs that are marked ``alone`` have no copies and are not joined.
    """
    measures = [c for c in pairs.columns if c not in ("i", "j", "alone")]
    member = facts.where("copies > 1").select("leader", "itemId")
    if member.isEmpty():
        return pairs.select("i", "j", *measures)
    if "alone" in pairs.columns:
        single, pairs = pairs.where("alone").select("i", "j", *measures), pairs.where("NOT alone").drop("alone")
        return single.unionByName(_expanded(pairs, facts, measures, alike))
    return _expanded(pairs, facts, measures, alike)


def _expanded(pairs: DataFrame, facts: DataFrame, measures: list[str], alike: dict[str, Column]) -> DataFrame:
    member = facts.select("leader", "itemId")
    spread = pairs.join(member.select(F.col("leader").alias("i"), F.col("itemId").alias("a")), "i").join(
        member.select(F.col("leader").alias("j"), F.col("itemId").alias("b")), "j"
    )
    spread = spread.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"), *measures)
    sets = facts.where("copies > 1").select(
        F.col("leader").alias("userId"), F.col("itemId").alias("leader"), *[alike[m].alias(m) for m in measures]
    )
    same = corated(sets, measures).select(
        F.col("a_leader").alias("i"), F.col("b_leader").alias("j"), *[F.col(f"a_{m}").alias(m) for m in measures]
    )
    return spread.unionByName(same)
