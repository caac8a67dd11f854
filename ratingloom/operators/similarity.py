"""Exact cosine similarity between item vectors."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.functions.steps import NORM_STEP, RATING_STEP, in_steps, narrow
from ratingloom.operators.items import expand_pairs, item_facts, leader_weights, with_facts
from ratingloom.operators.pairing import BLOCK_ITEMS, corated, largest_user
from ratingloom.staging import Workspace, in_turn, in_turns, stage

# Room for rounding in the bounds below; survivors are decided on exact dot products.
SLACK = 1e-9
# The order of users in the prefix filter: steps for each doubling of activity, and hash classes in each step.
STEPS, CLASSES = 8, 16
# Strong entries are joined where they make at most one in so many of the pairs of all entries.
PRUNED = 4
# Pairs that one partition adds up, and pairs whose lists are on disk at once where only few of them are kept.
REACH = 1 << 21
AT_ONCE = 1 << 30
# Wanted ids that a list is compared with; with more of them whole lists are unpacked.
KNOWN = 1024


def item_lists(weights: DataFrame, within: list[str], block_items: int, most: int) -> DataFrame:
    """``userId, block, n_blocks`` and arrays of every user's items in order of their ids, in blocks of about ``block_items`` if
    ``most`` is more. ``weights`` has ``j``, which becomes an array, and what else does: ``rating, norm, n_raters``.
    """
    base = ["userId", *within]
    if most > block_items:
        blocks = weights.groupBy(*base).agg(F.ceil(F.count("*") / block_items).cast("int").alias("n_blocks"))
        weights = weights.join(blocks, base).withColumn("block", F.pmod(F.xxhash64("leader"), F.col("n_blocks")).cast("int"))
    else:
        weights = weights.withColumns({"n_blocks": F.lit(1), "block": F.lit(0)})
    arrays = ["j", "rating", "norm", "n_raters"]
    listed = weights.groupBy(*base, "block", "n_blocks").agg(F.array_sort(F.collect_list(F.struct(*arrays))).alias("e"))
    return listed.select(*base, "block", "n_blocks", *[F.col(f"e.{c}").alias(c) for c in arrays])


def packed_pairs(
    left: DataFrame,
    right: DataFrame | None = None,
    within: list[str] | None = None,
    block_items: int = BLOCK_ITEMS,
    wanted: DataFrame | None = None,
) -> DataFrame:
    """``i, j, cosine_sim, alone`` of items with a common rater: i < j, or with ``right`` every i of ``left`` with every j of it.

    Each item i is sent the lists of what its raters rated, as arrays of the narrowest types that hold ids, ratings and
    lengths, and its partition unpacks them and adds up the pairs: no row per pair is shuffled. Blocks of a user's items are
    joined as keys of their own, and the lists for an item with very many raters are dealt out to slices by a hash of j.
    ``alone`` is true where neither item has copies. With ``wanted`` (``i, js``: lists of wanted j, any number for an i)
    other pairs may be left out, which are most as a rule.
    """
    return pairs_by_turn(left, right, within, block_items)(0, wanted)


def pairs_by_turn(
    left: DataFrame,
    right: DataFrame | None = None,
    within: list[str] | None = None,
    block_items: int = BLOCK_ITEMS,
    turns: int = 1,
    space: Workspace | None = None,
) -> Callable[[int, DataFrame | None], DataFrame]:
    """A function of the turn and ``wanted``: ``packed_pairs`` of the items i of that turn (``in_turn``).

    The lists of the users are written where there is more than one turn.
    """
    within = within or []
    both = left if right is None else left.unionByName(right)
    per_user = both.groupBy("userId", *within).agg(
        F.count("*").alias("n"), F.min("leader").alias("low"), F.max("leader").alias("high"),
        in_steps(F.col("rating"), RATING_STEP).alias("steps"), F.max(F.abs("rating")).alias("rating"), F.max("norm2").alias("norm2"),
    )
    load = per_user.agg(
        F.max("n").alias("most"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("square"),
        F.min("low").alias("low"), F.max("high").alias("high"),
        F.bool_and("steps").alias("steps"), F.max("rating").alias("rating"), F.max("norm2").alias("norm2"),
    ).first()
    most, square = load["most"] or 0, load["square"] or 0
    id_type = "int" if most and -(2**31) <= load["low"] and load["high"] < 2**31 else "bigint"
    rating, norm = narrow(load["steps"], load["rating"], RATING_STEP), narrow(load["steps"], load["norm2"], NORM_STEP)
    # The sign of the length, which is positive, tells whether there are copies.
    signed = F.when(F.col("copies") == 1, F.col("norm2")).otherwise(-F.col("norm2"))

    def lists_of(df: DataFrame) -> DataFrame:
        packed = {"j": F.col("leader").cast(id_type), "norm": norm.pack(signed), "rating": rating.pack(F.col("rating"))}
        return item_lists(df.withColumns(packed), within, block_items, most)

    lists, arrays = lists_of(left), ["j", "rating", "norm"]
    if right is None and most <= block_items:
        met = lists.withColumns({f"b_{c}": F.col(c) for c in arrays})
    else:
        facing = lists if right is None else lists_of(right)
        x = lists.withColumnRenamed("n_blocks", "n_x").withColumnRenamed("block", "x")
        y = facing.select(
            "userId", *within, F.col("block").alias("y"), F.col("n_blocks").alias("n_y"), *[F.col(c).alias(f"b_{c}") for c in arrays]
        )
        # How many blocks the other side has decides how often a block is sent.
        n_x, n_y = (df.select("userId", *within, n).distinct() for df, n in ((x, "n_x"), (y, "n_y")))
        x = x.join(n_y, ["userId", *within]).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("n_y") - 1))).drop("n_x", "n_y")
        y = y.join(n_x, ["userId", *within]).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("n_x") - 1))).drop("n_x", "n_y")
        met = x.join(y, ["userId", *within, "x", "y"])
    # The lists of an item are about its raters times the items of an average rater.
    raters = max(1, REACH * (load["n"] or 1) // max(square, 1))

    def in_slices(df: DataFrame, n_raters: Column) -> DataFrame:
        df = df.withColumn("slices", F.ceil(n_raters / raters).cast("int"))
        return df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def in_slice(j: Column) -> Column:
        return F.pmod(F.xxhash64(j.cast("bigint")), F.col("slices")) == F.col("slice")

    if turns > 1:
        met = stage(met, "lists", space)
    def of_slice(c: str) -> Column:
        some = F.filter(f"c_{c}", lambda _, at: in_slice(F.get("c_j", at)))
        return F.when(F.col("slices") == 1, F.col(f"c_{c}")).otherwise(some)

    parts = max(1, math.ceil(square / (2 if right is None else 1) / REACH / max(turns, 1)))

    def pairs(turn: int, wanted: DataFrame | None = None) -> DataFrame:
        each = met.select("*", F.posexplode("j").alias("at", "i")).where(in_turn(F.col("i").cast("bigint"), turn, turns))
        if right is None:
            # A list is in order of ids, so those above i are its end.
            before = F.col("at") + 1 if most <= block_items else F.size(F.filter("b_j", lambda j: j <= F.col("i")))
            # New names: where a column is replaced, a lambda beside it reads the new one.
            end = [F.slice(f"b_{c}", before + 1, F.size("b_j")).alias(f"c_{c}") for c in arrays]
            each = each.select("at", "i", "rating", "norm", "n_raters", *end)
        else:
            each = each.withColumnsRenamed({f"b_{c}": f"c_{c}" for c in arrays})
        each = in_slices(each.where(F.size("c_j") > 0), F.get("n_raters", "at"))
        each = each.select(
            F.col("i").cast("bigint").alias("i"),
            "slice",
            F.get("rating", "at").alias("a_rating"),
            F.get("norm", "at").alias("a_norm"),
            *[of_slice(c).alias(c) for c in arrays],
        )
        sent, entries = each.where(F.size("j") > 0).repartition(parts, "i", "slice"), F.arrays_zip(*arrays)
        if wanted is not None:
            sizes = left.groupBy(F.col("leader").alias("i")).agg(F.max("n_raters").alias("n_raters"))
            known = in_slices(wanted.join(sizes, "i"), F.col("n_raters"))
            some = F.when(F.col("slices") == 1, F.col("js")).otherwise(F.filter("js", in_slice))
            known = known.select("i", "slice", some.cast(f"array<{id_type}>").alias("js")).repartition(parts, "i", "slice")
            known = known.groupBy("i", "slice").agg(F.array_distinct(F.flatten(F.collect_list("js"))).alias("known"))
            # A list is compared with a few ids, and unpacked as a whole where there are many.
            known = known.select("i", "slice", F.when(F.size("known") <= KNOWN, F.col("known")).alias("known"))

            def entry(j: Column) -> Column:
                at = (F.array_position("j", j) - 1).cast("int")
                return F.struct(j.alias("j"), F.get("rating", at).alias("rating"), F.get("norm", at).alias("norm"))

            sent = sent.join(known.hint("shuffle_hash"), ["i", "slice"])
            entries = F.when(F.col("known").isNull(), entries).otherwise(F.transform(F.array_intersect("known", "j"), entry))
        each = sent.withColumn("b", F.explode(entries)).select(
            "i",
            "slice",
            F.col("b.j").alias("j"),
            rating.unpack(F.col("a_rating")).alias("a_rating"),
            rating.unpack(F.col("b.rating")).alias("b_rating"),
            F.abs(norm.unpack(F.col("a_norm"))).alias("a_norm2"),
            F.abs(norm.unpack(F.col("b.norm"))).alias("b_norm2"),
            ((F.col("a_norm") > 0) & (F.col("b.norm") > 0)).alias("alone"),
        )
        # The rows of a pair lie in one partition already.
        sums = each.where("i <> j").groupBy("i", "slice", "j")
        sums = sums.agg(rating_cosine().alias("cosine_sim"), F.first("alone").alias("alone"))
        return sums.select("i", F.col("j").cast("bigint").alias("j"), "cosine_sim", "alone")

    return pairs


def pair_cosines(weights: DataFrame, within: list[str] | None = None, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``i, j, cosine_sim`` (i < j) of all pairs of leaders with a common rater."""
    return packed_pairs(weights, None, within, block_items).drop("alone")


def near_pairs(weights: DataFrame, min_cosine: float, block_items: int = BLOCK_ITEMS, work: int | None = None) -> DataFrame:
    """``i, j, cosine_sim`` of all pairs of leaders with a cosine above ``min_cosine``, of all pairs with a common rater.

    The lists of very many pairs are sent in turns, of which only the near pairs are kept.
    """
    turns = math.ceil((pair_work(weights) if work is None else work) / AT_ONCE)
    pairs = pairs_by_turn(weights, None, None, block_items, turns)
    return in_turns(turns, "near", lambda turn: pairs(turn).drop("alone").where(F.col("cosine_sim") > min_cosine))


def rating_cosine() -> Column:
    """Cosine of two items over their ``a_*`` and ``b_*`` rows: sums of products of ratings, then one division.

    Products of ratings in steps of a half are added up without rounding, so the order of the rows does not matter.
    """
    dots = F.sum(F.col("a_rating") * F.col("b_rating"))
    return dots / F.sqrt(F.max("a_norm2") * F.max("b_norm2"))


def item_cosine(train: DataFrame) -> DataFrame:
    """Cosine of all pairs of items that have a common rater, each pair once; copies have cosine 1."""
    facts = stage(item_facts(train), "facts")
    weights = leader_weights(with_facts(train, facts))
    return expand_pairs(packed_pairs(weights), facts, cosine_sim=F.lit(1.0))


def within_group_pairs(train: DataFrame, groups: DataFrame) -> DataFrame:
    """Candidate pairs inside a group: ``grp, i, j, n_common`` for pairs with a common rater.

    A pair without a common rater has similarity zero and weighs nothing in any prediction, so the
    full grid of a group is never formed.
    """
    facts = stage(item_facts(train, groups), "facts")
    met = corated(leader_weights(with_facts(train, facts)), [], within=["grp"], max_items=largest_user(train))
    pairs = met.groupBy("grp", F.col("a_leader").alias("i"), F.col("b_leader").alias("j")).agg(
        F.count("*").alias("n_common")
    )
    return expand_pairs(pairs, facts, grp=F.col("grp"), n_common=F.col("n_raters"))


def within_group_cosine(train: DataFrame, groups: DataFrame) -> DataFrame:
    """``i, j, cosine_sim`` of pairs inside a group that have a common rater."""
    facts = stage(item_facts(train, groups), "facts")
    weights = leader_weights(with_facts(train, facts))
    return expand_pairs(packed_pairs(weights, None, ["grp"]), facts, cosine_sim=F.lit(1.0))


def symmetric_similarities(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair, each exactly once."""
    measure = [c for c in pairs.columns if c not in ("i", "j")]
    swapped = pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), *measure)
    return pairs.select("i", "j", *measure).unionByName(swapped)


def strong_entries(weights: DataFrame, min_cosine: float) -> DataFrame:
    """Entries that two vectors must share to reach ``min_cosine``, with ``cutoff`` and ``tail``.

    Users are ranked by activity in eighths of a doubling, and within those by a hash of the user, so even users of
    equal activity have an order. From each vector the entries of the highest ranks are set aside for as long as their
    joint length (``tail``) stays below ``min_cosine``: what two unit vectors share only there cannot reach the
    threshold. So a very active user forms pairs only among the few items whose vector leans on that user.
    """
    step = F.floor(F.log2(F.count("*")) * STEPS).cast("int")
    activity = weights.groupBy("userId").agg(step.alias("step"))
    activity = activity.select("userId", (F.col("step") * CLASSES + F.pmod(F.xxhash64("userId"), F.lit(CLASSES))).cast("int").alias("rank"))
    ranked = weights.join(activity, "userId")
    energy = ranked.groupBy("leader", "rank").agg(F.coalesce(F.sum(F.col("weight") * F.col("weight")), F.lit(0.0)).alias("e"))
    # One entry per rank, so the array of an item holds 63 * STEPS * CLASSES = 8,064 values at most.
    steps = energy.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("r"), "e"))).alias("s"))
    open_end = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("tail"), F.lit(None).cast("int").alias("cutoff"))
    limit = F.lit(max(min_cosine, 0.0) ** 2)

    def walk(state, step):
        total = state["sum"] + step["e"]
        reached = state["cutoff"].isNotNull() | (total >= limit)
        return F.struct(
            total.alias("sum"),
            F.when(reached, state["tail"]).otherwise(total).alias("tail"),
            F.when(reached, F.coalesce(state["cutoff"], -step["r"])).alias("cutoff"),
        )

    cut = steps.select("leader", F.aggregate("s", open_end, walk).alias("c")).select(
        "leader", F.coalesce("c.cutoff", F.lit(0)).alias("cutoff"), F.sqrt("c.tail").alias("tail")
    )
    return ranked.join(cut, "leader").where(F.col("rank") <= F.col("cutoff")).drop("rank")


def similar_pairs(
    weights: DataFrame, min_cosine: float, block_items: int = BLOCK_ITEMS, prune_above: int = BLOCK_ITEMS
) -> DataFrame:
    """``i, j, cosine_sim`` of all pairs of leaders with a cosine above ``min_cosine``, exactly.

    All pairs of common raters are measured, unless the strong entries make far fewer of them (``PRUNED``): then pairs are
    met through shared strong entries, kept if partial sum plus bound can pass, and decided on the exact dot product of
    the whole vectors. While no user has more than ``prune_above`` items the shuffles that find strong entries are saved.
    """
    above = F.col("cosine_sim") > min_cosine
    most = largest_user(weights)
    if most <= prune_above:
        return near_pairs(weights, min_cosine, block_items)
    strong, work = stage(strong_entries(weights, min_cosine), "strong"), pair_work(weights)
    if PRUNED * pair_work(strong) > work:
        return near_pairs(weights, min_cosine, block_items, work)
    met = corated(strong, ["weight", "cutoff", "tail"], block_items=block_items, max_items=most)
    unseen = F.when(F.col("a_cutoff") <= F.col("b_cutoff"), F.col("a_tail")).otherwise(F.col("b_tail"))
    sums = met.groupBy(F.col("a_leader").alias("i"), F.col("b_leader").alias("j")).agg(
        F.sum(F.col("a_weight") * F.col("b_weight")).alias("partial"), F.max(unseen).alias("unseen")
    )
    kept = stage(sums.where(F.col("partial") + F.col("unseen") > min_cosine - SLACK).select("i", "j"), "candidates")
    # A candidate looks up all ratings of its shorter vector.
    raters = weights.groupBy("leader").count().agg(F.avg("count")).first()[0] or 0
    if kept.count() * raters > work:
        return near_pairs(weights, min_cosine, block_items, work)
    return exact_cosines(kept, weights).where(above)


def pair_work(weights: DataFrame) -> int:
    """Pairs of items that all users form: the rows that a join on common raters makes (one number reaches the driver)."""
    per_user = weights.groupBy("userId").agg(F.count("*").alias("n"))
    return per_user.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0


def exact_cosines(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """Cosine of given pairs of leaders from raw ratings: ``dot / sqrt(norm2 * norm2)``.

    Each pair reads the shorter of its two vectors and looks its users up in the longer one, so a
    pair with a very popular item costs no more than the other item has raters.
    """
    facts = weights.groupBy("leader").agg(F.max("n_raters").alias("n"), F.max("norm2").alias("norm2"))
    of_i = facts.select(F.col("leader").alias("i"), F.col("n").alias("n_i"), F.col("norm2").alias("norm2_i"))
    of_j = facts.select(F.col("leader").alias("j"), F.col("n").alias("n_j"), F.col("norm2").alias("norm2_j"))
    known = pairs.join(of_i, "i").join(of_j, "j")
    i_short = F.col("n_i") <= F.col("n_j")
    known = known.select(
        "i",
        "j",
        (F.col("norm2_i") * F.col("norm2_j")).alias("norm4"),
        F.when(i_short, F.col("i")).otherwise(F.col("j")).alias("short"),
        F.when(i_short, F.col("j")).otherwise(F.col("i")).alias("long"),
    )
    short = weights.select(F.col("leader").alias("short"), "userId", F.col("rating").alias("short_rating"))
    long = weights.select(F.col("leader").alias("long"), "userId", F.col("rating").alias("long_rating"))
    return (
        known.join(short, "short")
        .join(long, ["long", "userId"])
        .groupBy("i", "j", "norm4")
        .agg(F.sum(F.col("short_rating") * F.col("long_rating")).alias("dot"))
        .select("i", "j", (F.col("dot") / F.sqrt("norm4")).alias("cosine_sim"))
    )
