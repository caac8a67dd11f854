"""Predictions as similarity-weighted means of a user's own ratings.

For a test row (u, i) the wanted sums run over the items j that u rated and, through the cosine,
over the users v who rated both i and j:

    sum_j s(i, j) * r(u, j)  =  sum_j sum_v w(v, i) * w(v, j) * r(u, j)        over j other than i

They can be added up item pair by item pair (first over v) or user pair by user pair (first over
j). The first is cheap for users with few items, the second for users with very many, and both
give the same sums as long as no rating is negative. With negative ratings every user takes the first way, at every size.
A user's own training rating of the target never counts; copies of the target count with cosine 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ratingloom.functions.scores import weighted_mean
from ratingloom.functions.steps import RATING_STEP, Narrow, in_steps, narrow
from ratingloom.functions.sums import exact_sum
from ratingloom.operators.pairing import BLOCK_ITEMS, largest_user
from ratingloom.operators.similarity import KNOWN, exact_cosines, pair_cosines, pairs_by_turn
from ratingloom.staging import Workspace, in_turn, in_turns, stage

# Raters in one array, and raters in reach of the test users of one partition.
LIST_RATERS = 1024
REACH = 1 << 21
# Pairs, or raters in reach, whose lists are on disk at once.
AT_ONCE = 1 << 30

# Users with at most this many items are always handled item pair by item pair.
HEAVY_ITEMS = 2048

ROW = ["userId", "itemId", "actual_rating"]


def targets_of(test: DataFrame, facts: DataFrame, train: DataFrame) -> DataFrame:
    """Test rows with the leader of their item and the user's own training rating of it, if there is one.

    Items unknown to the training side drop out. ``own_rating`` and ``own_n`` are 0 without an own rating.
    """
    kept = ["itemId", "leader"] + (["grp"] if "grp" in facts.columns else [])
    own = train.select("userId", "itemId", F.col("rating").alias("own_rating"), F.lit(1).cast("bigint").alias("own_n"))
    known = test.withColumnRenamed("rating", "actual_rating").join(facts.select(*kept), "itemId")
    return known.join(own, ["userId", "itemId"], "left").fillna({"own_rating": 0.0, "own_n": 0})


def neighbor_ratings(
    targets: DataFrame,
    similarities: DataFrame,
    owned: DataFrame,
    heavy_items: int = HEAVY_ITEMS,
    max_items: int | None = None,
    sparse: bool = False,
) -> DataFrame:
    """Each test row with every similar item its user rated, and with the copies of its own item.

    ``similarities`` is symmetric (``i, j, cosine_sim``). ``owned`` has ``userId, leader`` and its
    further columns come through. Users with few items meet their own items first and look the
    similarity up; for users with very many items the neighbours of the target come first, so no
    user's test and training items are paired as a whole in one task. ``max_items`` is the largest
    number of items of a user, or a bound above it, when it is known. With ``sparse`` the neighbours come first for
    every user, as suits a table of few near pairs. Where ``targets`` and ``owned`` have ``grp``, similar items are of one
    group, and only what a user owns in the group of the target is met.
    """
    within = ["grp"] if "grp" in targets.columns and "grp" in owned.columns else []
    extra = [c for c in owned.columns if c not in ("userId", "leader", "grp")]
    mine = owned.select("userId", *within, F.col("leader").alias("j"), *[F.col(c).alias(f"neighbor_{c}") for c in extra])
    rows = targets.select(*ROW, *within, F.col("leader").alias("i"))
    own = ["userId", *within]
    out = [*ROW, "i", "j", "cosine_sim", *[f"neighbor_{c}" for c in extra]]
    alike = targets.select(*ROW, *within, "own_rating", "own_n", F.col("leader").alias("i"), F.col("leader").alias("j"))
    alike = alike.join(mine, [*own, "j"])
    alike = alike.withColumn("cosine_sim", F.lit(1.0))
    if "itemId" in extra:
        alike = alike.where(F.col("neighbor_itemId") != F.col("itemId"))
    else:
        alike = _without_own(alike, "neighbor_")
    alike = alike.select(*out)
    if sparse:
        near = rows.join(similarities, "i").join(mine, [*own, "j"])
        return near.select(*out).unionByName(alike)
    if max_items is None:
        max_items = largest_user(owned)
    if max_items <= heavy_items:
        return rows.join(mine, own).join(similarities, ["i", "j"]).select(*out).unionByName(alike)
    heavy = owned.groupBy("userId").count().where(F.col("count") > heavy_items).select("userId")
    few = rows.join(heavy, "userId", "left_anti").join(mine, own).join(similarities, ["i", "j"])
    many = rows.join(heavy, "userId", "left_semi").join(similarities, "i").join(mine, [*own, "j"])
    return few.select(*out).unionByName(many.select(*out)).unionByName(alike)


def _without_own(rows: DataFrame, prefix: str) -> DataFrame:
    """Take the own rating of the target out of what its user rated alike; rows with nothing left go."""
    left = rows.withColumns(
        {
            f"{prefix}rating_sum": F.col(f"{prefix}rating_sum") - F.col("own_rating"),
            f"{prefix}n_owned": F.col(f"{prefix}n_owned") - F.col("own_n"),
        }
    )
    return left.where(F.col(f"{prefix}n_owned") > 0)


def weighted_rating_sums(neighbors: DataFrame) -> DataFrame:
    """Per test row, the weighted rating sum and the similarity mass of its neighbours, whatever their order."""
    grouped = "neighbor_rating_sum" in neighbors.columns
    rating = F.col("neighbor_rating_sum" if grouped else "neighbor_rating")
    times = F.col("neighbor_n_owned") if grouped else F.lit(1)
    return neighbors.groupBy(*ROW).agg(
        exact_sum(F.col("cosine_sim") * rating).alias("weighted_rating_sum"),
        exact_sum(F.abs("cosine_sim") * times).alias("similarity_sum"),
    )


def predict_ratings(sums: DataFrame) -> DataFrame:
    """``userId, itemId, actual_rating, pred_rating`` of the rows that have a positive mass."""
    pred = weighted_mean(F.col("weighted_rating_sum"), F.col("similarity_sum"))
    return sums.where(F.col("similarity_sum") > 0).select(*ROW, pred.alias("pred_rating"))


def scored_predictions(predictions: DataFrame, test: DataFrame) -> DataFrame:
    """Attach the held-out rating to predictions that do not carry it."""
    actual = test.select("userId", "itemId", F.col("rating").alias("actual_rating"))
    return predictions.select("userId", "itemId", "pred_rating").join(actual, ["userId", "itemId"])


def all_neighbor_sums(
    targets: DataFrame,
    weights: DataFrame,
    owned: DataFrame,
    heavy_items: int = HEAVY_ITEMS,
    block_items: int = BLOCK_ITEMS,
    space: Workspace | None = None,
    plan: str | None = None,
) -> DataFrame:
    """``weighted_rating_sum, similarity_sum`` per test row over all items with a common rater.

    With a ``grp`` column the neighbours are those of the target's group. The result is the same as
    ``weighted_rating_sums`` over all similarities, without a similarity table for users who rated
    a large part of the items. ``plan`` is one of those of ``demand_plan``, or ``users``, by which all users are handled
    like heavy ones; without it the one with the fewest rows is taken.
    """
    within = ["grp"] if "grp" in weights.columns else []
    targets = stage(targets, "targets", space)  # small beside the training side, and read by every step
    load = user_load(weights, within)
    most, negative = load["most"], load["lowest"] < 0
    # Raters travel in lists, pairs as rows: as long as there are no more of the former, they are the smaller tables.
    if plan is None and not negative and load["reach"] <= load["pairs"] and demand_plan(targets, weights, owned, within) == "all":
        plan = "users"
    if plan == "users":
        if negative:
            raise ValueError("with negative ratings sums are added up item pair by item pair only")
        return _sums_by_user_pair(targets, weights, owned, within, load, space=space)
    if most <= heavy_items or negative:
        return _sums_in_turns(targets, weights, owned, within, block_items, load, plan, space)
    # Item pairs of a user number its items squared; the other way its items times their raters.
    heavy = stage(
        weights.groupBy("userId")
        .agg(F.count("*").alias("n"), F.sum("n_raters").alias("reach"))
        .where((F.col("n") > heavy_items) & (F.col("n") * F.col("n") > 2 * F.col("reach")))
        .select("userId"),
        "heavy-users",
        space,
    )

    def light_part(df: DataFrame) -> DataFrame:
        return df.join(heavy, "userId", "left_anti")

    light = light_part(targets), light_part(weights), light_part(owned)
    by_item = _sums_in_turns(*light, within, block_items, user_load(light[1], within), plan, space)
    by_user = _sums_by_user_pair(targets, weights, owned, within, load, heavy, space)
    return (
        by_item.unionByName(by_user)
        .groupBy(*ROW)
        .agg(F.sum("weighted_rating_sum").alias("weighted_rating_sum"), F.sum("similarity_sum").alias("similarity_sum"))
    )


def touched_cosines(
    targets: DataFrame, weights: DataFrame, owned: DataFrame, within: list[str], block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """``target, leader, cosine_sim`` between the targets and what test users own, from the ratings of these two only.

    All pairs of a target with what its test users own are there if they have a common rater, and some others may be.
    """
    return touched_by_turn(targets, weights, owned, within, block_items)(0)


def touched_by_turn(
    targets: DataFrame,
    weights: DataFrame,
    owned: DataFrame,
    within: list[str],
    block_items: int = BLOCK_ITEMS,
    turns: int = 1,
    space: Workspace | None = None,
) -> Callable[[int], DataFrame]:
    """A function of the turn: ``touched_cosines`` of the targets of that turn."""
    asked = targets.select("leader").distinct()
    offered = owned.join(targets.select("userId", *within).distinct(), ["userId", *within], "left_semi")
    left = weights.join(asked, "leader", "left_semi")
    right = weights.join(offered.select("leader").distinct(), "leader", "left_semi")
    pairs = pairs_by_turn(left, right, within, block_items, turns, space)
    # What a user owns, in lists that are sent to the items asked for.
    blocks = max(1, math.ceil(largest_user(offered) / block_items))
    cut = offered.groupBy("userId", *within, F.pmod(F.xxhash64("leader"), F.lit(blocks)).alias("block"))
    lists = cut.agg(F.collect_list("leader").alias("js")).drop("block")
    if turns > 1:
        lists = stage(lists, "owned-lists", space)

    def cosines(turn: int) -> DataFrame:
        some = targets.where(in_turn(F.col("leader"), turn, turns))
        wanted = some.select("userId", *within, F.col("leader").alias("i")).join(lists, ["userId", *within]).select("i", "js")
        return pairs(turn, wanted).select(F.col("i").alias("target"), F.col("j").alias("leader"), "cosine_sim")

    return cosines


def demand_plan(targets: DataFrame, weights: DataFrame, owned: DataFrame, within: list[str]) -> str:
    """How the cosines that ``targets`` ask for are found with the fewest rows: ``all``, ``touched`` or ``pairs``.

    ``all`` forms every pair of co-rated items, ``touched`` only those of a target with an item that a test user
    owns, ``pairs`` looks up the ratings of each wanted pair. While most items are asked for, all pairs are formed.
    """
    items = weights.select("leader").distinct().count()
    asked = targets.select("leader").distinct()
    if 2 * asked.count() > items:
        return "all"
    known = weights.join(asked.withColumn("asked", F.lit(1)), "leader", "left")
    per_user = known.groupBy("userId", *within).agg(F.count("*").alias("n"), F.count("asked").alias("asked"))
    work = per_user.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum(F.col("n") * F.col("asked"))).first()
    n_owned = owned.groupBy("userId", *within).count()
    raters = weights.groupBy("leader").agg(F.count("*").alias("raters"))
    wanted = targets.join(n_owned, ["userId", *within]).join(raters, "leader").agg(F.sum(F.col("count") * F.col("raters")))
    costs = dict(zip(("all", "touched", "pairs"), [*work, wanted.first()[0]], strict=True))
    return min(costs, key=lambda name: costs[name] or 0)


def _sums_in_turns(
    targets: DataFrame,
    weights: DataFrame,
    owned: DataFrame,
    within: list[str],
    block_items: int,
    load: Row,
    plan: str | None,
    space: Workspace | None,
) -> DataFrame:
    """Sums by item pairs; of very many pairs those of a part of the targets at a time, by which every test row is in one turn."""
    plan = plan or demand_plan(targets, weights, owned, within)
    # All pairs are each formed once, and from both ends where targets take turns.
    if plan == "all" and load["pairs"] > 2 * AT_ONCE:
        plan = "touched"
    if plan != "touched":
        return _sums_by_item_pair(targets, weights, owned, within, block_items, load["most"], plan)
    turns = math.ceil(load["pairs"] / AT_ONCE)
    if turns > 1:
        owned = stage(owned, "owned", space)
    cosines = touched_by_turn(targets, weights, owned, within, block_items, turns, space)

    def sums(turn: int) -> DataFrame:
        some = targets.where(in_turn(F.col("leader"), turn, turns))
        return _sums_by_item_pair(some, weights, owned, within, block_items, load["most"], plan, cosines(turn))

    return in_turns(turns, "sums", sums, space)


def _sums_by_item_pair(
    targets: DataFrame,
    weights: DataFrame,
    owned: DataFrame,
    within: list[str],
    block_items: int,
    most: int | None,
    plan: str | None = None,
    touched: DataFrame | None = None,
) -> DataFrame:
    # What two copies share of these weights: 1 when the weights are those of all users.
    alike = weights.join(targets.select("leader").distinct(), "leader", "left_semi").groupBy("leader")
    alike = alike.agg(F.sum(F.col("weight") * F.col("weight")).alias("cosine_sim"))
    rows = targets.select(*ROW, *within, "own_rating", "own_n", F.col("leader").alias("target"))
    met = rows.join(owned, ["userId", *within])
    other = met.where(F.col("target") != F.col("leader")).drop("own_rating", "own_n")
    same = _without_own(met.where(F.col("target") == F.col("leader")), "").drop("own_rating", "own_n")
    wanted = other.withColumnsRenamed({"rating_sum": "neighbor_rating_sum", "n_owned": "neighbor_n_owned"})
    copies = same.withColumnsRenamed({"rating_sum": "neighbor_rating_sum", "n_owned": "neighbor_n_owned"})
    copies = copies.join(alike, "leader")
    plan = plan or demand_plan(targets, weights, owned, within)
    if plan == "touched":
        if touched is None:
            touched = touched_cosines(targets, weights, owned, within, block_items)
        found = wanted.join(touched, ["target", "leader"])
    else:
        ordered = wanted.withColumns({"i": F.least("target", "leader"), "j": F.greatest("target", "leader")})
        if plan == "pairs":
            found = _wanted_pairs(rows, owned, ordered, weights, within)
        else:
            found = ordered.join(pair_cosines(weights, within, block_items), ["i", "j"])
    kept = [*ROW, "neighbor_rating_sum", "neighbor_n_owned", "cosine_sim"]
    return weighted_rating_sums(found.select(*kept).unionByName(copies.select(*kept)))


def _wanted_pairs(rows: DataFrame, owned: DataFrame, ordered: DataFrame, weights: DataFrame, within: list[str]) -> DataFrame:
    """The wanted pairs ``ordered`` that have a common rater, with ``cosine_sim``: ``rows`` met with what their user owns.

    The raters of an item travel to its users as one list, and two lists are compared where they meet: a list is sent as
    often as the item has users, and no row per rater of a pair is made. Pairs with an item of more than ``LIST_RATERS``
    raters look up the ratings of the other one.
    """
    known = weights.where("userId IS NOT NULL")
    lists, form = rater_lists(known.where(F.col("n_raters") <= LIST_RATERS), within)
    a, b = ([F.col(c).alias(f"{side}_{c}") for c in ("norm2", "others", "ratings")] for side in "ab")
    asked = rows.join(lists.select(F.col("via").alias("target"), *within, *a), ["target", *within])
    mine = owned.join(lists.select(F.col("via").alias("leader"), *within, *b), ["leader", *within])
    met = asked.drop("own_rating", "own_n").join(mine, ["userId", *within])
    met = met.where((F.col("target") != F.col("leader")) & F.arrays_overlap("a_others", "b_others"))

    def rating(side: str, user: Column) -> Column:
        return form.unpack(F.get(f"{side}_ratings", (F.array_position(f"{side}_others", user) - 1).cast("int")))

    common = F.array_intersect("a_others", "b_others")
    dot = F.aggregate(common, F.lit(0.0), lambda sum, user: sum + F.coalesce(rating("a", user) * rating("b", user), F.lit(0.0)))
    kept = [*ROW, F.col("rating_sum").alias("neighbor_rating_sum"), F.col("n_owned").alias("neighbor_n_owned")]
    found = met.select(*kept, (dot / F.sqrt(F.col("a_norm2") * F.col("b_norm2"))).alias("cosine_sim"))
    large = known.where(F.col("n_raters") > LIST_RATERS).select("leader").distinct()
    if large.isEmpty():
        return found
    for end in ("i", "j"):
        ordered = ordered.join(large.select(F.col("leader").alias(end), F.lit(True).alias(f"large_{end}")), end, "left")
    looked_up = ordered.where("large_i OR large_j")
    looked_up = looked_up.join(exact_cosines(looked_up.select("i", "j").distinct(), weights), ["i", "j"])
    return found.unionByName(looked_up.select(*found.columns))


def user_load(weights: DataFrame, within: list[str]) -> Row:
    """Figures of all users in one pass: ``most`` items of one, ``pairs`` of items both ways, raters in ``reach``, ``lowest`` weight.

    Copies are rated by the same users, so what a user owns by leader are the rows of ``weights``.
    """
    reach = F.sum("n_raters").alias("reach")
    per_group = weights.groupBy("userId", *within).agg(F.count("*").alias("n"), reach, F.min("weight").alias("low"))
    per_group = per_group.select("userId", "n", (F.col("n") * (F.col("n") - 1)).alias("pairs"), "reach", "low")
    per_user = per_group
    if within:
        per_user = per_group.groupBy("userId").agg(*[F.sum(c).alias(c) for c in ("n", "pairs", "reach")], F.min("low").alias("low"))
    return per_user.agg(
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("reach"), F.lit(0)).alias("reach"),
        F.coalesce(F.max("reach"), F.lit(0)).alias("most_reach"),
        F.coalesce(F.min("low"), F.lit(0.0)).alias("lowest"),
    ).first()


def rater_lists(weights: DataFrame, within: list[str]) -> tuple[DataFrame, Narrow]:
    """``via, norm2, others, ratings``: the raters of every leader as two arrays, in blocks of about ``LIST_RATERS``.

    Arrays in order of ratings, with ids of 32 bits and ratings as small whole numbers where they suffice, are a fraction of
    one row per rater. With them comes how the ratings are kept.
    """
    figures = weights.agg(F.min("userId"), F.max("userId"), in_steps(F.col("rating"), RATING_STEP), F.max(F.abs("rating")))
    low, high, *kept = figures.first()
    id_type = "int" if low is not None and -(2**31) <= low and high < 2**31 else "bigint"
    form = narrow(*kept, RATING_STEP)
    sizes = weights.groupBy("leader").agg(F.ceil(F.count("*") / LIST_RATERS).alias("n_lists"))
    rater = F.struct("rating", F.col("userId").cast(id_type).alias("other"))
    listed = (
        weights.join(sizes, "leader")
        .groupBy(F.col("leader").alias("via"), *within, "norm2", F.pmod(F.xxhash64("userId"), F.col("n_lists")).alias("list"))
        .agg(F.array_sort(F.collect_list(rater)).alias("raters"))
    )
    ratings = F.transform("raters.rating", form.pack).alias("ratings")
    return listed.select("via", *within, "norm2", F.col("raters.other").alias("others"), ratings), form


def _sums_by_user_pair(
    targets: DataFrame,
    weights: DataFrame,
    owned: DataFrame,
    within: list[str],
    load: Row,
    heavy: DataFrame | None = None,
    space: Workspace | None = None,
) -> DataFrame:
    """The part of the sums whose test user, or whose user in common, is in ``heavy``; without it the whole sums.

    No join meets a user with all its own items: the joins run on the item and bring whole lists of its raters to
    the test user, whose partition unpacks those raters that have rated an item asked for as well: no others count. The lists of
    a test user with very many raters in reach are dealt out by a hash of the rater to slices, which are added up at the end.
    With very many raters in reach test users take turns.
    """
    lists, form = rater_lists(weights, within)
    heavy_lists = None if heavy is None else rater_lists(weights.join(heavy, "userId", "left_semi"), within)[0]
    turns = math.ceil(load["reach"] / AT_ONCE)
    if turns > 1:
        lists, owned = stage(lists, "lists", space), stage(owned, "owned", space)
    reach = weights.groupBy("userId").agg(F.ceil(F.sum("n_raters") / REACH).cast("int").alias("slices"))
    # Partitions and slices are made to hold about as many raters each.
    parts = max(1, math.ceil(load["reach"] / REACH / max(turns, 1)))
    key = ["userId", "slice", *within]

    def sent(rows: DataFrame) -> DataFrame:
        if load["most_reach"] > REACH:
            rows = rows.join(reach, "userId", "left").fillna({"slices": 1})
        else:
            rows = rows.withColumn("slices", F.lit(1))
        if heavy is None:
            met = rows.join(lists, ["via", *within])
        else:
            met = rows.join(heavy, "userId", "left_semi").join(lists, ["via", *within])
            met = met.unionByName(rows.join(heavy, "userId", "left_anti").join(heavy_lists, ["via", *within]))
        met = met.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

        def in_slice(other: Column) -> Column:
            return F.pmod(F.xxhash64(other), F.col("slices")) == F.col("slice")

        # New names first: where a column is replaced, a lambda beside it reads the new one.
        some = {
            "some_others": F.filter("others", in_slice),
            "some_ratings": F.filter("ratings", lambda _, at: in_slice(F.get("others", at))),
        }
        cut = [F.when(F.col("slices") > 1, v).otherwise(F.col(c.removeprefix("some_"))).alias(c) for c, v in some.items()]
        met = met.select(*[c for c in met.columns if c not in ("others", "ratings")], *cut)
        met = met.withColumnsRenamed({c: c.removeprefix("some_") for c in some})
        return met.where(F.size("others") > 0).repartition(parts, *key)

    def sums(turn: int) -> DataFrame:
        some = targets.where(in_turn(F.col("userId"), turn, turns))
        testers = some.select("userId").distinct()
        kept = ["itemId", "actual_rating", "own_rating", "own_n"]
        # What a test user owns, and the test rows, which have no ratings of their own to add.
        mine = owned.join(testers, "userId", "left_semi").select(
            "userId", *within, F.col("leader").alias("via"), "rating_sum", "n_owned", *[F.lit(None).alias(c) for c in kept]
        )
        asked = some.select(
            "userId", *within, F.col("leader").alias("via"), F.lit(None).alias("rating_sum"), F.lit(None).alias("n_owned"), *kept
        )
        rows = mine.unionByName(asked.withColumn("asked", F.lit(True)), allowMissingColumns=True)
        known = sent(some.select("userId", *within, F.col("leader").alias("via"))).groupBy(*key)
        known = known.agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("known"))
        # A list is compared with a few raters, and unpacked as a whole where a test user has many of them.
        known = known.select(*key, F.when(F.size("known") <= KNOWN, F.col("known")).alias("known"))

        def rater(other: Column) -> Column:
            rating = F.get("ratings", (F.array_position("others", other) - 1).cast("int"))
            return F.struct(other.alias("others"), rating.alias("ratings"))

        shared = F.transform(F.array_intersect("known", "others"), rater)
        raters = F.when(F.col("known").isNull(), F.arrays_zip("others", "ratings")).otherwise(shared)
        each = (
            sent(rows)
            .join(known.hint("shuffle_hash"), key)
            .withColumn("rater", F.explode(raters))
            .withColumns({"other": F.col("rater.others"), "weight": form.unpack(F.col("rater.ratings")) / F.sqrt("norm2")})
        )
        # The rows of a test user and a rater lie in one partition already; added up in order of the items, they give the same bits.
        pair = Window.partitionBy("userId", "slice", "other", *within).orderBy("via")
        pair = pair.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        masses = {
            "rating_mass": F.sum(F.col("rating_sum") * F.col("weight")).over(pair),
            "mass": F.sum(F.col("n_owned") * F.col("weight")).over(pair),
        }
        return (
            each.withColumns(masses)
            .where("asked AND mass IS NOT NULL")
            .groupBy(*ROW)
            .agg(
                F.sum(F.col("weight") * (F.col("rating_mass") - F.col("own_rating") * F.col("weight"))).alias("weighted_rating_sum"),
                F.sum(F.col("weight") * (F.col("mass") - F.col("own_n") * F.col("weight"))).alias("similarity_sum"),
            )
        )

    return in_turns(turns, "sums", sums, space)
