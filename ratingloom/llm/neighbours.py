"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node, named by their smallest id, with the smallest ids of its members. Vectors are lengthened by
one component so that all have the same norm; then nearness by inner product is nearness in space. Lists start from
chunks of rows ordered by random projections. In each round every node brings its neighbours and reverse neighbours together, each with its vector in
8 bits and the worst score of its list, and sends out the pairs that improve a list; only pairs with a new entry are tried. Rounds end when few lists
change. Queries walk the graph from the node of their vector, or, when it is not in the table, from entry nodes whose number grows
with the root of the nodes, always on from the best nodes not yet visited until none is left in the beam. The best nodes
found are scored exactly on the original vectors.

Rows whose vector is null, zero, holds null or non-finite components, or is not of the commonest length take no part, nor do rows
without id. Of rows with one id the smallest vector counts. Ties go to the smaller id. With no more nodes than a list
holds the result is exact; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingloom.staging import Workspace, remove_path

LIST, SAMPLED, ROUNDS, ENOUGH = 40, 16, 10, 0.01
CHUNK, TABLES = 96, 3
BEAM, STEP, ENTRIES = 96, 16, 32
EDGES = "node long, neighbour long, score float, fresh boolean"


def _floats(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _bytes(column: pa.Array, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in column.to_pylist()]) if len(column) else np.zeros((0, 0), kind)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Columns vec_id and v of the rows that take part, one per id."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<float>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where((F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).groupBy("vec_id").agg(F.min("v").alias("v"))


@dataclass
class Index:
    """nodes: node, v, members; graph: node, neighbours."""

    nodes: DataFrame
    graph: DataFrame
    space: Workspace


def _best(rows: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Per node the ``keep`` best neighbours of all its rows, which follow one another; a known neighbour is not fresh."""
    waiting: list[pa.RecordBatch] = []

    def chosen(table: pa.Table) -> pa.RecordBatch:
        node, near, score, fresh = (np.array(table.column(c)) for c in ("node", "neighbour", "score", "fresh"))
        order = np.lexsort((fresh, near, node))
        node, near, score, fresh = node[order], near[order], score[order], fresh[order]
        one = np.append(True, (node[1:] != node[:-1]) | (near[1:] != near[:-1])) if len(node) else np.zeros(0, bool)
        node, near, score, fresh = node[one], near[one], score[one], fresh[one]
        order = np.lexsort((near, -score, node))
        node, near, score, fresh = node[order], near[order], score[order], fresh[order]
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, int)
        rank = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
        top = rank < keep
        return pa.RecordBatch.from_pydict({"node": node[top], "neighbour": near[top], "score": score[top], "fresh": fresh[top]})

    for batch in rows:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= 1 << 18:
            table = pa.Table.from_batches(waiting)
            last = table.column("node")[-1].as_py()
            cut = int(np.searchsorted(np.array(table.column("node")), last))
            if cut:
                yield chosen(table.slice(0, cut))
            waiting = table.slice(cut).to_batches()
    if waiting:
        yield chosen(pa.Table.from_batches(waiting))


def _top(edges: DataFrame, keep: int) -> DataFrame:
    rows = edges.repartition("node").sortWithinPartitions("node")
    return rows.mapInArrow(lambda b: _best(b, keep), EDGES)


def _start(nodes: DataFrame, seed: int) -> DataFrame:
    """First lists: the best of chunks of rows that are neighbours in the order of random projections."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _bytes(batch.column(1), "<f4")
            if not len(x):
                continue
            lines = np.random.default_rng(seed).normal(size=(x.shape[1], 17)).astype(np.float32)
            p = x @ lines
            code = ((p[:, :16] > 0) << np.arange(16)).sum(1)
            yield pa.RecordBatch.from_pydict({"code": code.astype(np.int64), "along": p[:, 16].astype(np.float64), "node": batch.column(0), "x": batch.column(1)})

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                node, x = part.column(2).to_numpy(), _bytes(part.column(3), "<f4")
                score = x @ x.T
                np.fill_diagonal(score, -np.inf)
                k = min(LIST // 2, len(node) - 1)
                if k < 1:
                    continue
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": np.repeat(node, k),
                        "neighbour": node[best].ravel(),
                        "score": np.take_along_axis(score, best, 1).ravel().astype(np.float32),
                        "fresh": np.ones(len(node) * k, bool),
                    }
                )

    rows = nodes.select("node", "x").mapInArrow(placed, "code long, along double, node long, x binary")
    return rows.repartitionByRange("code", "along").sortWithinPartitions("code", "along", "node").mapInArrow(near, EDGES)


def _round(graph: DataFrame, nodes: DataFrame, number: int) -> tuple[DataFrame, DataFrame]:
    """Entries with those of this round marked as used, and better neighbours found at common neighbours."""
    draw = F.xxhash64("node", "neighbour", F.lit(number))
    ranked = graph.withColumn("r", F.row_number().over(Window.partitionBy("node", "fresh").orderBy(draw, "neighbour")))
    used = ranked.withColumn("now", F.col("fresh") & (F.col("r") <= SAMPLED))
    kept = used.select("node", "neighbour", "score", (F.col("fresh") & ~F.col("now")).alias("fresh"))
    active = used.where(f"r <= {SAMPLED}").select("node", "neighbour", "now")
    back = active.select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"), "now")
    back = back.withColumn("r", F.row_number().over(Window.partitionBy("node", "now").orderBy(draw, "neighbour"))).where(f"r <= {SAMPLED}").drop("r")
    meetings = active.unionByName(back).groupBy("node", "neighbour").agg(F.max("now").alias("now"))
    worst = graph.groupBy("node").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    worst = worst.select("node", F.when(F.col("n") >= LIST, F.col("least")).otherwise(F.lit(-1e30).cast("float")).alias("least"))
    small = nodes.join(worst, "node", "left").select(F.col("node").alias("neighbour"), "q", "scale", F.coalesce("least", F.lit(-1e30).cast("float")).alias("least"))
    gathered = (
        meetings.join(small, "neighbour")
        .groupBy("node")
        .agg(F.collect_list(F.struct("neighbour", "now", "q", "scale", "least")).alias("all"))
        .where(F.exists("all", lambda e: e["now"]))
        .select("all")
    )  # a list holds at most 4 * SAMPLED entries

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            lists = batch.column(0)
            flat = lists.flatten()
            name, now = flat.field("neighbour").to_numpy(), flat.field("now").to_numpy(zero_copy_only=False)
            x = _bytes(flat.field("q"), "i1").astype(np.float32) * flat.field("scale").to_numpy()[:, None]
            least = flat.field("least").to_numpy()
            edges = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                new = a + np.flatnonzero(now[a:b])
                score = x[new] @ x[a:b].T
                bar = least[a:b]
                for mine, i, j in ((True, *np.nonzero(score > least[new][:, None])), (False, *np.nonzero(score > bar[None, :]))):
                    one, two = name[new[i]], name[a + j]
                    ok = one != two
                    found.append((one[ok], two[ok], score[i, j][ok]) if mine else (two[ok], one[ok], score[i, j][ok]))
            if found:
                node, near, score = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((near, node))
                one = np.append(True, (node[order][1:] != node[order][:-1]) | (near[order][1:] != near[order][:-1])) if len(order) else order.astype(bool)
                order = order[one]
                yield pa.RecordBatch.from_pydict({"node": node[order], "neighbour": near[order], "score": score[order].astype(np.float32), "fresh": np.ones(len(order), bool)})

    return kept, gathered.mapInArrow(local, EDGES)


def build(vectors: DataFrame, space: Workspace, wanted: int = 20) -> Index:
    """The graph of all usable vectors; ``wanted`` is the largest number of results a query may ask for."""
    v = usable(vectors)
    ranked = v.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(f"r <= {wanted + 1}")
    classes = ranked.groupBy("v").agg(F.min("vec_id").alias("node"), F.array_sort(F.collect_list("vec_id")).alias("members"))
    longest = classes.agg(F.max(F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))).first()[0] or 1.0

    def even(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _floats(batch.column(0)).astype(np.float64)
                last = np.sqrt(np.maximum(longest - (x * x).sum(1), 0))
                x = np.concatenate([x, last[:, None]], axis=1) / np.sqrt(longest)
                scale = np.abs(x).max(1) / 127
                q = np.rint(x / scale[:, None]).astype(np.int8)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": batch.column(1),
                        "v": batch.column(0),
                        "members": batch.column(2),
                        "x": pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary()),
                        "q": pa.array([r.tobytes() for r in q], pa.binary()),
                        "scale": scale.astype(np.float32),
                    }
                )

    schema = "node long, v array<float>, members array<long>, x binary, q binary, scale float"
    nodes = space.stage(classes.select("v", "node", "members").mapInArrow(even, schema), "nodes")
    n = nodes.count()
    starts = _start(nodes, 1)
    for seed in range(2, TABLES + 1):
        starts = starts.unionByName(_start(nodes, seed))
    graph = space.stage(_top(starts, LIST), "graph")
    for number in range(ROUNDS):
        kept, better = _round(graph, nodes, number)
        graph = space.stage(_top(kept.unionByName(better), LIST), "graph")
        if graph.where("fresh").count() <= ENOUGH * n * LIST:
            break
    lists = graph.groupBy("node").agg(F.collect_list("neighbour").alias("neighbours"))
    return Index(nodes, space.stage(lists, "lists"), space)


def search(index: Index, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """The ``k`` nearest found for rows of query_id and v: query_id, rank, vec_id, score; a query does not find its own id.

    Queries of one vector share a walk, named by their smallest id. A walk ends when every node of its beam has been visited.
    """
    space, spark = index.space, queries.sparkSession
    queries = space.stage(queries.select("query_id", "v"), "queries")
    nodes = index.nodes.select("node", "v", "members")
    walks = space.stage(queries.groupBy("v").agg(F.min("query_id").alias("walk")), "walks")
    own = walks.join(nodes.select("v", "node"), "v").select("walk", "node")
    entries = nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(max(ENTRIES, isqrt(nodes.count())))
    strangers = walks.join(nodes.select("v"), "v", "left_anti").select("walk")
    first = own.unionByName(strangers.join(entries.agg(F.collect_list("node").alias("e")), F.lit(True)).select("walk", F.explode("e").alias("node")))

    @F.arrow_udf("double")
    def inner(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array((_floats(x).astype(np.float64) * _floats(y).astype(np.float64)).sum(1))

    @F.arrow_udf("double")
    def rough(x: pa.Array, q: pa.Array, scale: pa.Array) -> pa.Array:
        vectors, short = _floats(x), _bytes(q, "i1")
        width = vectors.shape[1] if len(vectors) else 0
        return pa.array((vectors * short[:, :width]).sum(1) * scale.to_numpy().astype(np.float64))

    def scored(pairs: DataFrame) -> DataFrame:
        """Pairs of walk and node with their score on 8-bit vectors, in units of the longest vector."""
        near = pairs.join(index.nodes.select("node", "q", "scale"), "node")
        return near.join(walks, "walk").select("walk", "node", rough("v", "q", "scale").alias("score"))

    nearest = Window.partitionBy("walk").orderBy(F.desc("score"), "node")
    ahead = Window.partitionBy("walk", "visited").orderBy(F.desc("score"), "node")
    path = space.write(scored(first.distinct()).withColumn("visited", F.lit(False)).withColumn("open", F.lit(True)), "pool")
    pool, step = spark.read.parquet(path), ENTRIES
    while not pool.where("open").isEmpty():
        now = pool.where("open").withColumn("r", F.row_number().over(ahead))
        going = now.where(f"NOT visited AND r <= {step}")
        found = going.join(index.graph, "node").select("walk", F.explode("neighbours").alias("node")).distinct()
        found = found.join(now.select("walk", "node"), ["walk", "node"], "left_anti")
        seen = now.select("walk", "node", "score", (F.col("visited") | (F.col("r") <= step)).alias("visited"))
        both = seen.unionByName(scored(found).withColumn("visited", F.lit(False))).withColumn("r", F.row_number().over(nearest))
        both = both.where(f"r <= {beam + 2} OR visited").withColumn("open", F.max(~F.col("visited")).over(Window.partitionBy("walk")))
        moved = both.where(f"open OR r <= {beam + 2}").drop("r").unionByName(pool.where("NOT open"))
        old, path = path, space.write(moved, "pool")
        pool, step = spark.read.parquet(path), STEP
        remove_path(spark, old)
    exact = pool.where("visited").withColumn("r", F.row_number().over(nearest)).where(f"r <= {beam + 2}").select("walk", "node")
    exact = exact.join(nodes.withColumnRenamed("v", "w"), "node").join(walks, "walk").withColumn("score", inner("v", "w"))
    rows = exact.select("walk", "score", F.explode("members").alias("vec_id"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("walk").orderBy(F.desc("score"), "vec_id"))).where(f"r <= {k + 1}")
    lists = rows.groupBy("walk").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))  # k + 1 entries
    known = queries.join(walks.join(lists, "walk").select("v", "all"), "v").select("query_id", "all")
    others = F.slice(F.filter("all", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    out = known.select("query_id", F.posexplode(others).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "e.vec_id", "e.score")
