"""Documents whose sets of word shingles have a Jaccard similarity of at least ``num / den``, as components.

Parity sketches. A set's sketch has one bit per hash value, on where an odd number of shingles fall, so the Hamming
distance of two sketches never exceeds the symmetric difference of the sets. Linked sets of ``a`` and ``b``
shingles differ by at most D = (a + b)(den - num) / (den + num). Within a size band the bit range is cut into more
chunks than D, so linked sets agree in one of ``D + 1`` chunks that are not empty; a chunk is joined on the
XOR of its bits' positions. Candidates are then filtered by the Hamming distance of folded sketches and verified on
the shingles.

* A document whose chunks are too few for the pigeonhole joins again at finer levels, where at last each shingle has its own chunk.
* Very common shingles (at most ``MOST_COMMON``, found by counts over all documents) are left out of the first
  level; leaving shingles out only lowers the difference.
* Equal sets are one class. The classes that share a chunk are a group; chunks with the same classes are one group, so
  a family of copies is one however many chunks it shares. No group is expanded into pairs: each member is first
  compared with the one that is in most groups, as a text is that the others were made from. Where the members of a
  group then lie in several components, those outside the most frequent one ask that whole component for a link,
  once however many groups they share with it; what is still apart is compared with all that asked in the group.

A-Z are lower-cased; words are runs of anything but space and 9-13. With fewer words than ``WORDS`` the whole sequence is the
one shingle; null and blank texts have an empty set and no links. Repeated rows are of one class. Rows without id
are linked too, but only ids name a component. Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import first_of_runs, slices
from ratingloom.llm.components import components
from ratingloom.llm.tables import mix, per_process, ragged, text_bytes, tidy
from ratingloom.llm.wordhash import SpanHasher, grams, inside, words
from ratingloom.staging import Workspace

WORDS = 5
PART = 1 << 22
SMALL = 24
COMMON_HERE, COMMON, MOST_COMMON = 8, 64, 1 << 16
SPREAD = 1.15  # chunks per allowed difference at the first level
LONG = 1 << 16  # members held at a time while a group is read
BLOCK = 1 << 11  # members whose sketches are compared at a time
HELD = 1 << 20  # shingles of a component held at a time


class Sets:
    """Distinct shingles of some texts: ``flat`` sorted within rows, ``first`` offset of each row."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray) -> None:
        hashes, _, _, first = words(data, bounds, lower=True, hasher=per_process("spans", SpanHasher))
        counts, total = np.diff(first), len(hashes)
        rows = np.repeat(np.arange(len(counts)), counts)
        at = np.flatnonzero(inside(first, WORDS, total))
        shingles, owner = grams(hashes, WORDS)[at], rows[at]
        few = np.flatnonzero((counts > 0) & (counts < WORDS))
        if len(few):
            whole = per_process("spans", SpanHasher).of_values(hashes, first[few], first[few + 1])
            shingles, owner = np.concatenate([shingles, mix(whole + np.uint64(WORDS))]), np.concatenate([owner, few])
        order = np.lexsort((shingles, owner))
        shingles, owner = shingles[order], owner[order]
        new = first_of_runs(shingles, owner)
        self.flat, self.row = shingles[new], owner[new]
        self.first = np.searchsorted(self.row, np.arange(len(counts) + 1))
        self.size = np.diff(self.first)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(self.flat ^ np.uint64(0x5851F42D4C957F2D)))])
        self.ref = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(np.uint64))

    def keep(self, rows: np.ndarray) -> None:
        """Only these rows, in this order."""
        at = ragged(self.first[rows], self.size[rows])
        self.flat, self.row = self.flat[at], np.repeat(np.arange(len(rows)), self.size[rows])
        self.size, self.ref = self.size[rows], self.ref[rows]
        self.first = np.concatenate([[0], np.cumsum(self.size)])


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, Sets]]:
    data, bounds = text_bytes(texts)
    for a, b in slices(bounds, PART):
        yield a, b, Sets(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
    tidy()


def _distinct_rows(s: Sets) -> np.ndarray:
    """The first row of each class that has shingles."""
    _, rows = np.unique(s.ref, return_index=True)
    rows.sort()
    return rows[s.size[rows] > 0]


def _sketch_bytes(size: int) -> int:
    return max(1 << (2 * size - 1).bit_length(), 64) // 8


def sketch(shingles: np.ndarray) -> bytes:
    """Parities of the shingles' bits; the number of bits is a power of two of about twice to four times the set's size."""
    bits = _sketch_bytes(len(shingles)) * 8
    return np.packbits(np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def _folded(s: np.ndarray, size: int) -> np.ndarray:
    while len(s) > size:
        s = s[: len(s) // 2] ^ s[len(s) // 2 :]
    return s


def hamming(one: bytes, two: bytes) -> int:
    """Hamming distance of two sketches, the longer one folded to the shorter one's length."""
    x, y = np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())


class Levels:
    """Size bands and chunks for one threshold."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.edges = [1]
        while self.edges[-1] < 1 << 31:
            self.edges.append(2 * self.edges[-1] if self.edges[-1] >= 16 else self.edges[-1] + 1)

    def differ(self, total: int) -> int:
        """Most differences of two linked sets with ``total`` shingles together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def slots(self, size: int) -> list[tuple[int, int]]:
        """Bands in which a set of ``size`` may meet a set as large or larger: band, and the differences to expect there."""
        largest = size * self.den // self.num
        first, last = bisect.bisect_right(self.edges, size) - 1, bisect.bisect_right(self.edges, largest) - 1
        return [(band, self.differ(size + min(largest, self.edges[band + 1] - 1))) for band in range(first, last + 1)]

    def chunks(self, band: int) -> int:
        return int(SPREAD * (self.differ(2 * (self.edges[band + 1] - 1)) + 1)) + 1

    def keys(self, s: Sets, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Join keys of all sets and the class of each."""
        keys, refs = [], []
        rare = np.ones(len(s.flat), bool)
        if len(common):
            rare = common[np.minimum(np.searchsorted(common, s.flat), len(common) - 1)] != s.flat
        slots = [self.slots(int(n)) for n in s.size]
        for place in range(max(map(len, slots), default=0)):
            rows = np.array([n for n, x in enumerate(slots) if len(x) > place], np.int64)
            band, need = np.array([slots[n][place] for n in rows.tolist()], np.int64).reshape(-1, 2).T
            count = np.array([self.chunks(b) for b in band.tolist()], np.uint64)
            for level in range(3):
                if not len(rows):
                    break
                at = ragged(s.first[rows], s.size[rows])
                of = np.repeat(np.arange(len(rows)), s.size[rows])
                if level == 0:
                    at, of = at[rare[at]], of[rare[at]]
                shingle = s.flat[at]
                spot = mix(shingle + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
                wide = count[of] << np.uint64(level)
                chunk = spot if level == 2 else (spot >> np.uint64(32)) * wide >> np.uint64(32)
                order = np.lexsort((chunk, of))
                chunk, of, spot = chunk[order], of[order], spot[order]
                new = np.flatnonzero(first_of_runs(chunk, of))
                parity = np.bitwise_xor.reduceat(spot, new) if len(new) else spot
                owner = of[new]
                keys.append(mix(parity ^ mix(chunk[new] + band[owner].astype(np.uint64) * np.uint64(1 << 34) + np.uint64(level << 60))))
                refs.append(s.ref[rows[owner]])
                short = np.bincount(owner, minlength=len(rows)) <= need
                rows, band, need, count = rows[short], band[short], need[short], count[short]
        return (np.concatenate(keys), np.concatenate(refs)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


class Runs:
    """Groups of classes that share a key, from rows sorted by key and class, without holding a key's rows.

    A group is named by its members; one with more than ``LONG`` is named by its key and passed on as it is read.
    """

    def __init__(self) -> None:
        self.key = self.ref = np.zeros(0, np.int64)  # rows of the last key, which may go on
        self.passed = False  # whether earlier rows of that key have been passed on

    def add(self, key: np.ndarray, ref: np.ndarray) -> Iterator[pa.RecordBatch]:
        key, ref = np.concatenate([self.key, key]), np.concatenate([self.ref, ref])
        one = first_of_runs(key, ref)
        key, ref = key[one], ref[one]
        if not len(key):
            return
        last = int(np.searchsorted(key, key[-1], "left"))
        if last:
            yield from self._close(key[:last], ref[:last])
            self.passed = False
        self.key, self.ref = key[last:], ref[last:]
        if len(self.ref) > LONG:
            # The last row stays, so that a repeated one is seen.
            yield self._rows(np.full(len(self.ref) - 1, self._name(self.key[0])), self.ref[:-1])
            self.key, self.ref, self.passed = self.key[-1:], self.ref[-1:], True

    def end(self) -> Iterator[pa.RecordBatch]:
        if len(self.key):
            yield from self._close(self.key, self.ref)

    def _name(self, key: np.int64) -> np.int64:
        return mix(np.array([key], np.int64).view(np.uint64)).view(np.int64)[0]

    def _rows(self, group: np.ndarray, ref: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"grp": pa.array(group.astype(np.int64)), "ref": pa.array(ref)})

    def _close(self, key: np.ndarray, ref: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.flatnonzero(first_of_runs(key))
        size = np.diff(np.append(begin, len(key)))
        if self.passed:
            yield self._rows(np.full(size[0], self._name(key[0])), ref[: size[0]])
            begin, size = begin[1:], size[1:]
        begin, size = begin[size > 1], size[size > 1]
        if len(begin):
            at = ragged(begin, size)
            first = np.cumsum(size) - size
            name = np.bitwise_xor.reduceat(mix(ref[at].view(np.uint64)), first) + size.astype(np.uint64)
            name, kept = np.unique(name, return_index=True)
            yield self._rows(np.repeat(name.view(np.int64), size[kept]), ref[ragged(begin[kept], size[kept])])


def groups_of(keys: DataFrame) -> DataFrame:
    """``grp, ref``: the members of every group of two classes or more that share a key."""

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in batches:
            yield from runs.add(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        yield from runs.end()

    ordered = keys.repartition("key").sortWithinPartitions("key", "ref")
    return ordered.mapInArrow(shared, "grp long, ref long").distinct()


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, mark, size, class and sketch of every document, and in rows of their own common shingles with counts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in _sets(batch.column(1)):
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(a, b - a),
                        "mark": batch.column(2).slice(a, b - a),
                        "size": pa.array(s.size),
                        "ref": _signed(s.ref),
                        "sketch": pa.array([sketch(s.flat[x:y]) for x, y in zip(s.first[:-1], s.first[1:], strict=True)], pa.binary()),
                        "shingle": pa.nulls(b - a, pa.int64()),
                    }
                )
                s.keep(_distinct_rows(s))
                found, counts = np.unique(s.flat, return_counts=True)
                found, counts = found[counts >= COMMON_HERE], counts[counts >= COMMON_HERE]
                none = len(found)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.nulls(none, pa.int64()),
                        "mark": pa.nulls(none, pa.int64()),
                        "size": pa.array(counts.astype(np.int64)),
                        "ref": pa.nulls(none, pa.int64()),
                        "sketch": pa.nulls(none, pa.binary()),
                        "shingle": _signed(found),
                    }
                )

    return docs.mapInArrow(each, "doc_id long, mark long, size long, ref long, sketch binary, shingle long")


def _near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that sizes and sketches allow, with the sketches' distance."""
    side = lambda x: classes.select(F.col("ref").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"))

    @F.arrow_udf("int")
    def distance(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([hamming(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"size_a * {den} >= size_b * {num} AND size_b * {den} >= size_a * {num}")
    far = sized.withColumn("distance", distance("sketch_a", "sketch_b"))
    return far.where(f"distance * {den + num} <= (size_a + size_b) * {den - num}").select("a", "b", "distance")


def _verified(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose shingles are similar enough."""

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        step = 256
        for n in range(0, len(x), step):
            one, two = ([s for _, _, s in _sets(v.slice(n, step))] for v in (x, y))
            sets = [[s.flat[p:q] for s in side for p, q in zip(s.first[:-1], s.first[1:], strict=True)] for side in (one, two)]
            for p, q in zip(*sets, strict=True):
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(den * common >= num * (len(p) + len(q) - common))
        return pa.array(out, pa.bool_())

    side = lambda x: texts.select(F.col("ref").alias(x), F.col("text").alias(f"text_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(linked("text_a", "text_b")).select("a", "b")


def _texts(docs: DataFrame, classes: DataFrame, refs: DataFrame) -> DataFrame:
    """One text of each class of ``refs``."""
    wanted = classes.join(refs.select("ref").distinct(), "ref").select("doc_id", "ref")

    def refs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in _sets(batch.column(1)):
                same = pa.array(s.ref.view(np.int64) == batch.column(0).slice(a, b - a).to_numpy())
                yield pa.RecordBatch.from_pydict({"ref": batch.column(0).slice(a, b - a).filter(same), "text": batch.column(1).slice(a, b - a).filter(same)})

    known = wanted.join(docs, wanted["doc_id"].eqNullSafe(docs["doc_id"])).select("ref", "text")
    return known.mapInArrow(refs_of, "ref long, text string").dropDuplicates(["ref"])


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("ref"))


def _with_hub(members: DataFrame) -> DataFrame:
    """``grp, ref, hub, n``: with each member the one of its group that is in most groups, and the group's size."""
    degree = members.groupBy("ref").agg(F.count("*").alias("degree"))
    hub = members.join(degree, "ref").groupBy("grp").agg(F.max(F.struct("degree", "ref"))["ref"].alias("hub"), F.count("*").alias("n"))
    return members.join(hub, "grp")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _open_members(members: DataFrame, roots: DataFrame, space: Workspace) -> DataFrame:
    """``members`` with their root, of the groups that lie in several components; ``inside`` is the most frequent root."""
    several = members.where("n > 2")  # two members have been compared
    rooted = several.join(roots.withColumnRenamed("node", "ref"), "ref", "left").withColumn("root", F.coalesce("root", "ref"))
    by_root = rooted.groupBy("grp", "root").agg(F.count("*").alias("n"))
    split = by_root.groupBy("grp").agg(F.max(F.struct("n", "root"))["root"].alias("inside"), F.count("*").alias("roots")).where("roots > 1")
    return space.stage(rooted.join(split.select("grp", "inside"), "grp"), "open")


def _shingles(texts: DataFrame) -> DataFrame:
    """``ref, shingles``: the sorted shingles of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in _sets(batch.column(1)):
                sets = [s.flat[x:y].tobytes() for x, y in zip(s.first[:-1], s.first[1:], strict=True)]
                yield pa.RecordBatch.from_pydict({"ref": batch.column(0).slice(a, b - a), "shingles": pa.array(sets, pa.binary())})

    return texts.select("ref", "text").mapInArrow(each, "ref long, shingles binary")


def _asked(
    open_members: DataFrame, roots: DataFrame, texts: DataFrame, docs: DataFrame, classes: DataFrame, num: int, den: int, space: Workspace
) -> DataFrame:
    """Links ``a, b`` of outside members with the most frequent component of their groups, at least one where there is any.

    A component of up to ``SMALL`` members is compared by sketches first. A larger one is cut into parts of about ``HELD``
    shingles, and every asking member is sent to each part once.
    """
    asks = space.stage(open_members.where("root <> inside").select("ref", F.col("inside").alias("family")).distinct(), "asks")
    families = asks.select("family").distinct()
    held = roots.select(F.col("node").alias("ref"), F.col("root").alias("family")).unionByName(
        families.select(F.col("family").alias("ref"), "family")
    )
    held = held.distinct().join(families, "family").join(classes.select("ref", "size"), "ref")
    extent = held.groupBy("family").agg(F.ceil(F.sum("size") / HELD).cast("int").alias("parts"), F.count("*").alias("n"))
    held = space.stage(held.join(extent, "family"), "held")
    extent = held.groupBy("family").agg(F.first("parts").alias("parts"), F.first("n").alias("n"))
    asks = space.stage(asks.join(extent, "family"), "asking")
    few = held.where(f"n <= {SMALL}").select("family", F.col("ref").alias("b"))
    met = _ordered(asks.where(f"n <= {SMALL}").select("family", F.col("ref").alias("a")).join(few, "family").where("a <> b"))
    met = space.stage(_near(met, classes, num, den).select("a", "b"), "asked")
    small = _verified(met, _texts(docs, classes, _ends(met)), num, den)
    held, asks = (df.where(f"n > {SMALL}").drop("n") for df in (held, asks))
    refs = space.stage(held.select("ref").unionByName(asks.select("ref")).distinct(), "refs")
    missing = _texts(docs, classes, refs.join(texts.select("ref"), "ref", "left_anti"))
    sets = space.stage(_shingles(texts.join(refs, "ref", "left_semi").unionByName(missing)), "shingles")
    row = ["family", "part", "asks", "ref", "shingles"]
    mine = F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int")
    held = held.withColumns({"part": mine, "asks": F.lit(False)})
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    asking = asks.withColumns({"part": every, "asks": F.lit(True)})
    rows = held.select(*row[:-1]).unionByName(asking.select(*row[:-1])).join(sets, "ref").select(*row)

    def link(found: pa.Table) -> pa.Table:
        asks, ref = np.array(found.column("asks")), np.array(found.column("ref"))
        sets = [np.frombuffer(x, np.uint64) for x in found.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets])
        sketches = [np.frombuffer(sketch(x), np.uint8) for x in sets]
        held = np.flatnonzero(~asks)
        tables: dict[int, np.ndarray] = {}
        a, b = [], []
        for i in np.flatnonzero(asks).tolist() if len(held) else []:
            # Sketches are compared at the asking one's width, or at that of a shorter one.
            j = held[(size[held] * den >= size[i] * num) & (size[i] * den >= size[held] * num)]
            width = min([len(sketches[i]), *(len(sketches[x]) for x in j.tolist())])
            if width not in tables:
                tables[width] = np.stack([_folded(x, width) if len(x) >= width else np.zeros(width, np.uint8) for x in sketches])
            far = np.bitwise_count(tables[width][j] ^ _folded(sketches[i], width)).sum(1, dtype=np.int64)
            near = np.flatnonzero(far * (den + num) <= (size[i] + size[j]) * (den - num))
            for n in j[near[np.argsort(far[near], kind="stable")]].tolist():
                common = len(np.intersect1d(sets[i], sets[n], assume_unique=True))
                if den * common >= num * (size[i] + size[n] - common):
                    a.append(ref[i])
                    b.append(ref[n])
                    break
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    large = rows.groupBy("family", "part").applyInArrow(link, "a long, b long")
    return _ordered(small.unionByName(large))


def _remaining(open_members: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components within groups that sketches allow, among ``open_members``: those that have asked.

    A member that is still ``apart`` from the component it asked is compared with all of them, for one that has joined that
    component by asking was not in it when the others asked. Small groups are joined with themselves; those of large ones are sent to every block of ``BLOCK`` of them.
    """
    side = lambda x: F.struct("ref", "root", "apart").alias(x)
    asked = open_members.withColumn("apart", F.col("root") != F.col("inside")).drop("n")
    sizes = asked.groupBy("grp").agg(F.count("*").alias("n"), F.count_if("apart").alias("n_apart"))
    open_members = asked.join(sizes.where("n > 1 AND n_apart > 0"), "grp")
    few = open_members.where(f"n <= {SMALL}")
    small = few.select("grp", side("x")).join(few.select("grp", side("y")), "grp")
    small = small.where("x.apart AND (NOT y.apart OR x.ref < y.ref) AND x.root <> y.root")
    small = _near(_ordered(small.select(F.col("x.ref").alias("a"), F.col("y.ref").alias("b"))), classes, num, den).select("a", "b")

    many = open_members.where(f"n > {SMALL}").join(classes.select("ref", "size", "sketch"), "ref")
    many = many.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")
    row = ["grp", "block", "asks", "ref", "root", "apart", "size", "sketch"]
    held = many.withColumns({"block": mine, "asks": F.lit(False)}).select(*row)
    asking = many.where("apart").withColumns({"block": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "asks": F.lit(True)})

    def compare(found: pa.Table) -> pa.Table:
        asks, ref, root, apart, size = (np.array(found.column(c)) for c in ("asks", "ref", "root", "apart", "size"))
        raw = [np.frombuffer(s, np.uint8) for s in found.column("sketch").to_pylist()]
        width = min(map(len, raw))
        table = np.stack([_folded(s, width) for s in raw])
        held, a, b = np.flatnonzero(~asks), [], []
        for i in np.flatnonzero(asks).tolist():
            j = held[(root[held] != root[i]) & (~apart[held] | (ref[held] > ref[i]))]
            j = j[(size[j] * den >= size[i] * num) & (size[i] * den >= size[j] * num)]
            far = np.bitwise_count(table[j] ^ table[i]).sum(1, dtype=np.int64)
            j = j[far * (den + num) <= (size[i] + size[j]) * (den - num)]
            a.append(np.full(len(j), ref[i]))
            b.append(ref[j])
        a, b = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": a, "b": b})

    large = held.unionByName(asking.select(*row)).groupBy("grp", "block").applyInArrow(compare, "a long, b long")
    return _ordered(small.unionByName(large))


def similar_documents(
    docs: DataFrame, num: int = 3, den: int = 4, text: str = "text", space: Workspace | None = None, marked: bool = False
) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``.

    ``marked`` adds ``mark``, the xxhash64 of the row's text, and ``root``, which tells components with one smallest id
    apart and is null for documents without words.
    """
    spark = docs.sparkSession
    space = space or Workspace(spark)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    levels = Levels(num, den)
    mark = F.xxhash64("text") if marked else F.lit(None).cast("long")
    made = space.stage(shingle_sets(docs.withColumn("mark", mark)), "sets")
    sets = made.where("shingle IS NULL").select("doc_id", "mark", "size", "ref", "sketch")
    counted = made.where("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("size").alias("n")).where(f"n >= {COMMON}")
    top = counted.orderBy(F.desc("n"), "shingle").limit(MOST_COMMON).collect()  # at most MOST_COMMON numbers
    common = np.sort(np.array([r["shingle"] for r in top], np.int64).view(np.uint64))
    classes = sets.where("size > 0").groupBy("ref").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    classes = space.stage(classes, "classes")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, s in _sets(batch.column(1)):
                s.keep(_distinct_rows(s))
                key, ref = levels.keys(s, common)
                yield pa.RecordBatch.from_pydict({"key": _signed(key), "ref": _signed(ref)})

    members = space.stage(groups_of(docs.mapInArrow(send, "key long, ref long")), "groups")
    members = space.stage(_with_hub(members), "members")
    hubs = _ordered(members.where("ref <> hub").select(F.col("ref").alias("a"), F.col("hub").alias("b")))
    near = space.stage(_near(hubs, classes, num, den), "near")
    texts = space.stage(_texts(docs, classes, _ends(near)), "texts")

    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance"))
    best = both.groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b"))
    edges = space.stage(_verified(best.distinct(), texts, num, den), "links")
    roots = components(edges, space)

    def across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        known = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left")
        return known.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")

    more = space.stage(_verified(across(near.select("a", "b"), roots), texts, num, den), "links")
    edges = edges.unionByName(more)
    roots = space.stage(components(edges, space), "roots")
    open_members = _open_members(members, roots, space)
    if not open_members.isEmpty():
        edges = space.stage(edges.unionByName(_asked(open_members, roots, texts, docs, classes, num, den, space)), "links")
        roots = space.stage(components(edges, space), "roots")
        known = open_members.where("root <> inside").drop("root").withColumnRenamed("inside", "old")
        moved = roots.withColumnRenamed("node", "ref")
        now = known.join(moved, "ref", "left").withColumn("root", F.coalesce("root", "ref"))
        # The component that was asked is known by its new root.
        inside = moved.select(F.col("ref").alias("old"), F.col("root").alias("inside"))
        now = now.join(inside, "old", "left").withColumn("inside", F.coalesce("inside", "old"))
        rest = space.stage(_remaining(now, classes, num, den), "rest")
        last = space.stage(_verified(rest, _texts(docs, classes, _ends(rest)), num, den), "links")
        roots = components(edges.unionByName(last), space)

    keyed = sets.join(roots.withColumnRenamed("node", "ref"), "ref", "left").select(
        "doc_id", "mark", "size", F.when(F.col("size") > 0, F.coalesce("root", "ref")).alias("root")
    )
    lowest = keyed.where("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return keyed.join(lowest, "root", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        *(["mark", "root"] if marked else []),
    )
