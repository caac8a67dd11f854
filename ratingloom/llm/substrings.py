"""Remove passages of ``least`` words or more that also stand in a document with a smaller id.

Seed and extend. Every window of ``least`` words is anchored at its smallest hashed five-word gram (winnowing), so
equal windows have equal anchors. Neighbouring windows with one anchor form a run, which extends from the anchor both
ways; documents meet on anchors. A run that equals one of an earlier document goes as a whole. Where an
anchor has runs that differ, the first document of each run sends that run's windows, and equal windows meet in a second round.
Removed runs of a document are merged into its maximal repeats.

Within a batch only the smallest document of equal runs is sent on, so hot passages are combined before the shuffle.
Which runs need the second round is told by a bit table of at most ``MARK_BITS`` bits; when it is too full, more windows than
necessary are sent, and results stay the same.

Words are runs of anything but space and 9-13; null text has none. Rows without id neither lose nor cause anything. Repeated rows
get equal results and do not remove each other; rows with one id and different texts are judged one by one. Other columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import BLOCKS, bucket_count, bucket_of, deal, first_of_runs, gather, slices
from ratingloom.llm.tables import mix, per_process, text_bytes, tidy
from ratingloom.llm.wordhash import SpanHasher, grams, inside, words
from ratingloom.staging import Workspace

ANCHOR = 5
PART = 1 << 22  # bytes of text worked on at a time
MARK_BITS = 1 << 26
RUNS = {"anchor": "<u8", "key": "<u8", "doc": "<i8", "variant": "<u4", "start": "<u4", "count": "<u4"}
WINDOWS = {"key": "<u8", "doc": "<i8", "variant": "<u4", "start": "<u4"}
REMOVED = {"doc": "<i8", "variant": "<u4", "start": "<u4", "count": "<u4"}
RUN, WINDOW, GONE, MARKS = range(4)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have, out = 1, values
    while have * 2 <= width:
        out, have = np.minimum(out[:-have], out[have:]), have * 2
    return np.minimum(out[: len(values) - width + 1], out[width - have :]) if width > have else out


class Part:
    """Windows, anchors and runs of some documents; ``docs`` and ``variants`` by row."""

    def __init__(self, docs: np.ndarray, variants: np.ndarray, data: np.ndarray, bounds: np.ndarray, least: int) -> None:
        hasher = per_process("spans", SpanHasher)
        self.hashes, _, _, first = words(data, bounds, hasher=hasher)
        self.docs, self.variants, self.first, self.least = docs, variants, first, least
        total = len(self.hashes)
        self.rows = np.repeat(np.arange(len(docs)), np.diff(first))
        windows = np.flatnonzero(inside(first, least, total))
        anchors = _smallest(mix(grams(self.hashes, ANCHOR)), least - ANCHOR + 1) if total >= least else np.zeros(0, np.uint64)
        anchors, rows = anchors[windows], self.rows[windows]
        new = np.flatnonzero(first_of_runs(anchors, rows))
        self.begin, self.anchor, self.row = windows[new], anchors[new], rows[new]
        self.count = np.diff(np.append(new, len(windows)))
        self.key = hasher.of_values(self.hashes, self.begin, self.begin + self.count + least - 1)

    def runs(self) -> list[np.ndarray]:
        start = self.begin - self.first[self.row]
        return [self.anchor, self.key, self.docs[self.row], self.variants[self.row], start, self.count]


def _doc_buckets(docs: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(docs.astype(np.uint64)), n)


def _parted(batch: pa.RecordBatch, least: int) -> Iterator[Part]:
    """Distinct documents of a batch, piece by piece."""
    batch = batch.filter(batch.column(0).is_valid())
    docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    variants = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
    data, bounds = text_bytes(batch.column(2))
    for a, b in slices(bounds, PART):
        yield Part(docs[a:b], variants[a:b], data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], least)
    tidy()


def _earlier(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by key and document, and which of them have a smaller document with the same key."""
    order = np.lexsort((doc, key))
    new = first_of_runs(key[order])
    lowest = doc[order][np.flatnonzero(new)] if len(order) else doc
    return order, doc[order] > lowest[np.cumsum(new) - 1] if len(order) else np.zeros(0, bool)


def _sorted_runs(columns: list[np.ndarray], n: int) -> tuple[list[np.ndarray], Iterator[pa.RecordBatch]]:
    """Columns of rows that no earlier document covers, and blocks of the covered ones."""
    order, later = _earlier(columns[1], columns[2])
    columns = [c[order] for c in columns]
    lost = [c[later] for c in columns[2:]]
    return [c[~later] for c in columns], deal(_doc_buckets(lost[0], n), lost, REMOVED, GONE)


def _marks(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    return mix(keys ^ mix(docs.astype(np.uint64)))


def removed_runs(docs: DataFrame, least: int, space: Workspace) -> DataFrame:
    """Per document the windows to remove: ``doc_id``, ``variant``, and start and count of each run as 32-bit integers.

    ``docs`` has the columns doc_id, variant and text.
    """
    n = bucket_count(docs.sparkSession)

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parted(batch, least):
                kept, lost = _sorted_runs(part.runs(), n)
                yield from lost
                yield from deal(bucket_of(kept[0], n), kept, RUNS, RUN)

    def meet_runs(found: pa.Table) -> pa.Table:
        bucket = found.column("bucket")[0].as_py()
        kinds = np.array(found.column("kind"))
        blocks = found.column("block").to_pylist()
        out = [found.filter(pa.array(kinds == GONE))]
        kept, lost = _sorted_runs(gather([b for b, k in zip(blocks, kinds, strict=True) if k == RUN], RUNS), n)
        out += [pa.Table.from_batches([b]) for b in lost]
        anchor, key, doc = kept[:3]
        order = np.lexsort((doc, key, anchor))
        one = order[first_of_runs(anchor[order], key[order])]
        new = first_of_runs(anchor[one])
        several = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1] > 1 if len(one) else new
        marks = _marks(key[one[several]], doc[one[several]])
        if len(marks):
            out += [pa.Table.from_batches([b]) for b in deal(np.full(len(marks), bucket, np.int32), [marks], {"mark": "<u8"}, MARKS)]
        return pa.concat_tables([t.select(["bucket", "kind", "block"]) for t in out])

    first = space.stage(docs.mapInArrow(send_runs, BLOCKS).groupBy("bucket").applyInArrow(meet_runs, BLOCKS), "runs")
    contested = first.where(f"kind = {MARKS}").agg(F.sum(F.octet_length("block") / 8)).first()[0] or 0
    bits = 1 << 10
    while bits < min(16 * contested, MARK_BITS):
        bits *= 2
    shift = np.uint64(64 - (bits.bit_length() - 1))
    parts = 64

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = [np.zeros(0, np.uint64)] + [np.frombuffer(b, "<u8") >> shift for batch in batches for b in batch.column(0).to_pylist()]
        at = np.unique(np.concatenate(marks)).astype(np.int64)
        yield from deal((at * parts // bits).astype(np.int32), [at], {"at": "<i8"}, MARKS)

    def fill(found: pa.Table) -> pa.Table:
        bucket = found.column("bucket")[0].as_py()
        table = np.zeros(bits // parts, bool)
        table[gather(found.column("block").to_pylist(), {"at": "<i8"})[0] - bucket * (bits // parts)] = True
        return pa.table({"bucket": [bucket], "block": pa.array([np.packbits(table).tobytes()], pa.binary())}, schema=pa.schema([("bucket", pa.int32()), ("block", pa.binary())]))

    slices_of_bits = first.where(f"kind = {MARKS}").select("block").mapInArrow(mark, BLOCKS).groupBy("bucket").applyInArrow(fill, "bucket int, block binary")
    table = np.zeros(bits // 8, np.uint8)
    size = bits // 8 // parts
    for row in slices_of_bits.collect():  # at most MARK_BITS bits in all
        table[row["bucket"] * size : (row["bucket"] + 1) * size] = np.frombuffer(row["block"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parted(batch, least):
                at = (_marks(part.key, part.docs[part.row]) >> shift).astype(np.int64)
                marked = np.flatnonzero(shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
                count = part.count[marked]
                offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
                begin = np.repeat(part.begin[marked], count) + offset
                row = np.repeat(part.row[marked], count)
                key = per_process("spans", SpanHasher).of_values(part.hashes, begin, begin + least)
                columns = [key, part.docs[row], part.variants[row], begin - part.first[row]]
                order, later = _earlier(key, columns[1])
                columns = [c[order] for c in columns]
                lost = [c[later] for c in columns[1:]]
                yield from deal(_doc_buckets(lost[0], n), [*lost, np.ones(len(lost[0]))], REMOVED, GONE)
                kept = [c[~later] for c in columns]
                yield from deal(bucket_of(kept[0], n), kept, WINDOWS, WINDOW)

    def meet_windows(found: pa.Table) -> pa.Table:
        kinds = np.array(found.column("kind"))
        blocks = found.column("block").to_pylist()
        columns = gather([b for b, k in zip(blocks, kinds, strict=True) if k == WINDOW], WINDOWS)
        order, later = _earlier(columns[0], columns[1])
        lost = [c[order][later] for c in columns[1:]]
        out = [pa.Table.from_batches([b]) for b in deal(_doc_buckets(lost[0], n), [*lost, np.ones(len(lost[0]))], REMOVED, GONE)]
        return pa.concat_tables([found.filter(pa.array(kinds == GONE)).select(["bucket", "kind", "block"]), *out])

    second = docs.mapInArrow(send_windows, BLOCKS).groupBy("bucket").applyInArrow(meet_windows, BLOCKS)

    def by_document(found: pa.Table) -> pa.Table:
        doc, variant, start, count = gather(found.column("block").to_pylist(), REMOVED)
        order = np.lexsort((start, variant, doc))
        doc, variant, start, count = doc[order], variant[order], start[order], count[order]
        new = np.flatnonzero(first_of_runs(doc, variant))
        pairs = np.stack([start, count], 1).astype("<u4")
        edges = [*new.tolist(), len(doc)]
        runs = [pairs[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        return pa.table({"doc_id": doc[new], "variant": variant[new].astype(np.int64), "runs": pa.array(runs, pa.binary())})

    gone = first.where(f"kind = {GONE}").unionByName(second.where(f"kind = {GONE}"))
    return gone.groupBy("bucket").applyInArrow(by_document, "doc_id long, variant long, runs binary")


def _kept(text: str | None, runs: bytes | None, least: int) -> tuple[int, int, bytes]:
    found = (text or "").encode().split()
    if not runs:
        return len(found), 0, b" ".join(found)
    change = np.zeros(len(found) + 1, np.int64)
    start, count = np.frombuffer(runs, "<u4").reshape(-1, 2).astype(np.int64).T
    np.add.at(change, start, 1)
    np.add.at(change, start + count + least - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    left = np.flatnonzero(~gone).tolist()
    return len(found), int(gone.sum()), b" ".join([found[n] for n in left])


def without_repeats(docs: DataFrame, name: str = "repeats", least: int = 13, text: str = "text", space: Workspace | None = None) -> DataFrame:
    """``docs`` with a struct column: n_words, n_removed, and ``kept``, the remaining words joined by a space."""
    if least <= ANCHOR:
        raise ValueError(f"least must be more than {ANCHOR} words")
    space = space or Workspace(docs.sparkSession)
    variant = F.coalesce(F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)), F.lit(0))
    found = removed_runs(docs.select("doc_id", variant.alias("variant"), F.col(text).alias("text")), least, space)

    @F.arrow_udf("struct<n_words:bigint,n_removed:bigint,kept:string>")
    def judge(texts: pa.Array, runs: pa.Array) -> pa.Array:
        rows = [_kept(t, r, least) for t, r in zip(texts.to_pylist(), runs.to_pylist(), strict=True)]
        n, gone, kept = zip(*rows, strict=True) if rows else ((), (), ())
        kept = pa.array([k.decode() for k in kept], pa.string())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), kept], ["n_words", "n_removed", "kept"])

    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), variant.alias("of"), F.col(text).alias("body"))
    found = found.select(F.col("doc_id").alias("id"), F.col("variant").alias("of"), "runs")
    joined = whole.join(found, ["id", "of"], "left")
    judged: Column = judge("body", "runs")
    return joined.withColumn(name, judged).select("row.*", name)
