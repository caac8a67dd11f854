"""Pack documents into sequences of a fixed number of tokens, similar documents together.

Every document is encoded, closed by an end id, and written once to a staged table. Document frequencies are
counted over the whole table; there is at most one per id of the vocabulary. Documents are then sorted over the whole table by
their ``ROUTE`` rarest ids that other documents have too, so that like documents meet wherever their files lie; a place in the
staged table breaks ties, so a route that many documents share is spread over tasks, and a task that runs again finds the same
order. Up to ``SHARD`` bytes in that order are one shard with its own BM25 inverted index over all distinct ids. Within a
shard a seed starts a window, its unused BM25 neighbours fill it, and the document that meets the window's end is cut there and
becomes the next seed. What is left at a shard's end is cut at powers of two, which need no padding.

Null text is empty and yields the end id alone; a very long one is cut into as many pieces as it needs. Null ids and repeated
rows are packed like any other row; ties go to the earlier row of the order. An empty table gives no pieces. Only the id and
the text are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import slices
from ratingloom.llm.bpe import LEAF_CHARS, encode, tokenizer
from ratingloom.llm.tables import ragged, text_bytes, tidy
from ratingloom.staging import Workspace

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ROUTE, K1, B = 4, 1.2, 0.75
SHARD = 1 << 20  # bytes of 16-bit ids
SHARD_ROWS = 1 << 16  # rows whose number fits beside an id
DENSE = 16  # an id is common in a shard if one in so many documents has it
TASK = 1 << 26  # bytes of ids that a task sorts


def encoded_documents(docs: DataFrame, path: str, end_id: int, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Ids of every document, and for every batch a row with the number of its documents that have each id."""

    def finish(batch: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        lengths = np.diff(offsets)
        closed = np.full(len(ids) + len(lengths), end_id, np.uint16)
        at = offsets[:-1] + np.arange(len(lengths))
        closed[ragged(at, lengths)] = ids
        ends = np.cumsum(lengths + 1) * 2
        column = pa.Array.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(closed)]
        ).cast(pa.binary())
        counts = np.zeros(1 << 16, np.uint32)
        for a in range(0, len(lengths), 1 << 16):
            pairs = _distinct_terms(ids, offsets[a : a + (1 << 16) + 1])[0]
            counts += np.bincount(pairs & np.uint32(0xFFFF), minlength=1 << 16).astype(np.uint32)
        none = pa.nulls(len(lengths), pa.binary())
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "ids": column, "counts": none})
        yield pa.RecordBatch.from_pydict(
            {"doc_id": pa.nulls(1, pa.int64()), "ids": pa.nulls(1, pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())}
        )

    return encode(docs, path, finish, "doc_id long, ids binary, counts binary", leaf_chars=leaf_chars)


def _distinct_terms(ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``row << 16 | id`` of at most 65,536 rows, sorted, and how often each occurs."""
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
    pairs = np.sort(rows << np.uint32(16) | ids[offsets[0] : offsets[-1]])
    if not len(pairs):
        return pairs, np.zeros(0, np.int64)
    new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
    return pairs[new], np.diff(np.append(new, len(pairs)))


def document_frequencies(encoded: DataFrame) -> DataFrame:
    """Documents that have each id; at most as many rows as the vocabulary has ids."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total += np.frombuffer(value, np.uint32)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": pa.array(there), "n": pa.array(total[there])})

    rows = encoded.where("counts IS NOT NULL").select("counts").mapInArrow(spread, "id long, n long")
    return rows.groupBy("id").agg(F.sum("n").alias("n"))


def routes(ids: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The ``ROUTE`` rarest shared ids of each document, the rarest in the highest bits.

    ``rank`` has an id's place by document frequency, and the highest value for an id that fewer than two documents have.
    """
    pairs = _distinct_terms(rank[ids], offsets)[0]
    row = pairs >> np.uint32(16)
    nth = np.arange(len(row)) - np.searchsorted(row, np.arange(len(offsets) - 1))[row]
    best = np.full((len(offsets) - 1, ROUTE), 0xFFFF, np.uint64)
    few = nth < ROUTE
    best[row[few], nth[few]] = pairs[few] & np.uint32(0xFFFF)
    key = np.zeros(len(best), np.uint64)
    for n in range(ROUTE):
        key = key << np.uint64(16) | best[:, n]
    return key


class Shard:
    """A BM25 index of the documents of one shard.

    An id that at least one in ``DENSE`` documents has gets a row with a weight for every document, which is added as a whole;
    there are at most ``DENSE`` times as many such weights as postings. Other ids have postings.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        lengths = np.diff(offsets)
        pairs, tf = _distinct_terms(ids, offsets)
        self.n, self.terms, row = len(lengths), pairs & np.uint32(0xFFFF), (pairs >> np.uint32(16)).astype(np.int64)
        norm = K1 * (1 - B + B * lengths[row] / max(mean_length, 1.0))
        weight = (idf[self.terms] * tf * (K1 + 1) / (tf + norm)).astype(np.float32)
        self.of = np.searchsorted(row, np.arange(self.n + 1))
        many = np.bincount(self.terms, minlength=1 << 16) * DENSE >= max(self.n, 1)
        common = np.flatnonzero(many)
        self.place = np.full(1 << 16, -1, np.int64)
        self.place[common] = np.arange(len(common))
        here = many[self.terms]
        self.dense = np.zeros((len(common), self.n), np.float32)
        self.dense[self.place[self.terms[here]], row[here]] = weight[here]
        rest = np.flatnonzero(~here)
        order = rest[np.argsort(self.terms[rest], kind="stable")]
        self.rows, self.weights = row[order], weight[order]
        self.first = np.searchsorted(self.terms[order], np.arange((1 << 16) + 1))

    def neighbours(self, row: int, unused: np.ndarray) -> np.ndarray:
        """Unused rows that share an id with the seed, best first, ties to the earlier row."""
        query = self.terms[self.of[row] : self.of[row + 1]].astype(np.int64)
        at = ragged(self.first[query], self.first[query + 1] - self.first[query])
        scores = np.bincount(self.rows[at], self.weights[at], self.n)
        scores = scores + self.dense[self.place[query[self.place[query] >= 0]]].sum(axis=0)
        found = np.flatnonzero(unused & (scores > 0))
        return found[np.argsort(-scores[found], kind="stable")]


def _fill(ids: np.ndarray, offsets: np.ndarray, index: Shard, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces of one shard: row, start, length, sequence, offset."""
    lengths = np.diff(offsets)
    unused = np.ones(index.n, bool)
    order = iter(np.argsort(-lengths, kind="stable").tolist())
    left, sequence, offset, remain = int(lengths.sum()), 0, 0, window
    ready: Iterator[int] = iter(())
    size = window if left >= window else 0
    row = -1
    while left:
        if not size:
            size = 1 << (left.bit_length() - 1)
        if row < 0:
            row = next((r for r in ready if unused[r]), -1)
            if row < 0:
                row = next(r for r in order if unused[r])
            unused[row], start = False, 0
        if not offset:
            fresh = True
        take = min(int(lengths[row]) - start, size - offset)
        yield row, start, take, sequence, offset
        start, offset, left = start + take, offset + take, left - take
        if fresh and offset < size:
            ready, fresh = iter(index.neighbours(row, unused).tolist()), False
        if start == lengths[row]:
            row = -1
        if offset == size:
            sequence, offset = sequence + 1, 0
            size = window if left >= window else 0


def _shards_of(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``SHARD`` bytes, or of one longer row, and at most ``SHARD_ROWS`` rows."""
    for a, b in slices(bounds, SHARD):
        for c in range(a, b, SHARD_ROWS):
            yield c, min(c + SHARD_ROWS, b)


def pack(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, space: Workspace | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """Pieces of all documents; ``ids`` holds unsigned little-endian 32-bit integers."""
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    space = space or Workspace(docs.sparkSession)
    encoded = space.spark.read.parquet(space.write(encoded_documents(docs, path, end_id, leaf_chars), "encoded", compression="zstd"))
    own = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("own")
    rows = encoded.where("ids IS NOT NULL").select("doc_id", "ids", own)
    n_docs, n_bytes = rows.agg(F.count("ids"), F.sum(F.octet_length("ids"))).first()
    size = tokenizer(path).get_vocab_size(with_added_tokens=True)
    shared = np.zeros(1 << 16, np.int64)
    for found in document_frequencies(encoded).collect():  # at most one row per id of the vocabulary
        shared[found["id"]] = found["n"]
    idf = np.log1p((n_docs - shared + 0.5) / (shared + 0.5)).astype(np.float32)
    idf[size:] = 0
    rank = np.full(1 << 16, 0xFFFF, np.uint16)
    common = np.flatnonzero(shared > 1)
    rank[common[np.argsort(shared[common], kind="stable")]] = np.arange(len(common))
    n_bytes = n_bytes or 0
    mean_length = n_bytes / 2 / max(n_docs, 1)
    slots = 2 * space.spark.sparkContext.defaultParallelism
    tasks = max(1, -(-n_bytes // TASK), min(slots, -(-n_bytes // (4 * SHARD))))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, bounds = text_bytes(batch.column(1))
                ids, found = np.frombuffer(data.tobytes(), np.uint16), []
                for a in range(0, batch.num_rows, SHARD_ROWS):
                    part = bounds[a : a + SHARD_ROWS + 1] // 2
                    found.append(routes(ids[part[0] : part[-1]], part - part[0], rank))
                route = pa.array(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, route], ["doc_id", "ids", "own", "route"])

    rows = rows.mapInArrow(routed, "doc_id long, ids binary, own long, route long")
    rows = rows.repartitionByRange(tasks, "route", "own").sortWithinPartitions("route", "own").select("doc_id", "ids")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in _shards_of(text_bytes(batch.column(1))[1]):
                part = batch.slice(a, b - a)
                data, bounds = text_bytes(part.column(1))
                ids, offsets = np.frombuffer(data.tobytes(), np.uint16), bounds // 2
                index = Shard(ids, offsets, idf, mean_length)
                row, start, length, at, offset = np.array(list(_fill(ids, offsets, index, window)), np.int64).reshape(-1, 5).T
                cut = np.concatenate([[0], np.cumsum(length)]) * 4
                wide = ids[ragged(offsets[row] + start, length)].astype("<u4")
                column = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(cut), pa.py_buffer(wide)]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0).take(pa.array(row)),
                        "start": start,
                        "length": length,
                        "ids": column,
                        "doc_tokens": np.diff(offsets)[row],
                        "sequence_id": sequence + at,
                        "offset": offset,
                    }
                )
                sequence += int(at[-1]) + 1 if len(at) else 0
            tidy()

    return rows.mapInArrow(shards, PIECES)
