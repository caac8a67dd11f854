"""Token counts of whole texts, equal to the ``tokenizers`` library, without a shuffle of the texts' pieces.

Two tiers answer for a piece. A compact hash table of the corpus's frequent pieces and their lengths is broadcast to
all workers; a piece that it lacks is looked up in the worker's own cache, and encoded if that lacks it too.

The frequent pieces come from all texts: every task keeps a Misra-Gries summary of its share, so a piece with more
than 1 / ``SUMMARY`` of a task's pieces is in it whatever the order of rows, and only summaries are added up between
tasks. The table decides the speed, never a count. Pieces are told apart by 64-bit hashes.

Null text is empty and has no tokens; repeated rows are each counted; very long texts are worked on alone, in parts
that end at white space; an empty table gives an empty table. Columns other than the id and the text are not
carried, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import slices
from ratingloom.llm.bpe import PieceModel, split_pieces
from ratingloom.llm.tables import map_batches, per_process, share, text_bytes, tidy
from ratingloom.llm.wordhash import SpanHasher, cuts

PART = 1 << 22  # bytes of text looked at together
SUMMARY = 1 << 14  # pieces in a task's summary
FREQUENT = 1 << 15  # pieces in the broadcast table: 16 slots of bits, 12 bytes each, 0.8 MB
CACHED = 1 << 20  # pieces in a worker's cache


class LengthTable:
    """Token counts by piece hash, with open addressing; half of the slots stay free."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        self.bits = max(int(2 * len(keys) - 1).bit_length(), 4)
        self.key = np.zeros(1 << self.bits, np.uint64)
        self.length = np.full(1 << self.bits, -1, np.int32)
        self.probes, todo = 0, np.arange(len(keys))
        while len(todo):
            slot = self._slot(keys[todo], self.probes)
            free = np.flatnonzero(self.key[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)  # of those that meet in a slot one stays
            put = free[one]
            self.key[slot[put]], self.length[slot[put]] = keys[todo[put]], lengths[todo[put]]
            todo, self.probes = np.delete(todo, put), self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Lengths; -1 for a piece that is not in the table."""
        out = np.full(len(keys), -1, np.int32)
        todo = np.arange(len(keys))
        for probe in range(self.probes):
            slot = self._slot(keys[todo], probe)
            held = self.key[slot]
            found = held == keys[todo]
            out[todo[found]] = self.length[slot[found]]
            todo = todo[~found & (held != 0)]
            if not len(todo):
                break
        return out


class PieceCounter:
    """A worker's second tier: a direct-mapped cache in front of the vocabulary's model."""

    def __init__(self, path: str) -> None:
        self.model, self.hasher = PieceModel(path), SpanHasher()
        self.key, self.length = np.zeros(CACHED, np.uint64), np.zeros(CACHED, np.int32)

    def keys(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """Hashes and starts of all pieces, and their lengths on demand by index."""
        starts, ends, folded, odd = split_pieces(data, bounds)
        keys = self.hasher(folded, starts, ends) | np.uint64(1)

        def lengths(at: np.ndarray) -> np.ndarray:
            wanted, first, back = np.unique(keys[at], return_index=True, return_inverse=True)
            slot = (wanted >> np.uint64(64 - 20)).astype(np.int64)
            out = self.length[slot]
            new = np.flatnonzero(self.key[slot] != wanted)
            if len(new):
                raw, place = folded.tobytes(), at[first[new]]
                pieces = [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
                made = self.model.ids(pieces, odd[place].tolist())
                out[new] = np.fromiter(map(len, made), np.int32, len(made))
                self.key[slot[new]], self.length[slot[new]] = wanted[new], out[new]
            return out[back]

        return keys, starts, lengths


def _counter(path: str) -> PieceCounter:
    return per_process(("lengths", path), lambda: PieceCounter(path))


def _parts(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, row starts within them, and the first row, of parts that no piece crosses."""
    data, bounds = text_bytes(column)
    edges = cuts(data, bounds)
    for a, b in zip(edges, edges[1:], strict=False):
        first = int(np.searchsorted(bounds, a, "right")) - 1
        inside = bounds[first + 1 : int(np.searchsorted(bounds, b, "left"))]
        yield data[a:b], np.concatenate([[0], inside - a, [b - a]]), first


class Summary:
    """Misra-Gries: the pieces with more than 1 / ``size`` of all are among the ``size`` kept; counts are lower bounds."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.key, self.count, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, keys: np.ndarray, lengths: Callable[[np.ndarray], np.ndarray]) -> None:
        new, first, count = np.unique(keys, return_index=True, return_counts=True)
        key, back = np.unique(np.concatenate([self.key, new]), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, back, np.concatenate([self.count, count]))
        length, place = np.full(len(key), -1, np.int32), np.zeros(len(key), np.int64)
        length[back[: len(self.key)]] = self.length
        place[back[len(self.key) :]] = first
        if len(key) > self.size:
            total -= np.partition(total, len(key) - self.size - 1)[len(key) - self.size - 1]
        kept = np.flatnonzero(total > 0)
        unknown = kept[length[kept] < 0]
        length[unknown] = lengths(place[unknown]) if len(unknown) else 0
        self.key, self.count, self.length = key[kept], total[kept], length[kept]


def frequent_pieces(docs: DataFrame, path: str, text: str = "text", most: int = FREQUENT) -> LengthTable:
    """The lengths of the ``most`` pieces with the highest counts in the tasks' summaries."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, summary = _counter(path), Summary(SUMMARY)
        for batch in batches:
            for a, b in slices(text_bytes(batch.column(0))[1], PART):
                for data, bounds, _ in _parts(batch.column(0).slice(a, b - a)):
                    keys, _, lengths = counter.keys(data, bounds)
                    summary.add(keys, lengths)
            tidy()
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array(summary.key.view(np.int64)), "n": pa.array(summary.count), "length": pa.array(summary.length)}
        )

    found = (
        docs.select(text)
        .mapInArrow(summarise, "piece long, n long, length int")
        .groupBy("piece", "length")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "piece")
        .limit(most)
        .toArrow()
    )
    return LengthTable(found["piece"].to_numpy().view(np.uint64), found["length"].to_numpy().astype(np.int32))


def count_tokens(
    docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text", most: int = FREQUENT
) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row; reads the texts twice and shuffles none of them."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    table = share(docs.sparkSession, frequent_pieces(rows, path, "text", most))

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counter, hot = _counter(path), table()
        for a, b in slices(text_bytes(batch.column(1))[1], PART):
            part = batch.slice(a, b - a)
            total = np.zeros(b - a, np.int64)
            for data, bounds, first in _parts(part.column(1)):
                keys, starts, lengths = counter.keys(data, bounds)
                length = hot(keys)
                missing = np.flatnonzero(length < 0)
                if len(missing):
                    length[missing] = lengths(missing)
                sums = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
                total[first : first + len(bounds) - 1] += np.diff(sums[np.searchsorted(starts, bounds)])
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column(0),
                    "n_bytes": pa.array(np.diff(text_bytes(part.column(1))[1])),
                    "n_tokens": pa.array(total),
                    "over_limit": pa.array(total > limit),
                }
            )
        tidy()

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(rows, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", key)
