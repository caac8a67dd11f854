"""BPE encoding of whole texts, equal to the ``tokenizers`` library, and decoding.

Texts fall into pieces that the vocabulary's rules never join; every distinct piece of a batch is encoded once and
remembered in a bounded table. Texts longer than ``leaf_chars`` are cut into halves, quarters and so on, wherever
the cut falls; the leaves are encoded in parallel by Spark tasks. Neighbours are then concatenated as in a tree: a
window around each join is encoded anew and grows until its tokens equal those of both sides.

Null text is empty and has no tokens; repeated rows are encoded each by itself; other columns are kept.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingloom.llm.blocks import slices
from ratingloom.llm.tables import per_process, ragged, text_bytes, tidy
from ratingloom.llm.wordhash import SpanHasher, cuts

LEAF_CHARS = 1 << 16
PART = 1 << 22  # bytes of text encoded at a time
SLOTS = 1 << 20  # remembered pieces of one worker
_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[0x20, 9, 10, 11, 12, 13]] = _SPACE
_KIND[39] = _ODD  # an apostrophe may begin a contraction
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NOT_SIMPLE = [0xC397, 0xC3B7, 0xC4B0, 0xC589]  # of U+00C0 … U+017F: no letters, or letters that change in number


def _byte_names() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves and all others as the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def tokenizer(path: str):
    return per_process(("tokenizer", path), lambda: _load(path))


def split_pieces(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of pieces, the bytes to hash (lower case except in odd chunks, which stay whole), and which are odd."""
    kind = _KIND[data]
    latin = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC5))
    pair = data[latin].astype(np.int32) << 8 | data[latin + 1]
    latin = latin[(pair & 0xC0 == 0x80) & ~np.isin(pair, _NOT_SIMPLE)]
    kind[latin] = kind[latin + 1] = _LETTER
    plain = kind != _SPACE
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    edge[0] = edge[-1] = True
    edge[1:-1] |= plain[1:] != plain[:-1]
    chunk = np.flatnonzero(edge)[:-1]
    odd = kind == _ODD
    odd[:-1] |= (data[:-1] == 60) & (data[1:] == 124)  # "<|" may begin a special token
    odd_chunk = np.add.reduceat(odd, chunk, dtype=np.int64) > 0 if len(chunk) else np.zeros(0, bool)
    spread = np.repeat(odd_chunk, np.diff(np.append(chunk, len(data))))
    fine = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge[1:-1] |= fine & ~spread[1:] & ~spread[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = plain[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.where(spread, data, _LOWER[data]), spread[starts]


class PieceModel:
    """The vocabulary's ids of single pieces."""

    def __init__(self, path: str) -> None:
        self.tokenizer = tokenizer(path)
        self.model, self.names = self.tokenizer.model, _byte_names()

    def ids(self, pieces: list[bytes], odd: list[bool]) -> list[list[int]]:
        """Letters, a digit or ASCII signs go straight to the vocabulary's model, what is odd through all its rules."""
        strange = iter(self.tokenizer.encode_batch_fast([p.decode() for p, o in zip(pieces, odd, strict=True) if o], add_special_tokens=False))
        split, names = self.model.tokenize, self.names
        return [
            next(strange).ids
            if o
            else [t.id for t in split(p.decode() if p.isascii() else p.decode().lower().encode().decode("latin-1").translate(names))]
            for p, o in zip(pieces, odd, strict=True)
        ]


class PieceEncoder:
    """Encodes batches of texts for a vocabulary with word ends that drops white space."""

    def __init__(self, path: str) -> None:
        self.pieces, self.hasher = PieceModel(path), SpanHasher()
        self.key = np.zeros(SLOTS, np.uint64)
        self.start, self.length = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.ids, self.used = np.zeros(1 << 20, np.uint16), 0

    def _learn(self, slots: np.ndarray, keys: np.ndarray, pieces: list[bytes], odd: list[bool]) -> None:
        new = self.pieces.ids(pieces, odd)
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        flat = np.fromiter((i for ids in new for i in ids), np.uint16, int(lengths.sum()))
        if self.used + len(flat) > 8 * SLOTS:
            raise BufferError
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint16)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.key[slots], self.length[slots] = keys, lengths
        self.start[slots] = self.used + np.cumsum(lengths) - lengths
        self.used += len(flat)

    def _forget(self) -> None:
        self.key[:], self.used = 0, 0

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, folded, odd = split_pieces(data, bounds)
        keys = self.hasher(folded, starts, ends) | np.uint64(1)
        slots = (keys >> np.uint64(64 - 20)).astype(np.int64)
        ids, counts = [], np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(todo):
            miss = todo[self.key[slots[todo]] != keys[todo]]
            if len(miss):
                _, first = np.unique(keys[miss], return_index=True)
                first = miss[first]
                _, one = np.unique(slots[first], return_index=True)  # two new pieces of one slot take turns
                first = first[one]
                raw = folded.tobytes()
                pieces = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                try:
                    self._learn(slots[first], keys[first], pieces, odd[first].tolist())
                except BufferError:
                    self._forget()
                    self._learn(slots[first], keys[first], pieces, odd[first].tolist())
            have = todo[self.key[slots[todo]] == keys[todo]]
            counts[have] = self.length[slots[have]]
            parts.append((have, self.ids[ragged(self.start[slots[have]], counts[have])]))
            todo = np.setdiff1d(todo, have, assume_unique=True) if len(have) < len(todo) else todo[:0]
        if len(parts) == 1:
            ids = parts[0][1]
        else:
            before = np.cumsum(counts) - counts
            ids = np.zeros(int(counts.sum()), np.uint16)
            for have, flat in parts:
                ids[ragged(before[have], counts[have])] = flat
        total = np.concatenate([[0], np.cumsum(counts)])
        return ids, total[np.searchsorted(starts, bounds)]

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows end to end and the offset of each row."""
        data, bounds = text_bytes(column)
        edges, ids, offsets = cuts(data, bounds), [], []
        for a, b in zip(edges, edges[1:], strict=False):
            inner = bounds[np.searchsorted(bounds, a, "left") : np.searchsorted(bounds, b, "left")]
            found, at = self._encode(data[a:b], np.append(inner, b) - a)
            offsets.append(at[:-1] + sum(map(len, ids)))
            ids.append(found)
        flat = np.concatenate(ids) if ids else np.zeros(0, np.uint16)
        got = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
        return flat, np.append(got, np.full(len(bounds) - len(got), len(flat), np.int64))


def piece_encoder(path: str) -> PieceEncoder:
    return per_process(("pieces", path), lambda: PieceEncoder(path))


def _leaves(text: str, leaf_chars: int) -> list[tuple[int, int]]:
    """Halve until no part is longer than ``leaf_chars``; a cut moves past marks that might compose."""
    parts = [(0, len(text))]
    while max(b - a for a, b in parts) > leaf_chars:
        halves = []
        for a, b in parts:
            middle = (a + b) // 2
            while middle < b and ord(text[middle]) >= 0x300:
                middle += 1
            halves += [(a, middle), (middle, b)] if b - a > leaf_chars and a < middle < b else [(a, b)]
        if len(halves) == len(parts):
            break
        parts = halves
    return parts


Tokens = tuple[list[int], list[int], list[int]]  # ids, first character, end


def _encoded(tok, text: str, at: int) -> Tokens:
    found = tok.encode(text, add_special_tokens=False)
    offsets = found.offsets
    return found.ids, [at + a for a, _ in offsets], [at + b for _, b in offsets]


def _common(one: Tokens, two: Tokens, low: int, high: int) -> tuple[int, int] | None:
    """Where two neighbouring tokens within ``low … high`` are the same in both."""
    places = {}
    for n in range(len(one[0]) - 1):
        if one[1][n] >= low and one[2][n + 1] <= high:
            places[one[0][n], one[0][n + 1], one[1][n], one[2][n], one[1][n + 1], one[2][n + 1]] = n
    for m in range(len(two[0]) - 1):
        n = places.get((two[0][m], two[0][m + 1], two[1][m], two[2][m], two[1][m + 1], two[2][m + 1]))
        if n is not None:
            return n, m
    return None


def join_tokens(tok, text: str, left: Tokens, right: Tokens, begin: int, cut: int, end: int, window: int = 64) -> Tokens:
    """Tokens of ``text[begin:end]`` from those of ``text[begin:cut]`` and ``text[cut:end]``."""
    while True:
        a, b = max(begin, cut - window), min(end, cut + window)
        around = _encoded(tok, text[a:b], a)
        margin = min(16, window // 4)
        into = (0, 0) if a == begin else _common(tuple(x[_from(left, a) :] for x in left), around, a + margin, cut - margin)
        out = (0, 0) if b == end else _common(around, tuple(x[: _upto(right, b)] for x in right), cut + margin, b - margin)
        if into and out:
            first = 0 if a == begin else _from(left, a) + into[0] + 1
            m = 0 if a == begin else into[1] + 1
            last = len(around[0]) if b == end else out[0] + 1
            rest = len(right[0]) if b == end else out[1] + 1
            return tuple(x[:first] + y[m:last] + z[rest:] for x, y, z in zip(left, around, right, strict=True))
        window *= 2


def _from(tokens: Tokens, at: int) -> int:
    return int(np.searchsorted(tokens[1], at))


def _upto(tokens: Tokens, at: int) -> int:
    return int(np.searchsorted(tokens[2], at, "right"))


def concatenate(tok, text: str, parts: list[tuple[int, int, Tokens]]) -> list[int]:
    """Join neighbours pairwise until one part is left."""
    while len(parts) > 1:
        joined = [
            (a, d, join_tokens(tok, text, one, two, a, b, d))
            for (a, b, one), (_, d, two) in zip(parts[::2], parts[1::2], strict=False)
        ]
        parts = joined + parts[len(joined) * 2 :]
    return parts[0][2][0]


def encode(
    docs: DataFrame,
    path: str,
    finish: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]],
    schema: str,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """Encode every text; ``finish`` gets the kept columns of a batch, its ids end to end and each row's offset.

    Rows with texts of up to ``leaf_chars`` characters need no shuffle. Longer ones are known by their digest, which
    a task that runs again gives again; every different one is encoded once, its leaves shuffled and gathered by digest.
    """
    names = [*keep]
    body = f"body_{uuid.uuid4().hex}"
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(body))
    short, long = rows.where(F.length(body) <= leaf_chars), rows.where(F.length(body) > leaf_chars)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(path)
        for batch in batches:
            if batch.num_rows:
                for a, b in slices(text_bytes(batch.column(len(names)))[1], PART):
                    part = batch.slice(a, b - a)
                    yield from finish(part.select(names), *encoder(part.column(len(names))))
                tidy()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, value in enumerate(batch.column(1).to_pylist()):
                for a, b in _leaves(value, leaf_chars):
                    yield pa.RecordBatch.from_pydict(
                        {"row": batch.column(0).slice(n, 1), "a": [a], "b": [b], "leaf": [value[a:b]]}
                    )

    def leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for row in batch.to_pylist():
                ids, first, end = _encoded(tok, row["leaf"], row["a"])
                lists = {k: pa.array([v], pa.list_(pa.int32())) for k, v in (("ids", ids), ("first", first), ("ends", end))}
                yield pa.RecordBatch.from_pydict({k: [row[k]] for k in ("row", "a", "b", "leaf")} | lists)

    def gather(found: pa.Table) -> pa.Table:
        parts = sorted(found.to_pylist(), key=lambda x: x["a"])
        whole = "".join(p["leaf"] for p in parts)
        ids = concatenate(tokenizer(path), whole, [(p["a"], p["b"], (p["ids"], p["first"], p["ends"])) for p in parts])
        return pa.table({"row": [parts[0]["row"]], "ids": pa.array([np.array(ids, np.uint16).tobytes()], pa.binary())})

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                data, offsets = text_bytes(batch.column(len(names)))
                yield from finish(batch.select(names), np.frombuffer(data.tobytes(), np.uint16), offsets // 2)

    row = f"row_{uuid.uuid4().hex}"
    long = long.withColumn(row, F.sha2(body, 256))
    texts = long.select(F.col(row).alias("row"), body).dropDuplicates(["row"])
    leaves = texts.mapInArrow(split, "row string, a long, b long, leaf string")
    leaves = leaves.repartition("row", "a").mapInArrow(
        leaf, "row string, a long, b long, leaf string, ids array<int>, first array<int>, ends array<int>"
    )
    ids = leaves.groupBy("row").applyInArrow(gather, "row string, ids binary")
    long = long.drop(body).join(ids.withColumnRenamed("row", row), row).select(*keep, "ids").mapInArrow(gathered, schema)
    return short.mapInArrow(direct, schema).unionByName(long)


def token_strings(path: str) -> list[str]:
    tok = tokenizer(path)
    return [tok.id_to_token(i) or "" for i in range(tok.get_vocab_size(with_added_tokens=True))]


def decode(ids: list[int], strings: list[str]) -> str:
    """What the library's ``decode`` gives for a vocabulary without a decoder: tokens joined by a space."""
    return " ".join([strings[i] for i in ids])
