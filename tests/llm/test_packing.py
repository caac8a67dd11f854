"""Packing against the tokenizers library, and documents that belong together from different files."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratingloom.llm.packing import SHARD_ROWS, _shards_of, pack, routes
from ratingloom.llm.q_packing import VOCABULARY, packed

PATH = public_tokenizers.path(VOCABULARY)
WORDS = ["river", "stone", "garden", "window", "market", "letter", "music", "winter", "paper", "silver", "mountain", "school"]


def prose(seed: int, n: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join(WORDS[k] for k in draw.integers(0, len(WORDS), n))


def expected_ids(text: str | None) -> list[int]:
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces: list, texts: dict[int, str | None], window: int = 2048) -> None:
    """Every id lies in exactly one piece, sequences are gapless and need no padding."""
    sequences: dict[int, list] = {}
    for p in pieces:
        sequences.setdefault(p["sequence_id"], []).append(p)
    for rows in sequences.values():
        end = 0
        for p in sorted(rows, key=lambda p: p["offset"]):
            assert p["offset"] == end
            end += p["length"]
        assert end == window or (end < window and end & (end - 1) == 0)
    for doc, text in texts.items():
        ids, end = expected_ids(text), 0
        for p in sorted((p for p in pieces if p["doc_id"] == doc), key=lambda p: p["start"]):
            assert p["start"] == end and p["doc_tokens"] == len(ids)
            end += p["length"]
            wanted = np.array(ids[p["start"] : end], "<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(wanted)
        assert end == len(ids)


def test_every_id_is_packed_once(spark):
    texts = {n: prose(n, 3 + 97 * n % 500) for n in range(40)}
    texts |= {100: None, 101: "", 102: "z" * 40_000, 103: prose(5, 9_000), 104: texts[3], 105: texts[3]}
    docs = spark.createDataFrame([(k, t, "x", b"y") for k, t in texts.items()], "doc_id long, text string, ids string, own binary")
    pieces = packed(docs.repartition(3)).collect()
    check(pieces, texts)
    assert sum(p["length"] for p in pieces) == sum(len(expected_ids(t)) for t in texts.values())


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, prose(1, 50)), (None, None), (7, prose(2, 60)), (7, prose(2, 60))]
    pieces = packed(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(p["length"] for p in pieces) == sum(len(expected_ids(t)) for _, t in rows)


def test_empty_table(spark):
    assert packed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_like_documents_of_different_files_share_a_sequence(spark, parts):
    """Two documents about one rare thing lie in the first and the last file, hundreds of others between them."""
    rare = "zygote quasar obelisk marzipan"
    texts = {n: prose(n, 60) for n in range(1, 600)}
    texts |= {0: f"{rare} {prose(700, 40)}", 600: f"{prose(800, 40)} {rare}"}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").coalesce(1).repartitionByRange(parts, "doc_id")
    pieces = pack(docs, PATH, window=256).collect()
    lies = {n: {p["sequence_id"] for p in pieces if p["doc_id"] == n} for n in (0, 600)}
    assert lies[0] & lies[600]


def test_routes_are_the_rarest_shared_ids():
    rank = np.full(1 << 16, 0xFFFF, np.uint16)
    rank[[5, 6, 7, 8, 9]] = [4, 3, 2, 1, 0]
    ids = np.array([5, 9, 5, 8, 7, 6, 40, 9, 5, 41], np.uint16)
    found = routes(ids, np.array([0, 6, 9, 10, 10]), rank)
    assert found.tolist() == [1 << 32 | 2 << 16 | 3, 4 << 32 | 0xFFFFFFFF, 2**64 - 1, 2**64 - 1]


def test_shards_of_many_tiny_rows_are_cut_by_rows():
    parts = list(_shards_of(np.arange(SHARD_ROWS * 2 + 11) * 2))
    assert all(b - a <= SHARD_ROWS for a, b in parts)
    assert parts[0][0] == 0 and parts[-1][1] == SHARD_ROWS * 2 + 10
    assert all(x[1] == y[0] for x, y in zip(parts, parts[1:], strict=False))
