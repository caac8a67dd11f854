"""Query op2: ids and decoded text of every document as digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm.bpe import LEAF_CHARS, encode, token_strings
from ratingloom.llm.tables import table

VOCABULARY = "word_bpe_49k.json"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    made: dict[str, list[bytes]] = {}

    def finish(batch: pa.RecordBatch, ids: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not made:
            strings = token_strings(path)
            made["text"] = [s.encode() for s in strings]
            made["number"] = [str(i).encode() for i in range(len(strings))]
        number, text = made["number"].__getitem__, made["text"].__getitem__
        one, two = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            row = ids[a:b].tolist()
            one.append(hashlib.sha256(b" ".join(map(number, row))).hexdigest())
            two.append(hashlib.sha256(b" ".join(map(text, row))).hexdigest())
        yield pa.RecordBatch.from_pydict(
            {"doc_id": batch.column(0), "n_tokens": pa.array(np.diff(offsets)), "ids_sha256": one, "decoded_sha256": two}
        )

    return encode(docs, path, finish, SCHEMA, leaf_chars=leaf_chars)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op2_bpe": op2_bpe}
SQL: dict[str, str] = {}
