"""Encoding and decoding against the library, whole texts and texts cut into leaves."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratingloom.llm.q_bpe import QUERIES, digests

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows) -> list[str]:
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded)]
        out.append(str((doc_id, len(ids), *shas)))
    return sorted(out)


def got(df) -> list[str]:
    return sorted(map(str, map(tuple, df.collect())))


def test_whole_table_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op2_bpe"](spark, SF_DIR)) == brute(library, rows)


@pytest.mark.parametrize("leaf_chars", [64, 1 << 16])
def test_edge_rows_whole_and_in_leaves(spark, library, leaf_chars):
    texts = [None, "", " ", "I'll don't we've", "<|endoftext|>", "1234 5.6 " * 30, "Ünïcödé ÉTÉ œuf " * 20, "日本語 テキスト" * 30]
    texts += ["é e ́x " * 40, "x" * 500, "unhappiness" * 60, "a <|endoftext|> b " * 25, "!?!? ... --- ???" * 20, "😀😀 👩‍👩‍👧" * 12]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[6]), (3, texts[6])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, row int")
    assert got(digests(docs, PATH, leaf_chars=leaf_chars)) == brute(library, rows)


def test_empty_table(spark):
    assert digests(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_long_texts_are_known_by_content_not_by_place(spark):
    docs = spark.createDataFrame([(1, "x" * 500)], "doc_id long, text string").repartition(3)
    plan = digests(docs, PATH, leaf_chars=64)._jdf.queryExecution().executedPlan().toString()
    assert "monotonically_increasing_id" not in plan and "sha2" in plan
