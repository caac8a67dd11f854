"""Token counts against the library, with and without the table of frequent pieces."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ratingloom.llm.counts import LengthTable, Summary, count_tokens
from ratingloom.llm.q_counts import QUERIES

SF_DIR = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
LIMIT = 2048


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def brute(library, rows) -> list[tuple]:
    texts = [t or "" for _, t in rows]
    found = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    return sorted(map(str, ((i, len(t.encode()), n, n > LIMIT) for (i, _), t, n in zip(rows, texts, found, strict=True))))


def got(df) -> list[str]:
    return sorted(map(str, map(tuple, df.collect())))


def test_whole_table_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert got(QUERIES["op11_counts"](spark, SF_DIR)) == brute(library, rows)


@pytest.mark.parametrize("most", [1, 8, 1 << 15])
def test_edge_rows(spark, library, most):
    texts = [None, "", " \t\n", " ", "I'll don't we've", "<|endoftext|>", "a<|startoftext|>b <|end", "1234 5.6", "Ünïcödé ÉTÉ œuf"]
    texts += ["日本語 テキスト", "é e ́x", "\x00\x1f\x85", "ﬁ Σίσυφος ΣΑΣ", "word " * 2100, "x" * 5000, "tab\tnew\nline", "ab" * 40_000 + " end"]
    texts += ["many words with no end " * 30_000, "!?!? ... --- ???", "😀😀 👩‍👩‍👧"]
    rows = [(n, t) for n, t in enumerate(texts * 3)] + [(None, "null id"), (4, "same"), (4, "same")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_tokens int")
    assert got(count_tokens(docs, PATH, LIMIT, most=most)) == brute(library, rows)


def test_empty_table(spark):
    found = count_tokens(spark.createDataFrame([], "doc_id long, text string, id int"), PATH, LIMIT)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert found.count() == 0


def test_only_summaries_are_shuffled(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert "Exchange" not in count_tokens(docs, PATH, LIMIT)._jdf.queryExecution().executedPlan().toString()


def test_length_table_holds_all_even_when_slots_meet():
    rng = np.random.default_rng(3)
    keys = np.unique(np.concatenate([rng.integers(1, 1 << 63, 3000, dtype=np.uint64), np.arange(1, 500, dtype=np.uint64)]))
    table = LengthTable(keys, np.arange(len(keys), dtype=np.int32))
    assert table(keys).tolist() == list(range(len(keys)))
    assert (table(keys + np.uint64(1 << 20))[~np.isin(keys + np.uint64(1 << 20), keys)] == -1).all()


def test_summary_keeps_every_frequent_piece_in_any_order():
    rng = np.random.default_rng(5)
    common = np.repeat(np.arange(1, 31, dtype=np.uint64), 60)
    rare = np.arange(1000, 3000, dtype=np.uint64)
    keys = np.concatenate([common, rare])
    for order in (np.arange(len(keys)), rng.permutation(len(keys))):
        summary = Summary(64)
        for part in np.array_split(keys[order], 23):
            summary.add(part, lambda at: np.ones(len(at), np.int32))
        assert set(range(1, 31)) <= set(summary.key.tolist()) and len(summary.key) <= 64
        assert (summary.count[np.isin(summary.key, common)] <= 60).all()
