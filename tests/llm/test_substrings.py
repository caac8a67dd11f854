"""Repeated passages against brute force, and on edges."""

from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

from ratingloom.llm.q_substrings import op10_substrings
from ratingloom.llm.substrings import without_repeats

WIDE = "doc_id long, text string, r string, start int"
LEAST = 13


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, str]]:
    first: dict[tuple[str, ...], int] = {}
    for doc_id, text in rows:
        w = words_of(text)
        for p in range(len(w) - LEAST + 1):
            window = tuple(w[p : p + LEAST])
            first[window] = min(first.get(window, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w, gone = words_of(text), set()
        for p in range(len(w) - LEAST + 1):
            if first[tuple(w[p : p + LEAST])] < doc_id:
                gone |= set(range(p, p + LEAST))
        left = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(left.encode()).hexdigest()))
    return sorted(out)


def fixture() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(4000)}" for _ in range(n)]
    passage, short, rows = prose(60), prose(12), []
    for n in range(60):
        body = prose(rng.randrange(0, 80))
        if n % 3 == 0:
            a = rng.randrange(0, 40)
            body += passage[a : a + rng.randrange(5, 60)]
        if n % 4 == 0:
            body += short
        rows.append((n * 7 % 61, "  ".join(body + prose(rng.randrange(0, 9)))))
    rows += [(100, None), (101, ""), (102, " \t\n"), (103, "x" * 50_000), (104, "same " * 3_000), (105, "same " * 40), (106, "same " * 12)]
    rows += [(107, rows[3][1]), (107, rows[3][1])]  # a repeated row that copies an earlier document
    rows += [(108, "Ünï cödé " * 8), (109, "Ünï cödé " * 8)]
    return rows


def test_query_equals_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame([(d, t, "r", 0) for d, t in rows], WIDE).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_substrings(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect())) == brute_force(rows)


def test_many_copies_keep_one_and_order_of_ids_decides(spark):
    text = " ".join(f"a{n}" for n in range(30))
    docs = spark.createDataFrame([(1_000 - n, text, "r", n) for n in range(400)], WIDE).repartition(7)
    found = {r["doc_id"]: r["found"]["n_removed"] for r in without_repeats(docs, "found", least=LEAST).collect()}
    assert found.pop(601) == 0
    assert len(found) == 399 and set(found.values()) == {30}


def test_empty_table_null_ids_and_other_columns(spark):
    empty = without_repeats(spark.createDataFrame([], WIDE), "found", least=LEAST)
    assert empty.columns == ["doc_id", "text", "r", "start", "found"] and empty.count() == 0
    text = " ".join(f"a{n}" for n in range(30))
    rows = [(None, text, None, None), (5, text, "kept", 1), (7, None, "kept", 2)]
    found = without_repeats(spark.createDataFrame(rows, WIDE), "found", least=LEAST).collect()
    assert sorted(str((r["doc_id"], r["r"], r["found"]["n_removed"])) for r in found) == [
        "(5, 'kept', 0)",
        "(7, 'kept', 0)",
        "(None, None, 0)",
    ]
