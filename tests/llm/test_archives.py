"""WARC archives: round trips at every split, revisits, and reading by many tasks."""

from __future__ import annotations

import base64
import hashlib

import pytest
from oracle_check import differences

from ratingloom.llm.archives import MAGIC, read_archives, write_archives

from ratingloom.llm.q_archives import QUERIES, SQL
from ratingloom.staging import Workspace

SF_DIR = "/root/testdata/sf0.001"


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, url, html in rows:
        lead = first.get(html or "")
        refers = None if page is None or page == lead else lead
        data = (html or "").encode()
        out.append((page, "response" if refers is None else "revisit", len(data), sha1(data), refers, None if refers is not None else data))
    return sorted(out, key=str)


def read(spark, rows, **how):
    folder = Workspace(spark).path("archives")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "'x' AS record_type")
    write_archives(pages.repartition(2), folder, revisit_from=0)
    found = read_archives(spark, folder, **how)
    columns = ["page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in found.select(columns).collect()]
    return sorted(got, key=str), found


ROWS = [
    (3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, "same"), (9, "http://a\r\n/9", None), (8, "u", ""),
    (None, "u", "same"), (5, "u", "ünï code 🎈"), (6, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 50),
    (7, "u", "x" * 300_000), (10, "u", MAGIC.decode("latin-1") * 500), (4, "u", "one"), (4, "u", "one"),
]


@pytest.mark.parametrize("split", [64, 1_000, 8 << 20])
def test_round_trip_at_every_split(spark, split):
    assert read(spark, ROWS, split_bytes=split)[0] == brute(ROWS)


def test_empty_table(spark):
    folder = Workspace(spark).path("archives")
    write_archives(spark.createDataFrame([], "page_id long, url string, html string"), folder, revisit_from=0)
    assert read_archives(spark, folder).count() == 0


def test_ranges_are_read_by_many_tasks(spark):
    rows = [(n, "u", hashlib.sha256(str(n).encode()).hexdigest() * 40) for n in range(200)]
    got, found = read(spark, rows, split_bytes=2_000)
    assert got == brute(rows)
    tasks = found.rdd.glom().map(len).collect()
    assert len(tasks) >= 16 and sum(n > 0 for n in tasks) >= 8 and max(tasks) < len(rows) / 4


def test_query_equals_sql(spark):
    rows, different = differences(spark, SF_DIR, QUERIES["op8_warc"], SQL["op8_warc"])
    assert rows > 0 and different == []
