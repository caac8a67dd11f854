"""Write pages as WARC records in gzip members and read the archives back from byte ranges.

``write_archives`` marks, of pages with equal payloads, the one with the smallest id as response and the others as
revisits of it; digests meet in one aggregation and one join, payloads are compared by SHA-1. Records are written by
Spark's own writer, so files appear only when their task has succeeded: each row is one gzip member, and the separator between
rows is an empty gzip member, so that a file as a whole is valid gzip.

``read_archives`` cuts files into byte ranges. A task looks for gzip's first bytes in its range, takes a place for a
record only if a header decodes there, and owns the records that start inside, reading past the end where needed. Files are
opened by pyarrow, so their folder must be one that it can reach from executors (a shared local folder, HDFS with
libhdfs, S3, GCS).

Null html is an empty payload. Pages without id are responses and nothing refers to them. Rows that repeat the response's id are responses
too. Line breaks in addresses become spaces. Other columns are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = MAGIC + b"\0" * 6 + b"\xff\x03\0" + b"\0" * 8
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # pages carry no date
SPLIT, AHEAD = 8 << 20, 1 << 20
PAGE = "urn:x-page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{PAGE}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url or '')}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PAGE}{refers_to}>", f"WARC-Profile: {REVISIT}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 4) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, revisit_from: int = 0) -> None:
    """Payloads of fewer than ``revisit_from`` bytes are never revisits."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha", F.sha1("payload"))
    named = rows.where(f"page_id IS NOT NULL AND octet_length(payload) >= {revisit_from}")
    first = named.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "sha", "left")
    again = F.expr(f"page_id > first_id AND octet_length(payload) >= {revisit_from}")
    marked = joined.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_pydict({"value": pa.array([member(record(*row)) for row in zip(*columns, strict=True)], pa.binary())})

    members = marked.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(folder)


class Source:
    """Bytes of a file, read ahead piece by piece."""

    def __init__(self, path: str, start: int, size: int) -> None:
        local = re.match(r"file:/+(.*)", path)
        system, name = (fs.LocalFileSystem(), "/" + local[1]) if local else fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(name)
        self.start, self.data = start, self.file.read_at(size, start)

    def more(self) -> bool:
        piece = self.file.read_at(AHEAD, self.start + len(self.data))
        self.data += piece
        return bool(piece)


def _member_at(source: Source, at: int) -> tuple[bytes, int] | None:
    """The content of the member that starts at ``at`` and where it ends; none if no record or empty member is there."""
    unpacker, found, fed = zlib.decompressobj(wbits=31), [], at
    size = 0
    try:
        while not unpacker.eof:
            if fed >= len(source.data) and not source.more():
                return None
            piece = unpacker.decompress(source.data[fed : fed + AHEAD])
            fed = min(fed + AHEAD, len(source.data))
            found.append(piece)
            size += len(piece)
            if size >= 7 and not found[0].startswith(b"WARC/1."):
                if not b"".join(found).startswith(b"WARC/1."):
                    return None
    except zlib.error:
        return None
    whole = b"".join(found)
    return (whole, fed - len(unpacker.unused_data)) if not whole or whole.startswith(b"WARC/1.") else None


def records_in(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Place and content of the records that start in a byte range."""
    source = Source(path, start, end - start + 2)
    at = 0
    while (at := source.data.find(MAGIC, at)) >= 0 and at < end - start:
        found = _member_at(source, at)
        if found is None:
            at += 1
            continue
        if found[0]:
            yield start + at, found[0]
        at = found[1]
        if at >= len(source.data):
            source.more()


def parsed(data: bytes) -> dict:
    """The fields of a record; a response whose payload does not have its digest is an error."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length: (\d+)", http)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(m[1]) if (m := re.search(rf"{PAGE}(-?\d+)>", fields.get(name, ""))) else None
    return {
        "page_id": number("WARC-Record-ID"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": kind,
        "payload_bytes": int(size[1]) if size else len(payload),
        "payload_digest": digest,
        "refers_to": number("WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


FIELDS = [
    ("page_id", "long", pa.int64()),
    ("url", "string", pa.string()),
    ("record_type", "string", pa.string()),
    ("payload_bytes", "long", pa.int64()),
    ("payload_digest", "string", pa.string()),
    ("refers_to", "long", pa.int64()),
    ("payload", "binary", pa.binary()),
]


def read_archives(spark: SparkSession, folder: str, split_bytes: int = SPLIT, payload: bool = True) -> DataFrame:
    """All records of the files in ``folder``, with their payloads if asked for."""
    fields = FIELDS if payload else FIELDS[:-1]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long")))
    ranges = files.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + split_bytes, "length").alias("end"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                waiting, size = [], 0
                for _, data in records_in(row["path"], row["start"], row["end"]):
                    waiting.append(parsed(data))
                    size += len(data)
                    if size > SPLIT:
                        yield _batch(waiting, fields)
                        waiting, size = [], 0
                yield _batch(waiting, fields)

    schema = ", ".join(f"{name} {kind}" for name, kind, _ in fields)
    n_ranges = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    tasks = min(int(n_ranges), 16 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return ranges.repartitionByRange(tasks, "path", "start").mapInArrow(scan, schema)


def _batch(rows: list[dict], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({name: pa.array([r[name] for r in rows], kind) for name, _, kind in fields})
