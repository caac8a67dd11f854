"""Rows of small numbers moved through Spark shuffles as one binary value per batch and bucket.

A bucket is a slice of the hash range, so buckets shrink as their number grows with ``spark.sql.shuffle.partitions``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

Layout = dict[str, str]
BLOCKS = "bucket int, kind int, block binary"


def bucket_count(spark: SparkSession) -> int:
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Number of the slice of the 64-bit range, cut into ``n``, that a hash lies in."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def deal(buckets: np.ndarray, columns: list[np.ndarray], layout: Layout, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """One block per bucket: its rows, column after column."""
    if not len(buckets):
        return
    order = np.argsort(buckets, kind="stable")
    sorted_buckets = buckets[order]
    at = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1]))
    columns = [np.ascontiguousarray(c[order], dtype=t) for c, t in zip(columns, layout.values(), strict=True)]
    edges = [*at.tolist(), len(order)]
    blocks = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(edges, edges[1:], strict=False)]
    yield pa.RecordBatch.from_pydict(
        {
            "bucket": pa.array(sorted_buckets[at], pa.int32()),
            "kind": pa.array(np.full(len(at), kind), pa.int32()),
            "block": pa.array(blocks, pa.binary()),
        }
    )


def gather(blocks: list[bytes], layout: Layout) -> list[np.ndarray]:
    """The columns of all blocks, end to end."""
    sizes = {k: np.dtype(t).itemsize for k, t in layout.items()}
    width, found = sum(sizes.values()), [[] for _ in layout]
    for block in blocks:
        n, at = len(block) // width, 0
        for column, t in zip(found, layout.values(), strict=True):
            column.append(np.frombuffer(block, t, n, at))
            at += n * np.dtype(t).itemsize
    return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(found, layout.values(), strict=True)]


def slices(bounds: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Ranges of rows with at most ``size`` bytes each, or of one row that is longer."""
    out, a, n = [], 0, len(bounds) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + size, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out


def first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted rows, which differ from the row before."""
    if not len(keys[0]):
        return np.zeros(0, bool)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new
