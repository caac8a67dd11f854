"""Query op8: every page written to WARC archives and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm.archives import read_archives, write_archives
from ratingloom.llm.tables import table
from ratingloom.staging import Workspace


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Workspace(spark).path("archives")
    write_archives(table(spark, sf_dir, "pages"), folder, revisit_from=0)
    return read_archives(spark, folder, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
_BITS = "".join(f"{n:04b}" for n in range(16))
_BIT = " + ".join(f"{16 >> k} * CAST(substr(bits, 5 * i + {k + 1}, 1) AS INTEGER)" for k in range(5))

SQL = {
    "op8_warc": f"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT page_id, n, min(page_id) OVER (PARTITION BY h) AS first_id,
    array_to_string(list_transform(regexp_extract_all(h, '.'),
      lambda c: substr('{_BITS}', 4 * strpos('0123456789abcdef', c) - 3, 4)), '') AS bits
  FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(generate_series(0, 31),
    lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_BIT}, 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b
""",
}
