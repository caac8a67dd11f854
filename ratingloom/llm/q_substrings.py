"""Query op10: words left of every document once windows of earlier documents are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.substrings import without_repeats
from ratingloom.llm.tables import table


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), "r", least=13)
    return found.select("doc_id", "r.n_words", "r.n_removed", F.sha2(F.col("r.kept").cast("binary"), 256).alias("kept_sha256"))


# DuckDB's regular expressions read \t-\r as characters 9-13.
SQL = {
    "op10_substrings": """
WITH d AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+') AS w FROM documents
), grams AS (
  SELECT doc_id, text, unnest(generate_series(1, len(w) - 12)) AS p, w FROM d WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, text, p, md5(array_to_string(list_slice(w, p, p + 12), ' ')) AS g FROM grams
), firsts AS (
  SELECT g, min(doc_id) AS first_id FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, text, unnest(generate_series(p, p + 12)) AS p
  FROM windows JOIN firsts USING (g) WHERE doc_id > first_id
), lost AS (
  SELECT doc_id, text, list(p) AS ps FROM gone GROUP BY doc_id, text
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(list_transform(
    list_filter(generate_series(1, len(w)), lambda i: ps IS NULL OR NOT list_contains(ps, i)), lambda i: w[i]), ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost ON d.doc_id = lost.doc_id AND d.text = lost.text
""",
}

QUERIES = {"op10_substrings": op10_substrings}
