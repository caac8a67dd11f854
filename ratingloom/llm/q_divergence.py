"""Query op12: how far apart the sources of a language are, and the terms that each uses more than its language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm.divergence import audit
from ratingloom.llm.tables import table
from ratingloom.staging import Workspace


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), Workspace(spark))


QUERIES = {"op12_divergence": op12_divergence}
SQL = {
    "op12_divergence": r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (
  SELECT lang, source, r, unnest(w) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), langs AS (
  SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang
), grp AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
  SELECT lang, source, coalesce(sum(c.n), 0) AS total FROM grp LEFT JOIN c USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT lang, source, term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (totals.total + 5 * langs.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (kept.n + 5)) // (langs.total + 5 * langs.v)::HUGEINT AS q
  FROM totals JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(sums.value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value,
  CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 50
""",
}
