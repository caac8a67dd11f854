"""Query op13: every document cut for fill-in-middle, its output and the text rebuilt from it as digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.middle import Recipe, fill_in_middle, restore
from ratingloom.llm.tables import table

RECIPE = Recipe()


def digests(docs: DataFrame) -> DataFrame:
    return fill_in_middle(docs, RECIPE).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore("output", "form", RECIPE), 256).alias("restored_sha256"),
    )


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op13_middle": op13_middle}
SQL = {
    "op13_middle": """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), g AS (
  SELECT *, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) for i in [0, 1, 2, 3]] AS draws FROM d
), c AS (
  SELECT *, least(draws[1] % (n + 1), draws[2] % (n + 1)) AS a, greatest(draws[1] % (n + 1), draws[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR draws[3] % 100 >= 90 THEN 'plain'
         WHEN draws[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM g
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c
""",
}
