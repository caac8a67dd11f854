"""Query op11: tokens of every document."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ratingloom.llm.counts import count_tokens
from ratingloom.llm.tables import table

VOCABULARY, LIMIT = "word_bpe_49k.json", 2048


def op11_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), LIMIT)


QUERIES = {"op11_counts": op11_counts}
SQL: dict[str, str] = {}
