"""Query op7: every document packed into sequences of 2048 tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm.packing import pack
from ratingloom.llm.tables import table

VOCABULARY = "word_bpe_49k.json"


def packed(docs: DataFrame) -> DataFrame:
    pieces = pack(docs, public_tokenizers.path(VOCABULARY), window=2048, end_id=1)
    columns = ["doc_tokens", "sequence_id", "offset"]
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), *columns)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))


QUERIES = {"op7_packing": op7_packing}
SQL: dict[str, str] = {}
