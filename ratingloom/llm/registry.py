"""The queries of this subpackage and the SQL to check them with."""

from __future__ import annotations

import corpus_pipeline
from ratingloom.llm import (
    q_archives,
    q_bpe,
    q_counts,
    q_divergence,
    q_jaccard,
    q_languages,
    q_licences,
    q_middle,
    q_neighbours,
    q_packing,
    q_pii,
    q_quality,
    q_substrings,
)

MODULES = [
    q_quality,
    q_bpe,
    q_neighbours,
    q_licences,
    q_jaccard,
    q_languages,
    q_packing,
    q_archives,
    q_pii,
    q_substrings,
    q_counts,
    q_divergence,
    q_middle,
]


def queries() -> dict:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    whole = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return {name: sql for m in MODULES for name, sql in m.SQL.items()} | whole
