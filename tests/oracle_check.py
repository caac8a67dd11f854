"""Compare a registered query with its SQL as multisets of rows."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def as_counter(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return [columns[n] for n in order], Counter(tuple(row[n] for n in order) for row in rows)


def differences(spark, sf_dir: str, query, sql: str) -> tuple[int, list]:
    """Row count of the query and some rows that only one side has."""
    found = query(spark, sf_dir)
    names, got = as_counter(found.columns, (tuple(r) for r in found.collect()))
    result = oracle_connection(sf_dir).execute(sql)
    oracle_names, want = as_counter([d[0] for d in result.description], result.fetchall())
    assert names == oracle_names
    return sum(got.values()), [("extra", r) for r in list((got - want))[:3]] + [("missing", r) for r in list((want - got))[:3]]
