"""Every registered query against its SQL on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import oracles
from oracle_check import differences

SF_DIR = "/root/testdata/sf0.001"
ORACLES = oracles.oracle_sql()


def test_every_query_has_sql():
    added = set(entry.llm_registry.queries()) if entry.llm_registry else set()
    assert set(entry.queries()) - added == set(ORACLES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    rows, different = differences(spark, SF_DIR, entry.queries()[name], ORACLES[name])
    assert rows > 0
    assert different == []


def test_entry_scores_the_known_number_of_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["userId", "itemId", "actual_rating", "pred_rating"]
    assert found.count() == 536
