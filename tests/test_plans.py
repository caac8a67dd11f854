"""What the physical plans must and must not contain."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["item_cosine", "within_group_pairs", "lsh_item_hashes", "lsh_similarity_join_hot_users", "exact_cf_hot_users", "item_vectors"],
)
def test_no_cross_join_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert unwanted not in plan


def test_scan_reads_only_the_needed_columns(spark):
    plan = plan_of(entry.queries()["train_split"](spark, SF_DIR))
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    pushed = [set(found.split(", ")) for found in re.findall(r"PushedFilters: \[(.*?)\]", plan)]
    assert {"IsNotNull(l_partkey)", "IsNotNull(l_orderkey)"} in pushed
    assert {"IsNotNull(o_custkey)", "IsNotNull(o_orderkey)"} in pushed
