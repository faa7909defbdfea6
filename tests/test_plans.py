"""Plans and determinism: no pairs of everything, no Python rows, the same rows however it is split."""

import re

import pytest

from workload import catalog_queries, check_queries, scan_queries  # noqa: F401
from workload.registry import QUERIES


@pytest.mark.parametrize("name", ["J7_unused", "U1_missing", "J12_route_by_pattern", "P16_full_key", "A10_canonical_documents"])
def test_plan_shape(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
        assert bad not in plan, bad


@pytest.mark.parametrize("name", ["J3_missing_diff", "J8_eq_base"])
def test_same_rows_for_any_split(spark, sf_dir, name):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    out = []
    try:
        for parts, threshold in (("1", "-1"), ("50", "10485760")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            out.append(sorted(map(str, QUERIES[name](spark, sf_dir).collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert out[0] == out[1]


def test_health_shares_its_work(spark, sf_dir):
    """Five checks on one context: the plan reads and shuffles little more than once for each use of a shared table."""
    plan = QUERIES["A7_health"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan|Scan parquet", plan)) <= 28
    assert len(re.findall(r"\bExchange\b", plan)) <= 26
