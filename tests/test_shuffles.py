"""What the steps that many queries share may move."""

import re

from polyglint.operators import catalog as C
from polyglint.operators import usage as U
from workload import relations as W
from workload.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plural_forms_combine_before_they_move(spark, sf_dir):
    """Object aggregates sort their input once they hold some groups; forms are bits instead."""
    plan = executed(C.plural_flags(W.own_catalog(spark, sf_dir)))
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_depluralize_moves_keys_once(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        from workload import check_queries  # noqa: F401

        plan = executed(QUERIES["J10_depluralize"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall("ShuffledHashJoin", plan)) == 1
    keyed = [line for line in plan.splitlines() if "SortMergeJoin" in line and "parent" in line]
    assert not keyed


def test_depluralize_reads_own_locale_then_base(spark):
    rows = [("p", "en", "a.one"), ("p", "en", "a.other"), ("p", "de", "a.one"), ("p", "de", "a.title"), ("p", "fr", "b.one"), ("p", "en", "b.x")]
    tr = spark.createDataFrame(rows, "project string, locale string, key string")
    loc = spark.createDataFrame([("p", "en", True), ("p", "de", False), ("p", "fr", False), ("p", "ja", False)], "project string, locale string, is_base boolean")
    asked = [("p", "en", "a.one"), ("p", "de", "a.one"), ("p", "ja", "a.few"), ("p", "fr", "b.one"), ("p", "en", "b.one"), ("p", "ja", "b.one"), ("p", "ja", "a.title"), ("p", "ja", None), ("p", "ja", "one")]
    got = {(r[1], r[2]): r[3] for r in C.depluralize(spark.createDataFrame(asked, "project string, locale string, key string"), tr, loc).collect()}
    assert len(got) == len(asked)
    assert got == {
        ("en", "a.one"): "a", ("de", "a.one"): "a.one", ("ja", "a.few"): "a", ("fr", "b.one"): "b", ("en", "b.one"): "b.one", ("ja", "b.one"): "b.one",
        ("ja", "a.title"): "a.title", ("ja", None): None, ("ja", "one"): "one",
    }


def test_only_sections_are_copied(spark):
    """A used key with nothing below it meets no copy of itself."""
    keys = spark.createDataFrame([("p", "a.b.c"), ("p", "x.y"), ("p", "q.r.s")], "project string, key string")
    used = spark.createDataFrame([("p", "a.b"), ("p", "x.y"), ("p", "other.k")], "project string, key string")
    sections = U._used_sections(used, U.section_nodes(keys))
    assert {(r["section"]) for r in sections.collect()} == {"a.b"}
    occ = spark.createDataFrame([("p", "a.b", ["a.b"], "key"), ("p", "a", ["a"], "key"), ("p", "x.y", ["x.y"], "key")], "project string, key string, candidate_keys array<string>, kind string")
    assert sorted(r["key"] for r in U.used_by_ancestor(keys, occ).collect()) == ["a.b.c", "x.y"]
