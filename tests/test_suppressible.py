"""Findings that rules may suppress: made for the keys that a rule matches, the same rules hit as by all findings."""

from pyspark.sql import functions as F

from polyglint.operators import catalog as C
from polyglint.operators import checks as H
from polyglint.operators import rules as R
from polyglint.operators import usage as U
from workload import check_queries as Q
from workload import relations as W

OCC = "project string, path string, pos long, line_num long, key string, candidate_keys array<string>, kind string"
KEYS = {"en": ["a.one", "a.other", "b.one", "b.other", "c", "d.e", "g"], "de": ["a.one", "a.other", "b.one", "b.other", "c", "z"]}


def inputs(spark):
    rows = [("p", loc, k.split("."), k, "str", f"{k} %{{n}}" if loc == "en" else k, "f.yml", 0, False) for loc, keys in KEYS.items() for k in keys]
    tr = spark.createDataFrame(rows, "project string, locale string, segments array<string>, key string, value_type string, value string, path string, ordinal long, external boolean")
    occ = spark.createDataFrame([("p", "f.rb", 1, 1, "b.one", ["b.one"], "key"), ("p", "f.rb", 2, 2, "m.x", ["m.x", "c"], "key"), ("p", "f.rb", 3, 3, "m.y", ["m.y"], "key")], OCC)
    loc = spark.createDataFrame([("p", "en", 0, True), ("p", "de", 1, False)], "project string, locale string, locale_rank int, is_base boolean")
    settings = ["ignore", "ignore_missing", "ignore_unused", "ignore_eq_base", "ignore_inconsistent_interpolations"]
    patterns = ["a.one", "a", "b.one", "b.other", "c", "d.*", "g", "z", "m.x", "m.y", "m.:", "none.*"]
    rules = [("p", 10 * i + j, s, p, None) for i, p in enumerate(patterns) for j, s in enumerate(settings)] + [("p", 900, "ignore_missing", "d.*", "en"), ("p", 901, "ignore_missing", "d.*", "de")]
    return tr, occ, loc, spark.createDataFrame(rules, "project string, rule_id bigint, setting string, pattern string, locale_group string")


def every_finding(spark, tr, occ, loc):
    parts = {
        "missing": H.missing(occ, tr, C.plural_dim(spark), None, loc), "unused": H.unused(tr, occ, None, loc),
        "eq_base": H.eq_base(tr, None, loc), "interpolations": H.inconsistent_placeholders(tr, None, loc),
    }
    return U.merge_scans(*[p.select("project", F.lit(k).alias("kind"), "locale", "key") for k, p in parts.items()])


def test_same_rules_are_stale(spark, monkeypatch):
    tr, occ, loc, rules = inputs(spark)
    expected = sorted(r["rule_id"] for r in R.stale_rules(rules, every_finding(spark, tr, occ, loc)).collect())
    assert 900 in expected and 901 not in expected and 2 in expected, "a form is no finding where its whole node is one"
    for limit in (R.LITERAL_RULES, 0):
        monkeypatch.setattr(R, "LITERAL_RULES", limit)
        found = H.suppressible(occ, tr, C.plural_dim(spark), rules, loc)
        assert sorted(r["rule_id"] for r in R.stale_rules(rules, found).collect()) == expected


def test_only_concerned_findings_are_made(spark):
    tr, occ, loc, rules = inputs(spark)
    few = rules.where("pattern = 'd.*'")
    found = {(r["kind"], r["locale"], r["key"]) for r in H.suppressible(occ, tr, C.plural_dim(spark), few, loc).collect()}
    assert found == {("missing", "de", "d.e"), ("unused", "en", "d.e")}


def test_catalog_meets_rules_before_it_moves(spark, sf_dir, monkeypatch):
    """What goes into the query's findings has been through the rules: nearly all of the catalog stays where it is."""
    seen = []
    monkeypatch.setattr(R, "stale_rules", lambda rules, findings: seen.append(findings) or findings)
    Q.stale_rules(spark, sf_dir)
    rules = R.listed(W.rules(spark, sf_dir))
    for kind in R.KINDS:
        rows = seen[0].where(F.col("kind") == kind)
        assert rows.where(~R.may_match(rules, kind)).isEmpty()
