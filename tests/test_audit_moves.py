"""What an audit moves: keys once with their locales, and no column that nobody asks for."""

from polyglint.operators import checks as H
from polyglint.operators import rules as R
from workload import relations as W


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unused_keys_leave_values_behind(spark, sf_dir):
    found = H.unused(W.catalog(spark, sf_dir), W.occurrences(spark, sf_dir), None, W.locale_dim(spark, sf_dir))
    assert " value#" not in optimized(found.select("project", "locale", "key")).replace("[value#", " value#")


def test_stored_documents_are_made_once(spark, sf_dir):
    once = optimized(W.stored_docs(spark, sf_dir).where("path not like '%stray.yml'")).count("Window [")
    assert 0 < optimized(W.stored_docs(spark, sf_dir)).count("Window [") <= once


def test_missing_keys_are_rows_of_keys_not_of_locales(spark):
    """Locales that hold or ignore any candidate of a key are gathered; a key's first place comes along."""
    tr = spark.createDataFrame(
        [("p", loc, k.split("."), k, "str", "v", "f.yml", 0, False) for loc, k in (("en", "a.b"), ("de", "a.b"), ("de", "c"), ("fr", "d"))],
        "project string, locale string, segments array<string>, key string, value_type string, value string, path string, ordinal long, external boolean",
    )
    calls = [("x.rb", 9, 3, "a.b", ["a.b"]), ("x.rb", 5, 2, "m", ["m", "c"]), ("w.rb", 7, 4, "m", ["m.x"]), ("z.rb", 1, 1, "a", []), ("z.rb", 2, 1, "n.o", ["n.o", "d"]), ("z.rb", 3, 1, None, [])]
    occ = spark.createDataFrame([("p", path, pos, line, k, c, "key") for path, pos, line, k, c in calls], "project string, path string, pos long, line_num int, key string, candidate_keys array<string>, kind string")
    loc = spark.createDataFrame([("p", "en", 0, True), ("p", "de", 1, False), ("p", "fr", 2, False)], "project string, locale string, locale_rank int, is_base boolean")
    rules = spark.createDataFrame([("p", 1, "ignore_missing", "n.*", "en")], "project string, rule_id bigint, setting string, pattern string, locale_group string")
    found = H.missing_used(occ, tr, R.listed(rules), loc)
    got = {(r["locale"], r["key"], r["path"], r["line"]) for r in found.collect()}
    assert got == {("fr", "a.b", "x.rb", 3), ("en", "m", "w.rb", 4), ("fr", "m", "w.rb", 4), ("fr", "a", "z.rb", 1), ("de", "n.o", "z.rb", 1)}
    assert optimized(found.select("locale", "key")).count("Join") <= 3
