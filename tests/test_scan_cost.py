"""Tests on paths and texts that scans make for every file or call."""

from pyspark.sql import functions as F

from polyglint.operators import scan as S
from workload import relations as W


def test_needles_are_looked_for_without_regexes(spark, sf_dir):
    """The filter goes below the exchange that spreads small rows, into the few tasks that read them."""
    plan = S.scan_code_tags(W.tag_files(spark, sf_dir), W.ROOTS)._jdf.queryExecution().optimizedPlan().toString()
    assert f"RLIKE {S.MARKER}" not in plan
    assert r"RLIKE [^/]\.erb\z" not in plan


def test_path_tests_equal_their_regexes(spark):
    paths = ["a.rb", ".rb", "x/.rb", "x/y.rb", "x.rb/y", "a.erb", "x/.erb", "a.html.erb", "rb", "", "a", "a.b/c", "x/.hidden", "x/.hidden.js", "a.", "x/a..b", "..", "é.slim", "a.rb\n"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    old = F.when(F.col("path").rlike(r"[^/]\.rb\z"), "ruby").when(F.col("path").rlike(r"[^/]\.erb\z"), "erb").otherwise("template")
    rows = df.select("path", S.scanner_kind("path").alias("kind"), old.alias("k"), S.extension("path").alias("ext"), F.regexp_extract("path", r"[^/]\.([^./]*)\z", 1).alias("e")).collect()
    assert [(r["path"], r["kind"], r["ext"]) for r in rows] == [(r["path"], r["k"], r["e"]) for r in rows]


def test_blanks_take_as_many_bytes(spark):
    texts = ["plain text\nx", "é <b>\n日本 😀", "", " \n"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S._blank(F.col("t")).alias("b")).collect()
    assert [r["b"] for r in rows] == ["".join(c if c == "\n" else " " * len(c.encode()) for c in r["t"]) for r in rows]
