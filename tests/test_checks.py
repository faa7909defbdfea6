"""Audits on a small catalog with hand-made expectations, and anchor counts on the tables."""

import json

import pytest
from pyspark.sql import functions as F

from polyglint.functions import values as V
from polyglint.operators import catalog as C
from polyglint.operators import checks as H
from polyglint.operators import documents as D
from polyglint.operators import routing as T

EN = {
    "a-c": "Dash", "a.b": "Dotted", "alpha.b": "B", "alpha.c": "C", "apples.one": "%{count} apple", "apples.other": "%{count} apples",
    "days": ["Mon", "Tue"], "flag": True, "float": 1.5, "nilv": None, "num": 5, "pears.one": "One", "pears.other": "%{count}", "secret.token": "x", "zeta": "Z",
}
DE = {"alpha.b": "B", "extra": "Nur", "pears.one": "Eine"}
RU = {"apples.one": "%{count} я", "apples.other": "%{count} яб", "zeta": "Я"}


def typed(v):
    if v is None:
        return "nil", ""
    if isinstance(v, bool):
        return "bool", str(v).lower()
    if isinstance(v, (int, float)):
        return "plain", str(v)
    return ("seq", json.dumps(v)) if isinstance(v, list) else ("str", v)


@pytest.fixture(scope="module")
def small(spark):
    rows = []
    for loc, tree in (("en", EN), ("de", DE), ("ru", RU)):
        for i, (k, v) in enumerate(tree.items()):
            t, text = typed(v)
            rows.append(("p", loc, k, k.split("."), len(k.split(".")), t, text, f"config/locales/{loc}.yml", i, False))
    tr = spark.createDataFrame(rows, "project string, locale string, key string, segments array<string>, depth int, value_type string, value string, path string, ordinal bigint, external boolean")
    occ = spark.createDataFrame(
        [("p", "app/g.rb", 1, 2, 0, "used.key", "used.key", ["used.key"], "key"), ("p", "app/g.rb", 9, 3, 0, "zeta.sub", "zeta.sub", ["zeta.sub"], "key"),
         ("p", "app/h.rb", 1, 1, 0, "alpha", "alpha", ["alpha"], "key"), ("p", "app/h.rb", 5, 2, 0, "app*", "x", ["app*"], "pattern")],
        "project string, path string, pos int, line_num int, line_pos int, key string, raw_key string, candidate_keys array<string>, kind string",
    )
    rules = spark.createDataFrame([("p", 1, "ignore_missing", "secret.*", None), ("p", 2, "ignore", "nothing.*", None), ("p", 3, "ignore_unused", "a.{b,c}", "de")], "project string, rule_id bigint, setting string, pattern string, locale_group string")
    loc = spark.createDataFrame([("p", "en", 0, True), ("p", "de", 1, False), ("p", "ru", 2, False)], "project string, locale string, locale_rank int, is_base boolean")
    return tr, occ, rules, loc


def test_missing_as_nested_json(spark, small):
    """Every missing leaf under its locale, nested, sorted at each level; a map wins over a leaf."""
    tr, occ, rules, loc = small
    used = H.missing_used(occ, tr, rules, loc).select("project", "locale", F.split("key", r"\.").alias("segments"), F.lit("null").alias("json"))
    diff = H.diff_leaves(tr, rules, loc).select("project", "locale", "segments", V.json_value("value_type", "value").alias("json"))
    trees = {}
    for r in D.nested_json(used.unionByName(diff)).orderBy("locale", "head").collect():
        trees.setdefault(r["locale"], []).append(r["member"])
    got = {k: "{" + ",".join(v) + "}" for k, v in trees.items()}
    assert got["en"] == '{"extra":"Nur","used":{"key":null},"zeta":{"sub":null}}'
    assert got["de"] == (
        '{"a":{"b":"Dotted"},"a-c":"Dash","alpha":{"c":"C"},"apples":{"one":"%{count} apple","other":"%{count} apples"},"days":["Mon", "Tue"],'
        '"flag":true,"float":1.5,"nilv":null,"num":5,"used":{"key":null},"zeta":{"sub":null}}'
    )


def test_plural_unused_and_stale(spark, small):
    from polyglint.operators import rules as R

    tr, occ, rules, loc = small
    plural = {(r["locale"], r["key"], r["categories"]) for r in H.missing_plural(tr, C.plural_dim(spark), rules, loc).collect()}
    assert plural == {("de", "pears", "other"), ("ru", "apples", "few, many")}
    unused = {(r["locale"], r["key"]) for r in H.unused(tr, occ, rules, loc).collect()}
    assert unused == {("en", k) for k in ("a-c", "a.b", "days", "flag", "float", "nilv", "num", "pears", "secret.token", "zeta")} | {("de", "extra"), ("de", "pears"), ("ru", "zeta")}
    found = H.missing(occ, tr, C.plural_dim(spark), None, loc).select("project", F.lit("missing").alias("kind"), "locale", "key").unionByName(
        H.unused(tr, occ, None, loc).select("project", F.lit("unused").alias("kind"), "locale", "key")
    )
    assert {r["rule_id"] for r in R.stale_rules(rules, found).collect()} == {2, 3}


def test_canonical_document_and_plan(spark, small):
    tr, _, _, _ = small
    docs = {r["path"]: r["doc"] for r in D.canonical_documents(tr).collect()}
    assert docs["config/locales/en.yml"] == (
        "---\nen:\n  a:\n    b: Dotted\n  a-c: Dash\n  alpha:\n    b: B\n    c: C\n  apples:\n    one: \"%{count} apple\"\n    other: \"%{count} apples\"\n"
        "  days:\n  - Mon\n  - Tue\n  flag: true\n  float: 1.5\n  nilv:\n  num: 5\n  pears:\n    one: One\n    other: \"%{count}\"\n  secret:\n    token: x\n  zeta: Z\n"
    )
    before = spark.createDataFrame([("p", p, d if "ru" not in p else d + "x") for p, d in docs.items() if "de" not in p], "project string, path string, doc string")
    plan = T.write_plan(tr, before, tr)
    assert {(r["path"][-6:], r["action"]) for r in plan.collect()} == {("de.yml", "create"), ("ru.yml", "update")}
    nested = spark.createDataFrame([("p", "en", "x.yml", ["k"], "seq", '[{"name":"Ada: x","age":36},[1],null,{},"- y"]')], "project string, locale string, path string, segments array<string>, value_type string, value string")
    assert D.canonical_documents(nested).first()["doc"] == "---\nen:\n  k:\n  - name: 'Ada: x'\n    age: 36\n  - [1]\n  -\n  - {}\n  - \"- y\"\n"


def test_gates(spark, small):
    plan = spark.createDataFrame([("p", "a.yml", "delete"), ("p", "../b.yml", "update")], "project string, path string, action string")
    gates = T.refusal_gates(plan, plan.limit(0), "")
    with pytest.raises(RuntimeError, match="deletions"):
        T.check_gates(gates)


def test_anchor_counts(spark, sf_dir):
    """Counts published for the smallest tables: one project, no rules, no external catalog."""
    if not sf_dir.endswith("sf0.001"):
        pytest.skip("anchors are for sf0.001")
    from workload import relations as W

    one = lambda df: df.withColumn("project", F.lit("p"))
    tr = one(W.own_catalog(spark, sf_dir))
    occ = one(W.occurrences(spark, sf_dir).where("path like 'app/views/%'"))
    loc = one(W.locale_dim(spark, sf_dir)).distinct()
    patterns = occ.limit(1).select(
        "project", "path", "pos", "line_num", "line_pos", F.explode(F.array(*[F.lit(f"ns{n}.{s}.k*7") for n in (0, 1, 2) for s in "op"])).alias("key"), "raw_key", "candidate_keys", F.lit("pattern").alias("kind")
    )

    def count(df):
        return {r["locale"]: r["n"] for r in df.groupBy("locale").agg(F.count("*").alias("n")).collect()}

    assert count(H.unused_leaves(tr, occ.unionByName(patterns), None, loc)) == {"de": 37, "en": 32, "fr": 37, "ja": 39, "ru": 35}
    assert count(H.missing_diff(tr, None, loc)) == {"en": 213, "de": 116, "fr": 98, "ja": 75, "ru": 67}
    assert count(H.missing_plural(tr, C.plural_dim(spark), None, loc)) == {"ru": 142}
    assert count(H.eq_base(tr, None, loc)) == {"de": 392, "fr": 469, "ja": 489, "ru": 487}
    assert count(H.reserved_placeholders(tr, loc)) == {"en": 27, "de": 130, "fr": 24, "ja": 22, "ru": 20}


def test_written_documents_read_back_as_canonical(spark, tmp_path):
    from polyglint.operators import documents as D
    from polyglint.sources import sinks

    rows = [("p", "no", f"h{i % 7}.k{i}", "str", "x\ny" if i % 5 == 0 else "v", f"config/{'a~b' if i % 2 else 'a/b'}.yml") for i in range(300)]
    tr = spark.createDataFrame(rows, "project string, locale string, key string, value_type string, value string, path string").withColumn("segments", F.split("key", r"\."))
    sinks.document_sink(tr, str(tmp_path / "out"))
    written = {r.path: r.doc for r in sinks.read_documents(spark, str(tmp_path / "out")).collect()}
    assert written == {r.path: r.doc for r in D.canonical_documents(tr).collect()}
    assert all(doc.startswith("---\n'no':\n") for doc in written.values()) and len(written) == 2


def test_routes_are_refused(spark):
    from polyglint.operators import routing as T

    one = "project string, locale string, key string, destination string"
    with pytest.raises(ValueError, match="no write rule"):
        T.check_routes(spark.createDataFrame([("p", "de", "a.b", None)], one))
    with pytest.raises(ValueError, match="would hold de, en"):
        T.check_routes(spark.createDataFrame([("p", "de", "a", "x.yml"), ("p", "en", "a", "x.yml")], one))
    plan = spark.createDataFrame([("p", "x.yml", "de")], "project string, path string, locale string")
    with pytest.raises(ValueError, match="also holds fr"):
        T.check_foreign(plan, spark.createDataFrame([("p", "de", "x.yml"), ("p", "fr", "x.yml")], "project string, locale string, path string"))


def test_numbers_of_any_length_and_sequences_that_do_not_parse(spark):
    from polyglint.functions import values as V
    from polyglint.operators import checks as H

    texts = ["0x" + "f" * 40, "0b" + "1" * 200, "0xff", "-0x10"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.number_value("t")).collect()]
    assert got[2:] == ["255", "-16"] and float(got[0]) == float(16**40) and float(got[1]) == float(2**200)
    pairs = [('[{"a":1,"a":2}]', '[{"a":3,"a":4}]', False), ("[1.0]", "[1]", False), ('[{"a":1,"b":2}]', '[{"b":2,"a":1}]', True)]
    rows = spark.createDataFrame([("seq", a, b) for a, b, _ in pairs], "value_type string, a string, b string")
    same = rows.select(H._comparable("value_type", "a").eqNullSafe(H._comparable("value_type", "b")).alias("same")).collect()
    assert [r.same for r in same] == [x for _, _, x in pairs]


def test_base_is_compared_with_all_locales_whatever_is_selected(spark, small):
    tr, occ, rules, loc = small
    got = H.missing(occ, tr, C.plural_dim(spark), rules, loc, selected=loc.where("locale = 'en'")).collect()
    assert {r["locale"] for r in got} == {"en"} and "extra" in {r["key"] for r in got}
