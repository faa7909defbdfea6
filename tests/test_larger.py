"""What grew too fast on larger tables: work done twice, and rows that carried more than their own."""

from polyglint.operators import catalog as C
from polyglint.operators import checks as H
from polyglint.operators import documents as D
from polyglint.operators import usage as U
from polyglint.plans import audit
from polyglint.plans.context import AuditContext
from polyglint.sources import sinks
from workload import check_queries  # noqa: F401
from workload import relations as W
from workload.registry import QUERIES


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(monkeypatch, owner, name):
    """How often a function is called from here on."""
    calls, real = [], getattr(owner, name)
    monkeypatch.setattr(owner, name, lambda *a, **k: (calls.append(name), real(*a, **k))[1])
    return calls


# --- documents -----------------------------------------------------------------------


def test_flatten_docs_opens_a_document_in_one_row(spark):
    """A node in a row of its own carries the names of its whole document; only leaves become rows."""
    doc = '{"en":{"a":{"b":{"c":"x","d":1e5},"e":[1,{"f":"{\\""}]},"none":null,"empty":{},"t":true,"n":12345678901234567890.50},"de":"y","fr":{"q":"}{\\\\"}}'
    docs = spark.createDataFrame([("p", "f.json", doc), ("p", "bad.json", '{"en":'), ("p", "list.json", "[1]"), ("p", "blank.json", " ")], "project string, path string, doc string")
    entries, quarantine = D.read_catalog_docs(docs)
    flat = D.flatten_docs(entries)
    assert executed(flat).count("Generate explode") == 2
    got = {(r["locale"], r["key"]): (r["depth"], r["value_type"], r["value"]) for r in flat.collect()}
    assert got == {
        ("en", "a.b.c"): (3, "str", "x"), ("en", "a.b.d"): (3, "plain", "100000.0"), ("en", "a.e"): (2, "seq", '[1,{"f":"{\\""}]'), ("en", "none"): (1, "nil", ""),
        ("en", "t"): (1, "bool", "true"), ("en", "n"): (1, "plain", "12345678901234567890.5"), ("fr", "q"): (1, "str", "}{\\"),
    }
    assert {r["path"] for r in quarantine.collect()} == {"bad.json", "list.json"}


def test_nesting_depth_skips_texts(spark):
    rows = [('{"a":{"b":"{{{"}}', 2), ('{"a\\"{":"\\\\","b":{}}', 2), ("[]", 0), ('{"x\n{":1}', 1)]
    df = spark.createDataFrame(rows, "doc string, n int")
    assert df.select((D.nesting_depth(df.doc) == df.n).alias("same")).where("not same").isEmpty()


def test_sink_makes_parts_once(spark, tmp_path, monkeypatch):
    """The look for ranges reads a table of parts; the plan that is sorted has no walk along leaves."""
    rows = [("p", "en", k.split("."), "str", v, "en.yml") for k, v in (("a.b", "x"), ("a.c", "w"), ("d", "z"), ("d.e", "over"))]
    tr = spark.createDataFrame(rows, "project string, locale string, segments array<string>, value_type string, value string, path string")
    plans, cls = [], type(tr)
    original = cls.repartitionByRange
    monkeypatch.setattr(cls, "repartitionByRange", lambda self, *a: (plans.append(executed(self)), original(self, *a))[1])
    sinks.document_sink(tr, str(tmp_path / "out"))
    assert len(plans) == 1 and "Window" not in plans[0]
    assert [r["doc"] for r in sinks.read_documents(spark, str(tmp_path / "out")).collect()] == ["---\nen:\n  a:\n    b: x\n    c: w\n  d:\n    e: over\n"]


# --- keys ----------------------------------------------------------------------------


def _leaves(spark):
    keys = ["a.b.one", "a.b.other", "a.c", "d", "a.c.one", "e.f.g.few", "e.f.g.many", "e.f.x", "..", "g.0"]
    return spark.createDataFrame([("p", loc, k) for loc in ("en", "de") for k in keys], "project string, locale string, key string")


def test_paths_are_walked_from_parents(spark):
    """A leaf is not exploded to its ancestors; membership has the leaves and all nodes above them."""
    tr = _leaves(spark)
    keys = {r["key"] for r in tr.collect()}
    above = {".".join(k.split(".")[:i]) for k in keys for i in range(1, len(k.split(".")))}
    assert {(r["locale"], r["key"]) for r in C.present_keys(tr).collect()} == {(loc, k) for loc in ("en", "de") for k in keys | above}
    assert {r["section"] for r in U.section_nodes(tr).collect()} == above
    for nodes in (C.interior_nodes(tr), U.section_nodes(tr), C.plural_flags(tr)):
        plan = nodes._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.rindex("Aggregate"), "aggregates come before the walk"


def test_plural_flags_count_all_links(spark):
    got = {r["parent"]: (r["is_plural"], r["forms"], r["n_children"]) for r in C.plural_flags(_leaves(spark)).where("locale = 'en'").collect()}
    assert got["a.b"] == (True, ["one", "other"], 2) and got["g"] == (True, ["0"], 1) and got["a.c"] == (True, ["one"], 1)
    assert got["a"] == (False, [], 4) and got["e"] == (False, [], 3) and got["e.f"] == (False, [], 3) and got["e.f.g"] == (True, ["few", "many"], 2)


def test_only_plural_forms_meet_plural_nodes(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = C.with_plural_parent(_leaves(spark))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.startswith("Union")
    got = {(r["key"], r["plural_parent"], r["n_children"]) for r in C.with_plural_parent(_leaves(spark)).where("locale = 'de'").collect()}
    assert {g[0]: g[1:] for g in got if g[1]} == {"a.b.one": ("a.b", 2), "a.b.other": ("a.b", 2), "a.c.one": ("a.c", 1), "e.f.g.few": ("e.f.g", 2), "e.f.g.many": ("e.f.g", 2), "g.0": ("g", 1)}
    assert len(got) == 10


def test_presence_joins_sort_by_a_hash(spark, sf_dir):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = executed(QUERIES["J1_present"](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [_hash" in plan


# --- audits --------------------------------------------------------------------------


def test_unused_leaves_are_found_once(spark, sf_dir, monkeypatch):
    calls = counted(monkeypatch, H, "unused_leaves")
    picked = QUERIES["J17_select_unused"](spark, sf_dir)
    assert len(calls) == 1 and "lineitem" not in picked._jdf.queryExecution().optimizedPlan().toString()
    _, plan = audit.remove_unused(W.catalog(spark, sf_dir), W.occurrences(spark, sf_dir), W.rules(spark, sf_dir), W.locale_dim(spark, sf_dir), W.stored_docs(spark, sf_dir), "ns1.{o,p}.:")
    assert len(calls) == 2 and "l_orderkey" not in executed(plan)


def test_reasons_share_one_context(spark, sf_dir):
    """Usage and present keys are tables by then: no line item is read again."""
    assert "l_orderkey" not in executed(QUERIES["F26_reason_text"](spark, sf_dir))


def test_context_keeps_both_sides_of_a_key(spark):
    rows = [("p", "en", ["a", "b"], "a.b", False), ("p", "en", ["a", "c"], "a.c", True), ("p", "en", ["a", "b"], "a.b", True)]
    tr = spark.createDataFrame([(p, l, s, k, "str", "v", "f.yml", 0, e) for p, l, s, k, e in rows], "project string, locale string, segments array<string>, key string, value_type string, value string, path string, ordinal long, external boolean")
    occ = spark.createDataFrame([], "project string, path string, pos long, line_num long, key string, candidate_keys array<string>, kind string")
    with AuditContext(tr, occ, None) as context:
        assert {r["key"] for r in context.catalog.external().collect()} == {"a", "a.b", "a.c"}
        assert {r["key"] for r in context.catalog.present().collect()} == {"a", "a.b", "a.c"}
