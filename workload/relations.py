"""Relations derived from the given tables, for the registered queries and the benchmark.

Spark builds them with DataFrame operators; ``CTES`` says the same in SQL for the oracle.
Modulo tests below decide what a row says (which locale lacks a key, which value repeats),
never how many rows of a table are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.operators.scan import MARKER

LOCALES = [("en", 0, 7), ("de", 1, 11), ("fr", 2, 13), ("ja", 3, 17), ("ru", 4, 19)]
PROJECTS = ["high", "low", "medium", "not specified", "urgent"]
ROOTS = ["app/views", "app/controllers", "app/components"]
MARK = MARKER


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. The plan is kept per session, so a query that uses a table several times
    reads its schema once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _TABLES[key]


def _structs(**columns) -> Column:
    n = len(next(iter(columns.values())))
    return F.array(*[F.struct(*[F.lit(v[i]).alias(k) for k, v in columns.items()]) for i in range(n)])


def every_project() -> Column:
    return F.explode(F.array(*[F.lit(p) for p in PROJECTS]))


def text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def s(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def keys(spark, sf_dir) -> DataFrame:
    """(id, project, k, p, total): one dotted key per order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lower(F.expr("substr(o_orderpriority, 3)")).alias("project"),
        text("ns", s(F.col("o_custkey") % 17), ".", F.lower("o_orderstatus"), ".k", s("o_orderkey")).alias("k"),
        F.col("o_orderpriority").alias("p"),
        F.col("o_totalprice").alias("total"),
    )


def locale_dim(spark, sf_dir) -> DataFrame:
    projects = keys(spark, sf_dir).select("project").distinct()
    loc = _structs(locale=[x[0] for x in LOCALES], locale_rank=[x[1] for x in LOCALES])
    return projects.select("project", F.explode(loc).alias("l")).select("project", "l.locale", "l.locale_rank", (F.col("l.locale_rank") == 0).alias("is_base"))


def _canonical(df: DataFrame) -> DataFrame:
    seg = F.split("key", r"\.")
    return df.select("project", "locale", "key", seg.alias("segments"), F.size(seg).alias("depth"), "value_type", "value", "path", "ordinal")


def translation(spark, sf_dir) -> DataFrame:
    """Catalog leaves without the external flag."""
    loc = _structs(locale=[x[0] for x in LOCALES], locale_rank=[x[1] for x in LOCALES], gap=[x[2] for x in LOCALES])
    i = F.col("id")
    forms = F.when(i % 10 != 3, F.array(F.lit(""))).when(
        (F.col("locale") == "ru") & (i % 3 != 0), F.array(F.lit(".one"), F.lit(".few"), F.lit(".other"))
    ).otherwise(F.array(F.lit(".one"), F.lit(".other")))
    reserved = F.when(i % (F.col("locale_rank") + 9) == 0, "%{scope}").otherwise("%%{esc}")
    value = (
        F.when(i % 23 == 0, s("id"))
        .when(i % 5 == 0, text(F.col("p"), " %{n} ", reserved))
        .when(i % 4 == 0, F.col("p"))
        .otherwise(text(F.col("p"), " ", F.col("locale")))
    )
    rows = keys(spark, sf_dir).select("*", F.explode(loc).alias("l")).select("id", "project", "k", "p", "l.*").where(i % F.col("gap") != 5)
    return _canonical(
        rows.select("*", F.posexplode(forms).alias("form_no", "form")).select(
            "project",
            "locale",
            text(F.col("k"), F.col("form")).alias("key"),
            F.when(i % 23 == 0, "plain").otherwise("str").alias("value_type"),
            value.alias("value"),
            text("config/locales/", F.substring_index("k", ".", 1), ".", F.col("locale"), ".yml").alias("path"),
            (i * 10 + F.col("form_no")).alias("ordinal"),
        )
    )


def loaded(spark, sf_dir) -> DataFrame:
    """Catalog leaves before load order applies: a later file redefines some keys, and some
    repeat within their own file."""
    t = translation(spark, sf_dir)
    i = (F.col("ordinal") / 10).cast("bigint")
    later = t.where(i % 19 == 0).withColumn("path", text("config/locales/zz_override.", F.col("locale"), ".yml")).withColumn(
        "value", F.when(i % 38 == 0, text(F.col("value"), " again")).otherwise(F.col("value"))
    )
    repeated = t.where(i % 29 == 0).withColumn("ordinal", F.col("ordinal") + 5).withColumn("value", text(F.col("value"), " twice"))
    return t.unionByName(later).unionByName(repeated)


def external(spark, sf_dir) -> DataFrame:
    """The second catalog: keys of small parts everywhere, and of dear orders in two locales."""
    parts = (
        table(spark, sf_dir, "part").where("p_size <= 10").select(every_project().alias("project"), "p_partkey")
        .select("project", F.explode(F.array(*[F.lit(x[0]) for x in LOCALES])).alias("locale"), text("unknown.k", s("p_partkey")).alias("key"))
    )
    orders = keys(spark, sf_dir).where("total > 400000").select("project", F.explode(F.array(F.lit("en"), F.lit("de"))).alias("locale"), F.col("k").alias("key"))
    both = parts.unionByName(orders)
    return _canonical(both.select("*", F.lit("str").alias("value_type"), F.lit("x").alias("value"), F.lit("gems/data.yml").alias("path"), F.lit(0).cast("bigint").alias("ordinal")))


def catalog(spark, sf_dir) -> DataFrame:
    from polyglint.operators.catalog import with_external

    return with_external(translation(spark, sf_dir), external(spark, sf_dir))


def own_catalog(spark, sf_dir) -> DataFrame:
    return translation(spark, sf_dir).withColumn("external", F.lit(False))


def occurrences(spark, sf_dir) -> DataFrame:
    """Usage rows: keys from line items; whole sections from the nations of one region, patterns from
    small parts; opaque calls from all other nations and parts, and from suppliers."""
    k = keys(spark, sf_dir).select("id", "project", "k")
    unknown = F.col("l_partkey") % 29 == 0
    key = F.when(unknown, text("unknown.k", s("l_partkey"))).otherwise(F.col("k"))
    calls = table(spark, sf_dir, "lineitem").join(k, F.col("l_orderkey") == F.col("id")).select(
        "project",
        text("app/views/s", s("l_suppkey"), "/p", s(F.col("l_partkey") % 50), ".html.slim").alias("path"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("bigint").alias("pos"),
        (F.col("l_orderkey") + 1).cast("bigint").alias("line_num"),
        F.col("l_linenumber").cast("int").alias("line_pos"),
        key.alias("key"),
        key.alias("raw_key"),
        F.when(unknown & (F.col("l_returnflag") == "A"), F.array(key, F.col("k"))).otherwise(F.array(key)).alias("candidate_keys"),
        F.lit("key").alias("kind"),
    )

    def other(df, path, n, key, kind) -> DataFrame:
        listed = F.when(kind == "opaque", F.array().cast("array<string>")).otherwise(F.array(key))
        return df.select(
            every_project().alias("project"), path.alias("path"), n.cast("bigint").alias("pos"), n.cast("bigint").alias("line_num"), F.lit(0).alias("line_pos"),
            key.alias("key"), key.alias("raw_key"), listed.alias("candidate_keys"), kind.alias("kind"),
        )

    def chosen(kind, when, key) -> tuple[Column, Column]:
        return F.when(when, key), F.when(when, kind).otherwise("opaque")

    section = chosen("key", F.col("n_regionkey") == 0, text("ns", s("n_nationkey"), ".p"))
    wild = text("ns", s(F.col("p_size")), ".", F.when(F.col("p_partkey") % 2 == 0, "o").otherwise("p"), ".k*7")
    pattern = chosen("pattern", F.col("p_size") <= 3, wild)
    opaque = F.lit(None).cast("string"), F.lit("opaque")
    return (
        calls.unionByName(other(table(spark, sf_dir, "nation"), F.lit("app/models/nation.rb"), F.col("n_nationkey") + 1, *section))
        .unionByName(other(table(spark, sf_dir, "part"), F.lit("app/models/part.rb"), F.col("p_partkey") + 1, *pattern))
        .unionByName(other(table(spark, sf_dir, "supplier"), text("app/services/s", s("s_suppkey"), ".rb"), F.col("s_suppkey") + 1, *opaque))
    )


SETTINGS = ["ignore", "ignore_missing", "ignore_unused", "ignore_eq_base", "ignore_inconsistent_interpolations"]


def rule_config(spark, sf_dir) -> DataFrame:
    """Rules as configured, from nations: project, rule_id, setting, pattern, group_text, priority."""
    n = F.col("n_nationkey")
    form = (
        F.when(n < 5, text("ns", s(n), ".*"))
        .when(n < 10, text("ns", s(n), ".{o, f}.*"))
        .when(n < 15, text("*.k", s(n), "*"))
        .when(n < 20, text("ns", s(n % 17), ".:.k*7"))
        .otherwise(text("nothing", s(n), ".*"))
    )
    group = F.when(n % 5 == 0, F.lit(None).cast("string")).when(n < 5, None).when(n < 10, "de, fr").when(n < 15, "all")
    return table(spark, sf_dir, "nation").select(F.posexplode(F.array(*[F.lit(p) for p in PROJECTS])).alias("pi", "project"), n.alias("n_nationkey")).select(
        "project",
        (n * 5 + F.col("pi")).cast("bigint").alias("rule_id"),
        F.element_at(F.array(*[F.lit(x) for x in SETTINGS]), (n % 5 + 1).cast("int")).alias("setting"),
        form.alias("pattern"),
        group.alias("group_text"),
        n.cast("int").alias("priority"),
    )


def rules(spark, sf_dir) -> DataFrame:
    from polyglint.operators.rules import rule_rows

    return rule_rows(rule_config(spark, sf_dir))


def write_rules(spark, sf_dir) -> DataFrame:
    """Write rules from regions, in order; the last region's project has no catch-all."""
    r = F.col("r_regionkey")
    pattern = (
        F.when(r == 0, "{ns1, ns2, ns3}.*").when(r == 1, "*.{o,f}.:").when(r == 2, "{ns1*:}.{:}.*").when(r == 3, "ns5.*").otherwise(F.lit(None).cast("string"))
    )
    target = (
        F.when(r == 0, r"config/locales/\1.%{locale}.yml").when(r == 1, r"config/locales/short/\1/%{locale}.yml").when(r == 2, r"config/locales/%{locale}/\2-\1\3.yml")
        .when(r == 3, "config/100%%/five.%{locale}.yml").otherwise("config/locales/%{locale}.yml")
    )
    named = table(spark, sf_dir, "region").select(every_project().alias("project"), r.cast("int").alias("priority"), pattern.alias("pattern"), target.alias("target"))
    return named.where((F.col("project") != "urgent") | F.col("pattern").isNotNull())


# --- files ---------------------------------------------------------------------------


def _lines_to_files(df: DataFrame, order: list[str]) -> DataFrame:
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x["line"]), "\n")
    return df.groupBy("project", "path").agg(body.alias("content"))


def template_lines(spark, sf_dir) -> DataFrame:
    """Every key occurrence of a line item as one template line: project, path, pos, ln, key, line."""
    o = occurrences(spark, sf_dir).where("path like 'app/views/%'")
    ln, key = F.col("line_pos"), F.col("key")
    line = (
        F.when(ln == 1, text("= t('", key, "')"))
        .when(ln == 2, text('p = I18n.t "', key, '", default: "x"'))
        .when(ln == 3, text("é #{t(:\"", key, "\")} text"))
        .when(ln == 4, text("/ t('", key, "')"))
        .when(ln == 5, text("= t(:name, scope: '", key, "')"))
        .when(ln == 6, text('= t("', key, '.#{x}")'))
        .otherwise(text("= t(:v, scope: obj) # ", key))
    )
    return o.select("project", "path", "pos", ln.alias("ln"), "key", line.alias("line"))


def template_files(spark, sf_dir) -> DataFrame:
    """The template lines of each path as a file."""
    return _lines_to_files(template_lines(spark, sf_dir), ["pos"])


def tag_files(spark, sf_dir) -> DataFrame:
    """One tagged partial per part."""
    k = s("p_partkey")
    content = text(
        "<h1><%= t('.title') %></h1> é\n", f"<%# {MARK} t('part.note", k, "') %>\n", "<%# t('dead.k", k, "') %>\n",
        "<% x = t \"part.", F.col("p_name"), "\" %> t('outside')\n", "<%= t(\"part.#{x}.k", k, "\") %> <%= t(value) %>\n",
        f"<% # {MARK} t('part.next", k, "') %>\n", "<%= t(covered) %>",
    )
    return table(spark, sf_dir, "part").repartition("p_partkey").select(
        F.lit("high").alias("project"), text("app/views/parts/b", s("p_size"), "/_p", k, ".html.erb").alias("path"), content.alias("content")
    )


def ruby_files(spark, sf_dir) -> DataFrame:
    """One controller per order."""
    k = s("id")
    content = text(
        "module Shop\n  class Admin::O", k, "Controller < Base\n    def index\n      x = {label: t('.label')}\n      if x\n        t('abs.k", k,
        "')\n      end\n    end\n\n    def show = t('.short')\n\n    private\n\n    def helper\n      t('.hidden')\n      t(\"dyn.#{x}.k", k,
        "\")\n      t(:m, scope: [:shop, KIND])\n      t(value)\n    end\n  end\nend\n",
    )
    # key rows are dealt out, not the texts made of them; adaptive execution picks the number of tasks
    return keys(spark, sf_dir).repartition("id").select("project", text("app/controllers/admin/o", k, "_controller.rb").alias("path"), content.alias("content"))


def prose_files(spark, sf_dir) -> DataFrame:
    """Bulk text with next to no calls: documents, pages and conversations as source files."""
    d = table(spark, sf_dir, "documents").select(text("lib/docs/d", s("doc_id"), ".txt").alias("path"), F.col("text").alias("content"))
    p = table(spark, sf_dir, "pages").select(text("app/pages/p", s("page_id"), ".html").alias("path"), F.col("html").alias("content"))
    c = table(spark, sf_dir, "conversations").select(text("app/talk/c", s("conv_id"), "_", s("turn"), ".md").alias("path"), F.col("text").alias("content"))
    return d.unionByName(p).unionByName(c).select(F.lit("low").alias("project"), "path", "content")


def source_tree(spark, sf_dir) -> DataFrame:
    return template_files(spark, sf_dir).unionByName(tag_files(spark, sf_dir)).unionByName(ruby_files(spark, sf_dir))


def tree_paths(spark, sf_dir) -> DataFrame:
    """Paths of every kind: sources, assets, hidden and generated files."""
    k = s("o_orderkey")
    n = F.col("o_orderkey") % 8
    path = (
        F.when(n == 0, text("app/models/m", k, ".rb")).when(n == 1, text("app/assets/builds/b", k, ".js")).when(n == 2, text("app/assets/i", k, ".png"))
        .when(n == 3, text("lib/.cache/c", k, ".rb")).when(n == 4, text("lib/tasks/t", k, ".rake")).when(n == 5, text("app/views/v", k, "/index.html.erb"))
        .when(n == 6, text("vendor/x", k, "/lib/y.rb")).otherwise(text("app/.hidden", k, ".rb"))
    )
    return table(spark, sf_dir, "orders").select(F.lower(F.expr("substr(o_orderpriority, 3)")).alias("project"), path.alias("path"))


def layout_files(spark, sf_dir) -> DataFrame:
    """Catalog file paths in every layout, from customers; the project says which root it uses."""
    k = s("c_custkey")
    loc = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "pt-BR", "zh_Hans")]), (F.col("c_nationkey") % 4 + 1).cast("int"))
    n = F.col("c_custkey") % 8
    below = (
        F.when(n == 0, text(loc, ".yml")).when(n == 1, text("n", k, ".", loc, ".yml")).when(n == 2, text(loc, "/m", k, ".yaml")).when(n == 3, text(loc, "/a/b", k, ".yml"))
        .when(n == 4, text("sub", k, "/", loc, ".yml")).when(n == 5, text("sub/x", k, ".", loc, ".yml")).when(n == 6, text("odd", k, "/names.yml")).otherwise(text("README", k, ".md"))
    )
    project = F.lower("c_mktsegment")
    root = F.when(F.col("c_mktsegment") == "BUILDING", "locales").when(F.col("c_mktsegment") == "MACHINERY", "app/locales").otherwise("config/locales")
    return table(spark, sf_dir, "customer").select(project.alias("project"), text(root, "/", below).alias("path")).distinct()


READ_PATTERNS = ["config/locales/%{locale}.yml", "config/locales/*.%{locale}.yml", "config/locales/%{locale}/*.yaml", "locales/**/%{locale}.yml"]


def read_patterns(spark, sf_dir) -> DataFrame:
    """Read patterns of every project of ``layout_files``."""
    return layout_files(spark, sf_dir).select("project").distinct().select("project", F.explode(F.array(*[F.lit(p) for p in READ_PATTERNS])).alias("pattern"))


def layout_locales(spark, sf_dir) -> DataFrame:
    return layout_files(spark, sf_dir).select("project").distinct().select("project", F.explode(F.array(F.lit("en"), F.lit("de"), F.lit("pt-BR"))).alias("locale"))


def event_docs(spark, sf_dir) -> DataFrame:
    """JSON documents from events; error events arrive cut off, views are no mapping, and
    clicks of a few users are blank."""
    e = F.col("event_type")
    wrapped = text('{"en":{"', e, '":', F.col("props"), ',"u', s("user_id"), '":{"ok":true,"none":null,"list":[1,"a"],"deep":{"v":', s(F.col("value")), "}}}}")
    doc = F.when(e == "error", F.expr("substr(props, 1, length(props) - 1)")).when(e == "view", text("[", F.col("props"), "]")).otherwise(wrapped)
    return table(spark, sf_dir, "events").select(F.lit("low").alias("project"), text("config/e", s("event_id"), ".json").alias("path"), doc.alias("doc"))


def catalog_docs(spark, sf_dir) -> DataFrame:
    """The catalog as JSON documents: one per file, as the nested writer makes them."""
    from polyglint.functions import values as V
    from polyglint.operators.documents import nested_json

    t = translation(spark, sf_dir).withColumn("json", V.json_value("value_type", "value"))
    members = nested_json(t, ["project", "path", "locale"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "member"))), lambda x: x["member"]), ",")
    return members.groupBy("project", "path", "locale").agg(body.alias("b")).select("project", "path", text('{"', F.col("locale"), '":{', F.col("b"), "}}").alias("doc"))


def stored_docs(spark, sf_dir) -> DataFrame:
    """Canonical documents as they stand on disk: most are normal, some were edited, some are
    missing and one stray file per project belongs to nobody."""
    from polyglint.operators.documents import canonical_documents

    leaves = translation(spark, sf_dir)
    docs = canonical_documents(leaves)
    edited = docs.where("path not like '%ns3.fr.yml'").withColumn("doc", F.when(F.col("path").like("%ns1%.de.yml"), text(F.col("doc"), "# edited\n")).otherwise(F.col("doc")))
    stray = leaves.select("project").distinct().select("project", F.lit("config/locales/stray.yml").alias("path"), F.lit("---\n").alias("doc"))
    return edited.select("project", "path", "doc").unionByName(stray)
