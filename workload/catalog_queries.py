"""Load order, ancestry, documents, routing, layout."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import paths as P
from polyglint.functions import values as V
from polyglint.operators import catalog as C
from polyglint.operators import checks as H
from polyglint.operators import documents as D
from polyglint.operators import profile as L
from polyglint.operators import routing as T
from polyglint.plans import audit
from polyglint.sources import files as S
from polyglint.sources import sinks
from workload import relations as W
from workload.registry import query

# --- load order ----------------------------------------------------------------------

_PER_FILE = """(SELECT project, locale, locale_rank, key, path, arg_max(value, ordinal) AS value, arg_max(value_type, ordinal) AS value_type, min(ordinal) AS ordinal
    FROM x_loaded GROUP BY 1, 2, 3, 4, 5)"""
_CONFLICT = f"""(SELECT * FROM (SELECT project, locale, locale_rank, key, path AS new_path, value, lag(path) OVER w AS old_path, lag(value) OVER w AS old_value
    FROM {_PER_FILE} WINDOW w AS (PARTITION BY project, locale, key ORDER BY path)) WHERE old_path IS NOT NULL AND old_value <> value)"""
_DUPLICATE = """(SELECT * FROM (SELECT project, locale, locale_rank, path, key, ordinal, lead(ordinal) OVER (PARTITION BY project, locale, path, key ORDER BY ordinal) AS by_ordinal FROM x_loaded)
    WHERE by_ordinal IS NOT NULL)"""


@query("W1_last_write_wins", f"SELECT project, locale, key, arg_max(value, path) AS value, max(path) AS path, arg_max(ordinal, path) AS ordinal FROM {_PER_FILE} GROUP BY 1, 2, 3")
def last_write_wins(spark, sf):
    return C.last_write_wins(W.loaded(spark, sf)).select("project", "locale", "key", "value", "path", "ordinal")


@query("W2_conflicts", f"SELECT project, locale, key, old_path, new_path FROM {_CONFLICT}")
def conflicts(spark, sf):
    return C.conflicts(W.loaded(spark, sf))


@query("W8_duplicate_keys", f"SELECT project, locale, path, key, ordinal, by_ordinal FROM {_DUPLICATE}")
def duplicate_keys(spark, sf):
    return C.duplicate_keys(W.loaded(spark, sf))


def _null_keys(spark, sf):
    """Map entries named after part sizes and types; some names read as null."""
    n = F.col("p_partkey") % 4
    name = F.when(n == 0, "~").when(n == 1, "NULL").when(n == 2, F.col("p_name")).otherwise("null")
    return W.table(spark, sf, "part").select(
        F.lit("low").alias("project"), F.lit("de").alias("locale"), W.text("config/locales/p", W.s("p_size"), ".yml").alias("path"), F.col("p_brand").alias("parent"), name.alias("name"), (n == 3).alias("quoted")
    )


@query("R19_null_key_rows", "SELECT 'config/locales/p' || p_size::VARCHAR || '.yml' AS path, p_brand AS parent, CASE p_partkey % 4 WHEN 0 THEN '~' ELSE 'NULL' END AS name FROM part WHERE p_partkey % 4 < 2")
def null_key_rows(spark, sf):
    return C.null_key_rows(_null_keys(spark, sf)).select("path", "parent", "name")


@query("U7_catalog_warnings", f"""SELECT project, warning, min(locale_rank) AS locale_rank FROM (
    SELECT project, locale_rank, '`' || locale || '.' || key || '` has different values in ' || old_path || ' and ' || new_path AS warning FROM {_CONFLICT}
    UNION ALL SELECT project, locale_rank, path || ':' || ordinal::VARCHAR || ': `' || key || '` appears again at ' || by_ordinal::VARCHAR FROM {_DUPLICATE}
    UNION ALL SELECT 'low', 1, 'config/locales/p' || p_size::VARCHAR || '.yml: skipping a null key under `' || p_brand || '`' FROM part WHERE p_partkey % 4 < 2) GROUP BY 1, 2""")
def catalog_warnings(spark, sf):
    t = W.loaded(spark, sf)
    return C.catalog_warnings(C.conflicts(t), C.duplicate_keys(t), C.null_key_rows(_null_keys(spark, sf)), W.locale_dim(spark, sf))


@query("S7_with_external", "SELECT project, locale, external, count(*) AS n FROM (SELECT project, locale, 'false' AS external FROM x_translation UNION ALL SELECT project, locale, 'true' FROM x_external) GROUP BY 1, 2, 3")
def with_external(spark, sf):
    both = C.with_external(W.translation(spark, sf), W.external(spark, sf))
    return both.groupBy("project", "locale", F.col("external").cast("string").alias("external")).agg(F.count("*").alias("n"))


# --- ancestry and orders -------------------------------------------------------------


@query("R9_interior_nodes", "SELECT DISTINCT project, locale, array_to_string(s[1:i], '.') AS key FROM (SELECT project, locale, s, unnest(generate_series(1, len(s) - 1)) AS i FROM (SELECT project, locale, string_split(key, '.') AS s FROM x_translation))")
def interior_nodes(spark, sf):
    return C.interior_nodes(W.own_catalog(spark, sf))


@query("R10_children", "SELECT DISTINCT project, locale, array_to_string(s[1:i], '.') AS parent, s[i + 1] AS child FROM (SELECT project, locale, s, unnest(generate_series(1, len(s) - 1)) AS i FROM (SELECT project, locale, string_split(key, '.') AS s FROM x_translation))")
def children(spark, sf):
    return C.children(W.own_catalog(spark, sf))


@query("R11_plural_nodes", "SELECT project, locale, node AS key, array_to_string(list_sort(forms), ' ') AS forms, n AS n_children FROM x_plural")
def plural_nodes(spark, sf):
    return C.plural_nodes(W.own_catalog(spark, sf)).withColumn("forms", F.array_join(F.array_sort("forms"), " "))


def _places(ordered):
    """Where each row stands in its project and locale, by the order the operator gave: rows are numbered as they come."""
    came = ordered.select("project", "locale", "key", F.monotonically_increasing_id().alias("at"))
    return came.select("project", "locale", "key", F.row_number().over(Window.partitionBy("project", "locale").orderBy("at")).alias("n"))


@query("O_1_sorted_keys", "SELECT project, locale, key, row_number() OVER (PARTITION BY project, locale ORDER BY key) AS n FROM x_translation")
def sorted_keys(spark, sf):
    return _places(C.sorted_keys(W.own_catalog(spark, sf)))


@query("O_2_canonical_order", "SELECT project, locale, key, row_number() OVER (PARTITION BY project, locale ORDER BY string_split(key, '.')) AS n FROM x_translation")
def canonical_order(spark, sf):
    return _places(C.canonical_order(W.own_catalog(spark, sf)))


@query("O_3_keep_order", f"SELECT project, locale, key, path AS origin_path, ordinal, 'config/locales/zz_override.' || locale || '.yml' AS path FROM {_PER_FILE}")
def keep_order(spark, sf):
    t = C._per_file(W.loaded(spark, sf)).withColumn("origin_path", F.col("path")).withColumn("path", W.text("config/locales/zz_override.", F.col("locale"), ".yml"))
    return C.keep_order(t).select("project", "locale", "key", "origin_path", "ordinal", "path")


@query("O_4_locale_order", "SELECT p.project, l.locale, row_number() OVER (PARTITION BY p.project ORDER BY l.locale <> 'fr', l.locale) - 1 AS locale_rank FROM x_project p, x_locale l")
def locale_order(spark, sf):
    loc = W.locale_dim(spark, sf)
    base = loc.select("project").distinct().withColumn("locale", F.lit("fr"))
    return C.locale_order(loc, base).select("project", "locale", F.col("locale_rank").cast("bigint").alias("locale_rank"))


@query("A9_file_locales", "SELECT project, path, string_agg(DISTINCT locale, ' ' ORDER BY locale) AS locales FROM (SELECT project, path, locale FROM x_loaded UNION SELECT project, 'shared.yml', locale FROM x_loaded) GROUP BY 1, 2")
def file_locales(spark, sf):
    t = W.loaded(spark, sf).select("project", "path", "locale")
    shared = t.withColumn("path", F.lit("shared.yml"))
    return C.file_locales(t.unionByName(shared)).withColumn("locales", F.array_join("locales", " "))


@query("R20_load_check", "SELECT project, count(*) AS key_count, count(DISTINCT path) AS files_read, 'de en fr ja ru' AS locales FROM x_translation GROUP BY 1")
def load_check(spark, sf):
    return C.load_check(W.own_catalog(spark, sf)).withColumn("locales", F.array_join("locales", " "))


@query("F22_locale_names", """SELECT DISTINCT path, part, regexp_full_match(part, '[A-Za-z0-9_][A-Za-z0-9_\\-.]*')::VARCHAR AS valid, regexp_full_match(part, '[a-z]{2,3}([-_][A-Za-z0-9]{2,8})*')::VARCHAR AS narrow
    FROM (SELECT path, unnest(string_split(replace(path, '.', '/'), '/')) AS part FROM x_layout)""")
def locale_names(spark, sf):
    parts = W.layout_files(spark, sf).select("path", F.explode(F.split(F.translate("path", ".", "/"), "/")).alias("part")).distinct()
    return parts.select("path", "part", K.valid_locale("part").cast("string").alias("valid"), K.looks_like_locale("part").cast("string").alias("narrow"))


# --- documents -----------------------------------------------------------------------


@query("S5_read_catalog_docs", """SELECT 'config/e' || event_id::VARCHAR || '.json' AS path, CASE event_type WHEN 'error' THEN 'not valid JSON' WHEN 'view' THEN 'not a mapping at the top level' END AS problem,
    CASE WHEN event_type NOT IN ('error', 'view') THEN 'en' END AS locale FROM events""")
def read_catalog_docs(spark, sf):
    entries, quarantine = D.read_catalog_docs(W.event_docs(spark, sf))
    return entries.select("path", F.lit(None).cast("string").alias("problem"), "locale").unionByName(quarantine.select("path", "problem", F.lit(None).cast("string").alias("locale")))


@query("S6_flatten_docs", "SELECT project, locale, key, depth, value_type, value, path FROM x_translation")
def flatten_docs(spark, sf):
    entries, _ = D.read_catalog_docs(W.catalog_docs(spark, sf))
    return D.flatten_docs(entries).select("project", "locale", "key", "depth", "value_type", "value", "path")


@query("F27_symbol_references", "SELECT project, locale, path, key, ':' || replace(key, '-', '_') AS value FROM x_translation WHERE value_type = 'str'")
def symbol_references(spark, sf):
    t = W.own_catalog(spark, sf)
    marked = t.withColumn("value", F.when(F.col("value_type") == "str", W.text(":", F.col("key"))).otherwise(W.text(": ", F.col("value"))))
    return D.symbol_references(marked)


_JSON = r"""(SELECT project, locale, ns, '"' || ns || '":{' || string_agg(m, ',' ORDER BY st) || '}' AS member, sum(n)::BIGINT AS n_keys FROM (
      SELECT project, locale, ns, st, '"' || st || '":{' || string_agg(m, ',' ORDER BY kk) || '}' AS m, sum(n) AS n FROM (
        SELECT project, locale, ns, st, kk, '"' || kk || '":' || CASE WHEN max(form) = '' THEN max(v) ELSE '{' || string_agg('"' || form || '":' || v, ',' ORDER BY form) || '}' END AS m, count(*) AS n FROM (
          SELECT project, locale, split_part(key, '.', 1) AS ns, split_part(key, '.', 2) AS st, split_part(key, '.', 3) AS kk, split_part(key, '.', 4) AS form,
            CASE value_type WHEN 'str' THEN '"' || value || '"' ELSE value END AS v FROM x_translation) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"""


@query("A11_nested_json", f"SELECT project, locale, ns AS head, sha256(member) AS digest, n_keys FROM {_JSON}")
def nested_json(spark, sf):
    t = W.translation(spark, sf).withColumn("json", V.json_value("value_type", "value"))
    return D.nested_json(t).select("project", "locale", "head", F.sha2("member", 256).alias("digest"), "n_keys")


def _doc_sql(source: str, path: str = "path") -> str:
    """Canonical documents of a leaf relation: one line per node, in segment order."""
    return f"""(SELECT project, {path} AS path, locale, '---' || chr(10) || locale || ':' || chr(10) || string_agg(line || chr(10), '' ORDER BY pre) AS doc, sum(is_leaf)::BIGINT AS n_keys FROM (
        SELECT DISTINCT project, {path}, locale, s[1:i] AS pre, repeat('  ', i) || s[i] || ':' || CASE WHEN i = len(s) THEN ' ' || value ELSE '' END AS line, (i = len(s))::INT AS is_leaf
        FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM (SELECT *, string_split(key, '.') AS s FROM {source}))) GROUP BY 1, 2, 3)"""


@query("A10_canonical_documents", f"SELECT project, path, locale, sha256(doc) AS digest, n_keys FROM {_doc_sql('x_translation')}")
def canonical_documents(spark, sf):
    return D.canonical_documents(W.translation(spark, sf)).select("project", "path", "locale", F.sha2("doc", 256).alias("digest"), "n_keys")


@query("S8_document_sink", f"SELECT project, path, sha256(doc) AS digest FROM {_doc_sql('x_translation')}")
def document_sink(spark, sf):
    """Written, read back, and compared by the digest of each document."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    target = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    sinks.document_sink(W.translation(spark, sf), target)
    return sinks.read_documents(spark, target).select("project", "path", F.sha2("doc", 256).alias("digest"))


# --- routing -------------------------------------------------------------------------

_TARGET = """CASE WHEN split_part(key, '.', 1) IN ('ns1', 'ns2', 'ns3') THEN 'config/locales/' || split_part(key, '.', 1) || '.' || locale || '.yml'
    WHEN regexp_full_match(key, '.*\\.(o|f)\\.[^.]+') THEN 'config/locales/short/' || split_part(key, '.', 2) || '/' || locale || '.yml'
    WHEN regexp_full_match(key, 'ns1[^.]+\\..*') THEN 'config/locales/' || locale || '/' || split_part(key, '.', 2) || '-' || split_part(key, '.', 1) || '.yml'
    WHEN key LIKE 'ns5.%' THEN 'config/100%/five.' || locale || '.yml'
    WHEN project <> 'urgent' THEN 'config/locales/' || locale || '.yml' END"""
_ROUTED = f"(SELECT *, {_TARGET} AS destination FROM x_translation)"


def _routed(spark, sf):
    return T.route_by_pattern(W.own_catalog(spark, sf), W.write_rules(spark, sf))


@query("J12_route_by_pattern", f"SELECT project, locale, key, destination FROM {_ROUTED}")
def route_by_pattern(spark, sf):
    return _routed(spark, sf).select("project", "locale", "key", "destination")


@query("F18_fill_captures", f"SELECT DISTINCT project, destination FROM {_ROUTED} WHERE destination IS NOT NULL")
def fill_captures(spark, sf):
    return _routed(spark, sf).where("destination is not null").select("project", "destination").distinct()


@query("J13_route_conservative", f"""SELECT a.project, a.locale, a.key, CASE WHEN t.path IS NOT NULL THEN t.path WHEN o.key IS NOT NULL THEN 'config/locales/' || split_part(a.key, '.', 1) || '.' || a.locale || '.yml' ELSE {_TARGET.replace('key', 'a.key').replace('locale', 'a.locale').replace('config/a.locales', 'config/locales').replace('project', 'a.project')} END AS destination
    FROM (SELECT k.project, l.locale, k.k AS key FROM x_key k, x_locale l) a LEFT JOIN x_translation t ON t.project = a.project AND t.locale = a.locale AND t.key = a.key
    LEFT JOIN (SELECT DISTINCT project, key FROM x_translation) o ON o.project = a.project AND o.key = a.key""")
def route_conservative(spark, sf):
    loc = W.locale_dim(spark, sf)
    keys = W.keys(spark, sf).join(loc.select("project", "locale"), "project").select("project", "locale", F.col("k").alias("key"))
    return T.route_conservative(keys, W.own_catalog(spark, sf), W.write_rules(spark, sf), loc).select("project", "locale", "key", "destination")


@query("A12_destinations", f"SELECT project, locale, destination, count(*) AS n_keys FROM {_ROUTED} GROUP BY 1, 2, 3")
def destinations(spark, sf):
    return T.destinations(_routed(spark, sf))


@query("A13_guard_two_locales", f"SELECT project, replace(destination, '/ru/', '/de/') AS destination, string_agg(DISTINCT locale, ', ' ORDER BY locale) AS locales FROM {_ROUTED} GROUP BY 1, 2 HAVING count(DISTINCT locale) > 1")
def guard_two_locales(spark, sf):
    return T.guard_two_locales(_routed(spark, sf).withColumn("destination", F.replace("destination", F.lit("/ru/"), F.lit("/de/"))))


@query("A14_guard_foreign_locales", "SELECT t.project, t.path, t.locale, string_agg(DISTINCT f.locale, ', ' ORDER BY f.locale) AS foreign FROM (SELECT DISTINCT project, locale, 'config/mixed.' || CASE WHEN locale IN ('de', 'ru') THEN 'yml' ELSE locale END AS path FROM x_translation) t JOIN (SELECT DISTINCT project, locale, 'config/mixed.' || CASE WHEN locale IN ('de', 'ru') THEN 'yml' ELSE locale END AS path FROM x_translation) f ON f.project = t.project AND f.path = t.path AND f.locale <> t.locale GROUP BY 1, 2, 3")
def guard_foreign_locales(spark, sf):
    mixed = W.own_catalog(spark, sf).withColumn("path", W.text("config/mixed.", F.when(F.col("locale").isin("de", "ru"), "yml").otherwise(F.col("locale"))))
    return T.guard_foreign_locales(mixed, C.file_locales(mixed))


_STORED = f"(SELECT project, path, CASE WHEN path LIKE '%ns1%.de.yml' THEN doc || '# edited' || chr(10) ELSE doc END AS doc FROM {_doc_sql('x_translation')} WHERE path NOT LIKE '%ns3.fr.yml')"
_AFTER = _doc_sql(f"(SELECT * FROM {_ROUTED} WHERE destination IS NOT NULL)", "destination")
_PLAN = f"""(SELECT coalesce(a.project, s.project) AS project, coalesce(a.path, s.path) AS path, coalesce(a.locale, o.locale) AS locale, coalesce(a.n_keys, 0) AS n_keys,
    CASE WHEN a.path IS NULL AND o.path IS NOT NULL THEN 'delete' WHEN a.path IS NOT NULL AND s.path IS NULL THEN 'create' WHEN a.doc <> s.doc THEN 'update' END AS action
    FROM {_AFTER} a FULL JOIN {_STORED} s ON s.project = a.project AND s.path = a.path
    LEFT JOIN (SELECT DISTINCT project, path, locale FROM x_translation) o ON o.project = coalesce(a.project, s.project) AND o.path = coalesce(a.path, s.path))"""


def _plan(spark, sf):
    routed = _routed(spark, sf).where("destination is not null")
    return T.write_plan(T.to_write(routed), W.stored_docs(spark, sf), W.own_catalog(spark, sf))


@query("J15_write_plan", f"SELECT project, path, locale, n_keys, action FROM {_PLAN} WHERE action IS NOT NULL")
def write_plan(spark, sf):
    return _plan(spark, sf)


@query("U6_except_origin", f"SELECT DISTINCT project, locale, path FROM x_translation t WHERE NOT EXISTS (SELECT 1 FROM {_ROUTED} r WHERE r.project = t.project AND r.locale = t.locale AND r.destination = t.path)")
def except_origin(spark, sf):
    return T.except_origin(W.own_catalog(spark, sf), T.to_write(_routed(spark, sf)))


@query("A15_refusal_gates", f"""SELECT p.project, count(*) FILTER (path LIKE 'config/100%' AND false OR path NOT LIKE 'config/locales/%') AS outside_root, count(*) FILTER (action = 'delete') AS deletions,
    (SELECT count(*) FROM x_opaque o WHERE o.project = p.project) AS opaque_calls FROM {_PLAN} p WHERE action IS NOT NULL GROUP BY 1""")
def refusal_gates(spark, sf):
    from polyglint.operators.usage import opaque_calls

    return T.refusal_gates(_plan(spark, sf), opaque_calls(W.occurrences(spark, sf)), "config/locales")


@query("J18_removal_plan", """SELECT project, locale, path, CASE WHEN n_left = 0 THEN 'delete' WHEN path LIKE '%ns3.fr.yml' THEN 'create' ELSE 'update' END AS action, n_left AS n_keys FROM (
    SELECT t.project, t.locale, t.path, count(*) FILTER (u.key IS NULL) AS n_left, count(u.key) AS n_gone FROM x_translation t
    LEFT JOIN x_unused_own u ON u.project = t.project AND u.locale = t.locale AND u.key = t.key GROUP BY 1, 2, 3)
    WHERE n_gone > 0 OR path LIKE '%ns3.fr.yml' OR path LIKE '%ns1%.de.yml'""")
def removal_plan(spark, sf):
    _, plan = audit.remove_unused(W.catalog(spark, sf), W.occurrences(spark, sf), W.rules(spark, sf), W.locale_dim(spark, sf), W.stored_docs(spark, sf))
    return plan.select("project", "locale", "path", "action", "n_keys")


# --- files and layout ----------------------------------------------------------------


@query("S1_source_files", """SELECT 'suppliers' AS project, 'dir=s' || s_suppkey AS dir, s_name || CASE WHEN s_suppkey % 3 = 0 THEN chr(65533) ELSE '' END || chr(10) AS content
    FROM supplier WHERE s_suppkey % 5 <> 0""")
def source_files(spark, sf):
    """One file per supplier, a third of them not UTF-8, written and read back; a fifth are excluded by a glob."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    target = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    n = F.col("s_suppkey")
    odd = F.when(n % 3 == 0, F.unhex(F.lit("FF")).cast("string")).otherwise("")
    place = F.concat(F.when(n % 5 == 0, "skip").otherwise("s"), n.cast("string"))
    files = W.table(spark, sf, "supplier").select(place.alias("dir"), F.concat("s_name", odd).alias("text"))
    # a small table is one task, and each file costs far more than its row: they are dealt out to a fixed number of tasks,
    # each of which puts its own files in place
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "dir")
    dealt.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("dir").text(target)
    found = S.source_files(spark, target.removeprefix("file://"), ["./", "dir=s1"], "suppliers", exclude=["dir=skip*"])
    return found.select("project", F.substring_index("path", "/", 1).alias("dir"), "content")


@query("S2_glob_filter", "SELECT project, path FROM x_tree WHERE o_orderkey % 8 IN (0, 5)")
def glob_filter(spark, sf):
    return S.glob_filter(W.tree_paths(spark, sf), only=["app/*", "lib/*.rb"], exclude=["app/assets/builds", "vendor*"])


_LAYOUT_READ = r"""(CASE WHEN regexp_full_match(path, 'config/locales/[^/.]+\.yml') THEN regexp_extract(path, 'config/locales/([^/.]+)\.yml', 1) END)"""


@query("S4_catalog_files", r"""SELECT DISTINCT f.project, f.path, l.locale FROM x_layout f JOIN (VALUES ('en'), ('de'), ('pt-BR')) AS l(locale)
    ON f.path = 'config/locales/' || l.locale || '.yml' OR regexp_full_match(f.path, 'config/locales/[^/]*\.' || l.locale || '\.yml') OR regexp_full_match(f.path, 'config/locales/' || l.locale || '/[^/]*\.yaml')
    OR regexp_full_match(f.path, 'locales/(.*/)?' || l.locale || '\.yml')""")
def catalog_files(spark, sf):
    return S.catalog_files(W.layout_files(spark, sf), W.read_patterns(spark, sf), W.layout_locales(spark, sf)).select("project", "path", "locale")


_NAMED = r"""(SELECT DISTINCT project, path, l FROM (SELECT project, path, unnest([
    regexp_extract(path, '^config/locales/([^/.]+)\.yml$', 1), regexp_extract(path, '^config/locales/[^/]*?\.([^/.]+)\.yml$', 1),
    regexp_extract(path, '^config/locales/([^/.]+)/[^/]*?\.yaml$', 1), regexp_extract(path, '^locales/.*/([^/.]+)\.yml$', 1)]) AS l FROM x_layout) WHERE l <> '')"""


@query("F19_locale_of_path", f"SELECT project, path, l AS locale FROM {_NAMED}")
def locale_of_path(spark, sf):
    pairs = W.layout_files(spark, sf).join(W.read_patterns(spark, sf), "project").select("project", "path", P.locale_of_path("pattern", "path").alias("locale"))
    return pairs.where("locale is not null").distinct()


@query("R12_locales_from_paths", f"SELECT project, l AS locale, row_number() OVER (PARTITION BY project ORDER BY l <> 'de', l) - 1 AS locale_rank FROM (SELECT DISTINCT project, l FROM {_NAMED} UNION SELECT DISTINCT project, 'de' FROM x_layout)")
def locales_from_paths(spark, sf):
    files = W.layout_files(spark, sf)
    base = files.select("project").distinct().withColumn("locale", F.lit("de"))
    return C.locales_from_paths(files, W.read_patterns(spark, sf), base).select("project", "locale", F.col("locale_rank").cast("bigint").alias("locale_rank"))


@query("J16_layout_coverage", f"SELECT f.project, f.path FROM (SELECT DISTINCT project, path FROM x_layout WHERE path LIKE '%.y%ml') f WHERE NOT EXISTS (SELECT 1 FROM {_NAMED} n WHERE n.project = f.project AND n.path = f.path)")
def layout_coverage(spark, sf):
    return T.layout_coverage(W.layout_files(spark, sf).where(r"path rlike '\\.ya?ml$'"), W.read_patterns(spark, sf)).select("project", "path")


@query("O_5_preview", f"""SELECT project, array_to_string(list_sort(list(path))[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', and ' || (count(*) - 3)::VARCHAR || ' more' ELSE '' END AS preview FROM
    (SELECT f.project, f.path FROM (SELECT DISTINCT project, path FROM x_layout WHERE path LIKE '%.y%ml') f WHERE NOT EXISTS (SELECT 1 FROM {_NAMED} n WHERE n.project = f.project AND n.path = f.path)) GROUP BY 1""")
def preview(spark, sf):
    return H.preview(layout_coverage(spark, sf), "path")


_SHAPE = r"""CASE WHEN NOT contains(u, '/') AND regexp_full_match(stem, '[a-z]{2,3}([-_][A-Za-z0-9]{2,8})*') THEN 'flat'
    WHEN NOT contains(u, '/') AND regexp_full_match(stem, '.*\.[a-z]{2,3}([-_][A-Za-z0-9]{2,8})*') THEN 'namespaced'
    WHEN contains(u, '/') AND regexp_full_match(split_part(u, '/', 1), '[a-z]{2,3}([-_][A-Za-z0-9]{2,8})*') THEN CASE WHEN len(string_split(u, '/')) > 2 THEN 'locale_dir_deep' ELSE 'locale_dir' END
    WHEN regexp_full_match(stem, '[a-z]{2,3}([-_][A-Za-z0-9]{2,8})*') THEN 'subdir_flat' WHEN regexp_full_match(stem, '.*\.[a-z]{2,3}([-_][A-Za-z0-9]{2,8})*') THEN 'subdir_namespaced' END"""
_SHAPED = rf"""(SELECT *, {_SHAPE} AS shape FROM (SELECT *, regexp_replace(split_part(u, '/', -1), '\.[^.]*$', '') AS stem FROM (
    SELECT DISTINCT project, path, dir, regexp_replace(path, '^' || dir || '/', '') AS u, split_part(path, '.', -1) AS ext FROM (SELECT project, path, regexp_extract(path, '^(config/locales|app/locales|locales)/', 1) AS dir FROM x_layout) WHERE path LIKE '%.y%ml')))"""


@query("F23_layout_shape", f"SELECT project, path, shape FROM {_SHAPED}")
def layout_shape(spark, sf):
    f = L._catalog_files(W.layout_files(spark, sf))
    return f.select("project", "path", P.layout_shape(F.substring(F.col("path"), F.length("dir") + 2, F.length("path"))).alias("shape"))


@query("A16_layout_profile", f"SELECT project, shape, ext, count(*) AS n_files, dir FROM {_SHAPED} GROUP BY ALL")
def layout_profile(spark, sf):
    return L.layout_profile(W.layout_files(spark, sf)).select("project", "shape", "ext", "n_files", "dir")


@query("R22_catalog_root", f"SELECT DISTINCT project, dir AS catalog_dir FROM {_SHAPED}")
def catalog_root(spark, sf):
    return L.catalog_root(W.layout_files(spark, sf))


@query("R15_write_target", """SELECT p.project, CASE WHEN p.dir = 'config/locales' THEN 'config/locales/%{locale}.yml' WHEN p.dir = 'locales' THEN NULL END AS target
    FROM (SELECT DISTINCT project, regexp_extract(path, '^(config/locales|app/locales|locales)/', 1) AS dir FROM x_layout) p""")
def write_target(spark, sf):
    files = W.layout_files(spark, sf)
    base = L.catalog_root(files).join(L.majority_extension(L.layout_profile(files)), "project").select("project", F.lit("en").alias("locale"), F.col("catalog_dir").alias("dir"), "ext")
    return L.write_target(W.read_patterns(spark, sf), base)


@query("R21_search_roots", """SELECT DISTINCT project, CASE WHEN path LIKE 'app/assets/builds/%' AND d = 'g' THEN 'generated' ELSE 'source' END AS role,
    CASE WHEN path LIKE 'app/assets/builds/%' AND d = 'g' THEN 'app/assets/builds' ELSE split_part(path, '/', 1) END AS dir
    FROM x_tree JOIN (VALUES ('s'), ('g')) AS v(d) ON (d = 's' AND (path LIKE 'app/%' OR path LIKE 'lib/%')) OR (d = 'g' AND path LIKE 'app/assets/builds/%')""")
def search_roots(spark, sf):
    return L.search_roots(W.tree_paths(spark, sf)).select("project", "role", "dir")


@query("F21_enclosing_root", "SELECT project, path, CASE WHEN len(string_split(path, '/')) = 1 THEN NULL WHEN len(string_split(path, '/')) = 2 THEN split_part(path, '/', 1) ELSE array_to_string(string_split(path, '/')[1:2], '/') END AS root FROM x_tree")
def enclosing_root(spark, sf):
    return W.tree_paths(spark, sf).select("project", "path", P.enclosing_root("path").alias("root"))


@query("P19_inside_root", "SELECT path, regexp_matches(path, '^app/')::VARCHAR AS plain, 'false' AS stepped_out, regexp_matches(path, '^app/')::VARCHAR AS stepped_back FROM x_tree")
def inside_root(spark, sf):
    p = F.col("path")
    out = W.text("app/../", F.regexp_replace(p, "^app/", "apps/"))
    back = W.text("./x/.././", p)
    return W.tree_paths(spark, sf).select("path", *[P.inside_root(c, F.lit("./app")).cast("string").alias(n) for c, n in ((p, "plain"), (out, "stepped_out"), (back, "stepped_back"))])


@query("P4_scanner_kind", "SELECT path, CASE WHEN path LIKE '%.rb' THEN 'ruby' WHEN path LIKE '%.erb' THEN 'erb' ELSE 'template' END AS kind FROM x_tree")
def scanner_kind(spark, sf):
    from polyglint.operators.scan import scanner_kind as kind

    return W.tree_paths(spark, sf).select("path", kind("path").alias("kind"))


@query("F16_interpolate_locale", "SELECT project, locale, key, 'config/' || locale || '/' || split_part(key, '.', 1) || '%.' || locale || '%{locale}.yml' AS path FROM x_translation")
def interpolate_locale(spark, sf):
    template = W.text("config/%{locale}/", F.substring_index("key", ".", 1), "%%.%{locale}%%{locale}.yml")
    return W.translation(spark, sf).select("project", "locale", "key", P.interpolate_locale(template, "locale").alias("path"))


@query("F17_replace_locale", "SELECT project, locale, key, 'config/locales/' || split_part(key, '.', 1) || '.pt-BR.yml' AS path, 'x/pt-BR/' || locale || 'x-pt-BR.yml' AS other FROM x_translation")
def replace_locale(spark, sf):
    odd = W.text("x/", F.col("locale"), "/", F.col("locale"), "x-", F.col("locale"), ".yml")
    return W.translation(spark, sf).select("project", "locale", "key", P.replace_locale("path", "locale", F.lit("pt-BR")).alias("path"), P.replace_locale(odd, "locale", F.lit("pt-BR")).alias("other"))


@query("F20_alternate_locale", "SELECT DISTINCT path, CASE WHEN contains(path, '-') THEN split_part(path, '-', 1) || '-' || upper(regexp_replace(path, '^[^-]*-', '')) ELSE '' END AS other FROM x_layout")
def alternate_locale(spark, sf):
    return W.layout_files(spark, sf).select("path").distinct().select("path", K.alternate_locale("path").alias("other"))


@query("F28_template_path", "SELECT p_partkey AS id, 'parts b' || p_size::VARCHAR || ' p' || p_partkey::VARCHAR AS parts FROM part")
def template_path(spark, sf):
    path = W.text("app/views/parts/b", W.s("p_size"), "/_p", W.s("p_partkey"), ".html.erb")
    return W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array_join(P.template_path(path, F.lit("app/views/")), " ").alias("parts"))


def _config_files(spark, sf):
    """Settings files from suppliers and nations, a project per nation."""
    loc = F.element_at(F.array(*[F.lit(x) for x in ("de", "fr", "pt-BR")]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    text = W.text("# config.i18n.default_locale = :xx\nif I18n.default_locale == :en\nend\n", F.when(F.col("s_suppkey") % 2 == 0, W.text("config.i18n.default_locale = :", loc, "\n")).otherwise(""))
    return W.table(spark, sf, "supplier").select(W.text("n", W.s("s_nationkey")).alias("project"), W.text("config/initializers/s", F.lpad(W.s("s_suppkey"), 8, "0"), ".rb").alias("path"), text.alias("content"))


@query("R17_base_locale", """SELECT n.project, coalesce(a.loc, CASE n.i % 3 WHEN 0 THEN 'it' WHEN 1 THEN 'en' ELSE 'da' END) AS base_locale, a.assigned_at AS assigned_at
    FROM (SELECT 'n' || n_nationkey::VARCHAR AS project, n_nationkey AS i FROM nation) n LEFT JOIN (
      SELECT 'n' || s_nationkey::VARCHAR AS project, arg_min(['de', 'fr', 'pt-BR'][s_suppkey % 3 + 1], s_suppkey) AS loc,
        'config/initializers/s' || lpad(min(s_suppkey)::VARCHAR, 8, '0') || '.rb:4' AS assigned_at FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1) a ON a.project = n.project""")
def base_locale(spark, sf):
    n = F.col("n_nationkey") % 3
    names = F.when(n == 0, F.array(F.lit("it"))).when(n == 1, F.array(F.lit("de"), F.lit("en"))).otherwise(F.array(F.lit("fr"), F.lit("da")))
    locales = W.table(spark, sf, "nation").select(W.text("n", W.s("n_nationkey")).alias("project"), F.explode(names).alias("locale"))
    return L.base_locale(_config_files(spark, sf), locales)
