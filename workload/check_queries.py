"""Audits, rules, statistics and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import values as V
from polyglint.operators import catalog as C
from polyglint.operators import checks as H
from polyglint.operators import rules as R
from polyglint.operators import usage as U
from polyglint.sources import sinks
from polyglint.sources.staging import Staging
from workload import relations as W
from workload.registry import query

_CAND = """(SELECT DISTINCT project, key, c FROM (SELECT project, key, key AS c FROM x_use UNION ALL
    SELECT project, key, second_key FROM x_use WHERE second_key IS NOT NULL))"""
_MISSING_USED = f"""SELECT u.project, l.locale, u.key, u.f.p AS path, u.f.l AS line FROM
    (SELECT project, key, arg_min({{'p': path, 'l': line_num}}, {{'p': path, 'q': pos}}) AS f FROM x_use GROUP BY ALL) u
    JOIN x_locale l ON true
    WHERE NOT EXISTS (SELECT 1 FROM (SELECT c.project, c.key, p.locale FROM {_CAND} c JOIN x_present p ON p.project = c.project AND p.key = c.c) x
        WHERE x.project = u.project AND x.key = u.key AND x.locale = l.locale)"""
_IGNORED = """NOT EXISTS (SELECT 1 FROM x_ignore r WHERE r.project = {a}.project AND r.locale = {a}.locale AND r.kind = '{kind}'
    AND regexp_full_match({a}.{key}, r.re))"""
_MISSING_USED_RULED = f"""SELECT m.* FROM ({_MISSING_USED}) m WHERE NOT EXISTS (
    SELECT 1 FROM {_CAND} c JOIN x_ignore r ON r.project = c.project AND r.kind = 'missing' AND regexp_full_match(c.c, r.re)
    WHERE c.project = m.project AND c.key = m.key AND r.locale = m.locale)"""
_DIFF = """SELECT d.project, d.locale, d.key, d.present_in, d.value FROM (
      SELECT b.project, l.locale, b.key, 'en' AS present_in, b.value FROM
        (SELECT project, dep_key AS key, arg_min(value, key) AS value FROM x_dep WHERE locale = 'en' GROUP BY ALL) b JOIN x_locale l ON l.locale <> 'en'
      UNION ALL
      SELECT project, 'en', key, f.l, f.v FROM (SELECT project, dep_key AS key, arg_min({'l': locale, 'v': value}, {'r': locale_rank, 'k': key}) AS f
        FROM x_dep WHERE locale <> 'en' GROUP BY ALL)) d
    WHERE NOT EXISTS (SELECT 1 FROM x_present p WHERE p.project = d.project AND p.locale = d.locale AND p.key = d.key)"""
_DIFF_RULED = f"SELECT * FROM ({_DIFF}) d WHERE {_IGNORED.format(a='d', key='key', kind='missing')}"
_REQUIRED = "(VALUES ('en', ['one','other']), ('de', ['one','other']), ('fr', ['one','other']), ('ja', ['other']), ('ru', ['one','few','many','other'])) AS q(locale, need)"
_PLURAL = f"""SELECT n.project, n.locale, n.node AS key, array_to_string(list_filter(q.need, lambda c: NOT list_contains(n.forms, c)), ', ') AS categories
    FROM x_plural n JOIN {_REQUIRED} ON n.locale = q.locale WHERE NOT list_has_all(n.forms, q.need)"""
_PLURAL_RULED = f"SELECT * FROM ({_PLURAL}) p WHERE {_IGNORED.format(a='p', key='key', kind='missing')}"
_UNUSED = r"""SELECT project, locale, CASE WHEN whole THEN node ELSE key END AS key, CASE WHEN whole THEN NULL ELSE value END AS value, min(key) AS order_key FROM
    (SELECT u.*, p.node, p.n IS NOT NULL AND count(*) OVER (PARTITION BY u.project, u.locale, coalesce(p.node, u.key)) = p.n AS whole
     FROM x_unused_own u LEFT JOIN x_plural p ON p.project = u.project AND p.locale = u.locale AND p.node = u.dep_key AND u.dep_key <> u.key) GROUP BY 1, 2, 3, 4"""
_UNRULED_UNUSED = _UNUSED.replace("x_unused_own", "x_unruled_own")
_BESIDE = """(SELECT t.*, b.value AS base_value, b.value_type AS base_type FROM x_translation t JOIN x_translation b
    ON b.project = t.project AND b.key = t.key AND b.locale = 'en' WHERE t.locale <> 'en')"""
_EQ = f"SELECT e.project, e.locale, e.key, e.value FROM {_BESIDE} e WHERE e.value = e.base_value AND e.value_type = e.base_type"
_EQ_RULED = f"SELECT * FROM ({_EQ}) e WHERE {_IGNORED.format(a='e', key='key', kind='eq_base')}"


def _vars(col: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(regexp_replace({col}, '%%+\\{{', '{{', 'g'), '%\\{{[^}}]+\\}}')))"


_INTER = f"""SELECT e.project, e.locale, e.key, e.value, array_to_string({_vars('e.value')}, ', ') AS variables, array_to_string({_vars('e.base_value')}, ', ') AS base_variables
    FROM {_BESIDE} e WHERE e.value_type = 'str' AND e.base_type = 'str' AND {_vars('e.value')} <> {_vars('e.base_value')}"""
_INTER_RULED = f"""SELECT * FROM ({_INTER}) i WHERE NOT EXISTS (SELECT 1 FROM x_rule r WHERE r.project = i.project
    AND r.setting IN ('ignore', 'ignore_inconsistent_interpolations') AND (r.locale_group IS NULL OR r.locale_group = 'all') AND regexp_full_match(i.key, r.re))"""
_RESERVED = "SELECT project, locale, key, value, 'scope' AS names FROM x_translation WHERE value_type = 'str' AND value LIKE '% \\%{scope}' ESCAPE '\\'"
_STALE_UNUSED = "SELECT project, locale, key, value, order_key FROM (" + _UNRULED_UNUSED + ")"


def _inputs(spark, sf):
    return W.catalog(spark, sf), W.occurrences(spark, sf), W.rules(spark, sf), W.locale_dim(spark, sf)


def _missing_used(spark, sf, ruled=True):
    tr, occ, rules, loc = _inputs(spark, sf)
    return H.missing_used(occ, tr, rules if ruled else None, loc)


@query("J1_present", "SELECT DISTINCT t.project, l.locale, t.dep_key AS key FROM x_dep t JOIN x_locale l ON true WHERE EXISTS (SELECT 1 FROM x_present p WHERE p.project = t.project AND p.locale = l.locale AND p.key = t.dep_key)")
def present(spark, sf):
    tr = W.catalog(spark, sf)
    keys = C.depluralized_leaves(C.internal(tr)).select("project", F.col("dep_key").alias("key")).distinct()
    asked = keys.join(W.locale_dim(spark, sf).select("project", "locale"), "project")
    return H.present(asked, tr).select("project", "locale", "key")


@query("J2_missing_used", f"SELECT project, locale, key, path, line FROM ({_MISSING_USED_RULED})")
def missing_used(spark, sf):
    return _missing_used(spark, sf).select("project", "locale", "key", "path", "line")


@query("J3_missing_diff", f"SELECT project, locale, key, present_in, value FROM ({_DIFF_RULED})")
def missing_diff(spark, sf):
    tr, _, rules, loc = _inputs(spark, sf)
    return H.missing_diff(tr, rules, loc).select("project", "locale", "key", "present_in", "value")


@query("W3_first_per_key", f"SELECT project, locale, key, present_in, value FROM ({_DIFF})")
def first_per_key(spark, sf):
    tr, _, _, loc = _inputs(spark, sf)
    return H.first_per_key(H.diff_leaves(tr, None, loc)).select("project", "locale", "key", "present_in", "value")


@query("J4_used_by_ancestor", "SELECT project, dep_key AS key FROM x_used_leaf")
def used_by_ancestor(spark, sf):
    leaves = C.depluralized_leaves(W.own_catalog(spark, sf))
    return U.used_by_ancestor(leaves, W.occurrences(spark, sf), "dep_key")


@query("J5_used_by_pattern", """SELECT DISTINCT t.project, t.key FROM x_translation t JOIN (SELECT DISTINCT project, pattern FROM x_pattern) p
    ON p.project = t.project AND regexp_full_match(t.key, replace(replace(p.pattern, '.', '\\.'), '*', '.*'))""")
def used_by_pattern(spark, sf):
    return U.used_by_pattern(W.own_catalog(spark, sf).select("project", "key").distinct(), W.occurrences(spark, sf))


@query("J6_without_ignored", f"SELECT t.project, t.locale, t.key FROM x_translation t WHERE {_IGNORED.format(a='t', key='key', kind='missing')}")
def without_ignored(spark, sf):
    return R.without_ignored(W.own_catalog(spark, sf), W.rules(spark, sf), "missing", "key", "locale").select("project", "locale", "key")


def _unused(spark, sf, ruled=True):
    tr, occ, rules, loc = _inputs(spark, sf)
    return H.unused(tr, occ, rules if ruled else None, loc)


@query("J7_unused", f"SELECT project, locale, key, value FROM ({_UNUSED})")
def unused(spark, sf):
    return _unused(spark, sf).select("project", "locale", "key", "value")


@query("J8_eq_base", _EQ_RULED)
def eq_base(spark, sf):
    tr, _, rules, loc = _inputs(spark, sf)
    return H.eq_base(tr, rules, loc).select("project", "locale", "key", "value")


@query("J9_inconsistent_placeholders", _INTER_RULED)
def inconsistent(spark, sf):
    tr, _, rules, loc = _inputs(spark, sf)
    return H.inconsistent_placeholders(tr, rules, loc).select("project", "locale", "key", "value", "variables", "base_variables")


@query("J10_depluralize", r"""SELECT a.project, a.locale, a.key, CASE WHEN a.form <> 'title' AND coalesce(o.n IS NOT NULL, false) OR a.form <> 'title' AND own.project IS NULL AND b.n IS NOT NULL THEN a.k ELSE a.key END AS dep_key
    FROM (SELECT k.project, l.locale, k.k || '.' || f.form AS key, k.k, f.form FROM x_key k, x_locale l, (VALUES ('one'), ('many'), ('title')) AS f(form)) a
    LEFT JOIN x_plural o ON o.project = a.project AND o.locale = a.locale AND o.node = a.k
    LEFT JOIN (SELECT DISTINCT project, locale, regexp_replace(key, '\.[a-z0-9]+$', '') AS node FROM x_translation) own ON own.project = a.project AND own.locale = a.locale AND own.node = a.k
    LEFT JOIN x_plural b ON b.project = a.project AND b.locale = 'en' AND b.node = a.k""")
def depluralize(spark, sf):
    keys = W.keys(spark, sf).join(W.locale_dim(spark, sf).select("project", "locale"), "project").select(
        "project", "locale", F.explode(F.array(*[W.text(F.col("k"), f) for f in (".one", ".many", ".title")])).alias("key")
    )
    return C.depluralize(keys, W.own_catalog(spark, sf), W.locale_dim(spark, sf)).select("project", "locale", "key", "dep_key")


@query("J11_missing_plural", _PLURAL_RULED)
def missing_plural(spark, sf):
    tr, _, rules, loc = _inputs(spark, sf)
    return H.missing_plural(tr, C.plural_dim(spark), rules, loc).select("project", "locale", "key", "categories")


@query("J14_stale_rules", f"""SELECT DISTINCT r.project, r.rule_id, r.setting, r.pattern FROM x_rule r WHERE NOT EXISTS (
    SELECT 1 FROM x_ignore i JOIN (
        SELECT DISTINCT project, 'missing' AS kind, locale, key FROM (SELECT project, locale, key FROM ({_MISSING_USED}) UNION ALL SELECT project, locale, key FROM ({_DIFF}) UNION ALL SELECT project, locale, key FROM ({_PLURAL}))
        UNION ALL SELECT project, 'unused', locale, key FROM ({_UNRULED_UNUSED})
        UNION ALL SELECT project, 'eq_base', locale, key FROM ({_EQ})
        UNION ALL SELECT project, 'interpolations', locale, key FROM ({_INTER})) f
      ON f.project = i.project AND f.kind = i.kind AND f.locale = i.locale AND regexp_full_match(f.key, i.re)
    WHERE i.rule_id = r.rule_id AND i.project = r.project)""")
def stale_rules(spark, sf):
    tr, occ, rules, loc = _inputs(spark, sf)
    return R.stale_rules(rules, H.suppressible(occ, tr, C.plural_dim(spark), rules, loc))


@query("J17_select_unused", f"""SELECT u.project, u.locale, u.key FROM x_unused_own u JOIN ({_UNUSED}) f ON f.project = u.project AND f.locale = u.locale
    AND (f.key = u.key OR u.key LIKE f.key || '.%') AND (f.key LIKE 'ns1.o.%' OR f.key LIKE 'ns1.p.%')""")
def select_unused(spark, sf):
    tr, occ, rules, loc = _inputs(spark, sf)
    leaves = Staging(spark).table(H.unused_leaves(tr, occ, rules, loc))
    return H.select_unused(H.unused_of(leaves), leaves, "ns1.{o,p}.:")[1].select("project", "locale", "key")


@query("A1_catalog_stats", """SELECT t.project, 'en, de, fr, ja, ru' AS locales, count(*) AS key_count, 5 AS locale_count, count(*) // 5 AS per_locale_avg,
    printf('%.1f', sum(depth) / count(*)) AS key_segments_avg, (sum(length(value)) // count(*))::BIGINT AS value_chars_avg FROM x_translation t GROUP BY 1""")
def catalog_stats(spark, sf):
    return C.statistics(W.own_catalog(spark, sf), W.locale_dim(spark, sf))


@query("A2_used_keys", """SELECT project, key, count(*) AS n_occurrences, arg_min(path, {'p': path, 'q': pos}) AS first_path, arg_min(line_num, {'p': path, 'q': pos}) AS first_line FROM x_use GROUP BY 1, 2""")
def used_keys(spark, sf):
    return U.used_keys(W.occurrences(spark, sf))


@query("A3_pattern_set", "SELECT DISTINCT project, pattern FROM x_pattern")
def pattern_set(spark, sf):
    return U.pattern_set(W.occurrences(spark, sf))


@query("A5_plural_forms", r"""SELECT project, locale, parent, count(*) AS n_children, coalesce(string_agg(child, ' ' ORDER BY child) FILTER (child IN ('zero','one','two','few','many','other','0','1')), '') AS forms
    FROM (SELECT DISTINCT project, locale, array_to_string(s[1:i], '.') AS parent, s[i + 1] AS child FROM
      (SELECT project, locale, s, unnest(generate_series(1, len(s) - 1)) AS i FROM (SELECT project, locale, string_split(key, '.') AS s FROM x_translation))) GROUP BY 1, 2, 3""")
def plural_forms(spark, sf):
    return C.plural_forms(W.own_catalog(spark, sf)).withColumn("forms", F.array_join("forms", " "))


@query("A6_collapse_plurals", f"SELECT project, locale, key, value FROM ({_UNRULED_UNUSED})")
def collapse_plurals(spark, sf):
    return _unused(spark, sf, ruled=False).select("project", "locale", "key", "value")


@query("W4_collapse_order", f"SELECT project, locale, key, order_key FROM ({_UNUSED})")
def collapse_order(spark, sf):
    tr, occ, rules, loc = _inputs(spark, sf)
    return H.collapse_plurals(H.unused_leaves(tr, occ, rules, loc)).select("project", "locale", "key", "order_key").orderBy("project", "locale", "order_key")


@query("A8_plural_dim", "SELECT l.project, x.spelled AS locale, x.need AS categories FROM x_project l, (VALUES ('en', 'one other'), ('de', 'one other'), ('fr', 'one other'), ('ja', 'other'), ('ru', 'one few many other'), ('pt-br', 'one other')) AS x(spelled, need)")
def plural_dim(spark, sf):
    loc = W.locale_dim(spark, sf).select("project", "locale")
    more = loc.select("project").distinct().select("project", F.explode(F.array(F.lit("pt-br"), F.lit("xx"))).alias("locale"))
    return C.required_categories(loc.unionByName(more), C.plural_dim(spark)).withColumn("categories", F.array_join("categories", " "))


@query("A17_config_digest", """SELECT project, count(*) AS n_rules, sha256(array_to_string([sum(('0x' || substr(h, 1, 12))::UBIGINT)::VARCHAR, sum(('0x' || substr(h, 13, 12))::UBIGINT)::VARCHAR,
    sum(('0x' || substr(h, 25, 12))::UBIGINT)::VARCHAR, sum(('0x' || substr(h, 37, 12))::UBIGINT)::VARCHAR], ',')) AS digest FROM
    (SELECT DISTINCT project, setting, pattern, locale_group, sha256(concat_ws(chr(1), setting, pattern, coalesce(locale_group, ''))) AS h FROM x_rule) GROUP BY 1""")
def config_digest(spark, sf):
    return R.config_digest(W.rules(spark, sf))


@query("U1_missing", f"""SELECT project, locale, key, 'plural' AS reason_type, 0 AS type_rank FROM ({_PLURAL_RULED}) UNION ALL SELECT project, locale, key, 'used', 1 FROM ({_MISSING_USED_RULED})
    UNION ALL SELECT project, locale, key, 'diff', 2 FROM ({_DIFF_RULED})""")
def missing(spark, sf):
    tr, occ, rules, loc = _inputs(spark, sf)
    return H.missing(occ, tr, C.plural_dim(spark), rules, loc, ["plural", "used", "diff"]).select("project", "locale", "key", "reason_type", "type_rank")


@query("P20_missing_types", f"SELECT project, locale, 'diff' AS reason_type, count(*) AS n FROM ({_DIFF}) GROUP BY 1, 2")
def missing_types(spark, sf):
    tr, occ, _, loc = _inputs(spark, sf)
    return H.missing(occ, tr, C.plural_dim(spark), None, loc, ["diff"]).groupBy("project", "locale", "reason_type").agg(F.count("*").alias("n"))


@query("U3_merge_rules", "SELECT DISTINCT project, rule_id, setting, kind FROM x_ignore")
def merge_rules(spark, sf):
    return R.merge_rules(W.rules(spark, sf)).select("project", "rule_id", "setting", "kind").distinct()


@query("R13_rule_rows", "SELECT DISTINCT project, rule_id, setting, pattern, locale_group FROM x_rule")
def rule_rows(spark, sf):
    return W.rules(spark, sf).select("project", "rule_id", "setting", "pattern", "locale_group")


@query("U4_category_difference", f"SELECT project, locale, categories, count(*) AS n FROM ({_PLURAL}) GROUP BY 1, 2, 3")
def category_difference(spark, sf):
    tr, _, _, loc = _inputs(spark, sf)
    return H.missing_plural(tr, C.plural_dim(spark), None, loc).groupBy("project", "locale", "categories").agg(F.count("*").alias("n"))


@query("U5_placeholder_set_equal", f"""SELECT o.project, o.locale, o.key, (o.v = b.v)::VARCHAR AS same
    FROM (SELECT project, locale, key, {_vars('value')} AS v FROM x_translation WHERE locale_rank > 0) o
    JOIN (SELECT project, key, {_vars('value')} AS v FROM x_translation WHERE locale_rank = 0) b ON o.project = b.project AND o.key = b.key""")
def placeholder_set_equal(spark, sf):
    beside = H._beside_base(W.own_catalog(spark, sf), W.locale_dim(spark, sf))
    sets = beside.withColumn("own", V.placeholder_set("value")).withColumn("base", V.placeholder_set("base_value"))
    return sets.select("project", "locale", "key", H.placeholder_set_equal("own", "base").cast("string").alias("same"))


@query("R14_reserved_placeholders", _RESERVED)
def reserved(spark, sf):
    return H.reserved_placeholders(W.own_catalog(spark, sf), W.locale_dim(spark, sf)).select("project", "locale", "key", "value", "names")


@query("P17_is_reserved", r"SELECT project, locale, key, name, (name IN ('scope', 'default', 'format'))::VARCHAR AS reserved FROM (SELECT project, locale, key, replace(replace(unnest(regexp_extract_all(regexp_replace(value, '%%+\{', '{', 'g'), '%\{[^}]+\}')), '%{', ''), '}', '') AS name FROM x_translation)")
def is_reserved(spark, sf):
    names = W.translation(spark, sf).select("project", "locale", "key", F.explode(V.placeholders("value")).alias("m"))
    return names.select("project", "locale", "key", V.placeholder_name("m").alias("name"), V.is_reserved(V.placeholder_name("m")).cast("string").alias("reserved"))


@query("R18_opaque_calls", "SELECT project, path, pos FROM x_opaque")
def opaque_calls(spark, sf):
    return U.opaque_calls(W.occurrences(spark, sf)).select("project", "path", "pos")


@query("P18_select_locales", "SELECT p.project, l.locale, l.r AS locale_rank, l.problem FROM x_project p, (VALUES ('en', 0, NULL), ('fr', 1, NULL), ('-x', 2, 'invalid'), ('ru', 3, NULL), ('xx', 4, 'unknown')) AS l(locale, r, problem)")
def select_locales(spark, sf):
    return H.select_locales(W.locale_dim(spark, sf), ["fr", "base", "fr", "-x", "ru", "xx"]).select("project", "locale", "locale_rank", "problem")


_HEALTH_CHECKS = f"""SELECT project, 'missing' AS c FROM ({_MISSING_USED_RULED}) UNION ALL SELECT project, 'missing' FROM ({_DIFF_RULED}) UNION ALL SELECT project, 'missing' FROM ({_PLURAL_RULED})
    UNION ALL SELECT project, 'unused' FROM ({_UNUSED}) UNION ALL SELECT project, 'consistent_interpolations' FROM ({_INTER_RULED})
    UNION ALL SELECT project, 'reserved_interpolations' FROM ({_RESERVED})
    UNION ALL SELECT project, 'normalized' FROM (SELECT DISTINCT project, path FROM x_translation WHERE path LIKE '%ns3.fr.yml' OR path LIKE '%ns1%.de.yml')"""


@query("A7_health", f"""SELECT p.project, k.c AS "check", count(f.c) AS n, (count(f.c) = 0)::VARCHAR AS passed FROM x_project p
    JOIN (VALUES ('missing'), ('unused'), ('consistent_interpolations'), ('reserved_interpolations'), ('normalized')) AS k(c) ON true
    LEFT JOIN ({_HEALTH_CHECKS}) f ON f.project = p.project AND f.c = k.c GROUP BY 1, 2""")
def health(spark, sf):
    from polyglint.plans.audit import health_outcome, health_findings

    tr, occ, rules, loc = _inputs(spark, sf)
    found = health_findings(tr, occ, C.plural_dim(spark), rules, loc, W.stored_docs(spark, sf))
    return health_outcome(found, loc).withColumn("passed", F.col("passed").cast("string"))


@query("S9_findings_sink", f"""SELECT p.project, c.c AS "check", '{{"check":"' || c.c || '","passed":' || (count(f.project) = 0)::VARCHAR || ',"locales":["en","de","fr","ja","ru"],"n_rows":' || count(f.project)::VARCHAR || '}}' AS header
    FROM x_project p JOIN (VALUES ('eq_base'), ('reserved_interpolations')) AS c(c) ON true
    LEFT JOIN (SELECT project, 'eq_base' AS c FROM ({_EQ_RULED}) UNION ALL SELECT project, 'reserved_interpolations' FROM ({_RESERVED})) f ON f.project = p.project AND f.c = c.c GROUP BY 1, 2""")
def findings_envelope(spark, sf):
    tr, _, rules, loc = _inputs(spark, sf)
    found = H.eq_base(tr, rules, loc).unionByName(H.reserved_placeholders(tr, loc))
    none = R.config_digest(rules).withColumn("digest", F.lit(None).cast("string"))
    return sinks.findings_envelope(found, none, loc, ["eq_base", "reserved_interpolations"])


@query("F26_reason_text", f"""SELECT project, locale, key, 'used: ' || path || ':' || line::VARCHAR AS reason FROM ({_MISSING_USED_RULED})
    UNION ALL SELECT project, locale, key, 'diff: present in ' || present_in FROM ({_DIFF_RULED})
    UNION ALL SELECT project, locale, key, 'plural: missing ' || categories FROM ({_PLURAL_RULED})
    UNION ALL SELECT project, locale, key, locale || ' has ' || CASE variables WHEN '' THEN 'no variables' ELSE variables END || ', en has ' || CASE base_variables WHEN '' THEN 'no variables' ELSE base_variables END FROM ({_INTER_RULED})
    UNION ALL SELECT project, locale, key, names FROM ({_RESERVED})""")
def reason_text(spark, sf):
    from polyglint.plans.context import AuditContext, literal

    tr, occ, rules, loc = _inputs(spark, sf)
    context, loc = AuditContext(tr, occ, rules), literal(loc)
    tr, occ, rules = context.catalog, context.usage, context.rules
    found = (
        H.missing(occ, tr, C.plural_dim(spark), rules, loc).drop("type_rank")
        .unionByName(H.inconsistent_placeholders(tr, rules, loc)).unionByName(H.reserved_placeholders(tr, loc))
    )
    return found.select("project", "locale", "key", V.reason_text(F.lit("en")).alias("reason"))


@query("S10_usage_dump", """SELECT project, 'key' AS section, key, path, line_num AS line, line_pos AS "column", key AS raw_key, concat_ws(' ', key, second_key) AS candidates FROM x_use
    UNION ALL SELECT DISTINCT project, 'pattern', pattern, NULL, NULL, NULL, NULL, NULL FROM x_pattern
    UNION ALL SELECT project, 'opaque', NULL, path, pos, 0, NULL, '' FROM x_opaque""")
def usage_dump(spark, sf):
    return U.usage_dump(W.occurrences(spark, sf)).drop("pos")


@query("U2_merge_scans", "SELECT project, kind, count(*) AS n FROM (SELECT project, 'key' AS kind FROM x_use UNION ALL SELECT project, 'pattern' FROM x_pattern UNION ALL SELECT project, 'opaque' FROM x_opaque) GROUP BY 1, 2")
def merge_scans(spark, sf):
    o = W.occurrences(spark, sf)
    parts = [o.where(F.col("kind") == k) for k in ("key", "pattern", "opaque")]
    return U.merge_scans(*parts).groupBy("project", "kind").agg(F.count("*").alias("n"))


@query("F2_last_key_part", "SELECT project, locale, key, split_part(key, '.', -1) AS last FROM x_translation")
def last_key_part(spark, sf):
    return W.translation(spark, sf).select("project", "locale", "key", K.last_key_part("key").alias("last"))


@query("F3_parent_key", r"SELECT project, locale, key, regexp_extract(key, '^(.*)\.[^.]*$', 1) AS parent FROM x_translation")
def parent_key(spark, sf):
    return W.translation(spark, sf).select("project", "locale", "key", K.parent_key("key").alias("parent"))


@query("F4_ancestors", "SELECT project, locale, key, array_to_string([array_to_string(s[1:i], '.') for i in generate_series(1, len(s))], ' ') AS chain FROM (SELECT *, string_split(key, '.') AS s FROM x_translation)")
def ancestors(spark, sf):
    return W.translation(spark, sf).select("project", "locale", "key", F.array_join(K.ancestors("key"), " ").alias("chain"))


@query("F8_pattern_match", r"""SELECT t.project, t.key, r.rule_id, regexp_extract(t.key, r.re, 0) = t.key AS hit FROM (SELECT DISTINCT project, key FROM x_translation) t JOIN
    (SELECT DISTINCT project, rule_id, re FROM x_rule) r ON r.project = t.project WHERE regexp_full_match(t.key, r.re)""")
def pattern_match(spark, sf):
    from polyglint.functions import patterns as M

    keys = W.translation(spark, sf).select("project", "key").distinct()
    r = W.rules(spark, sf).select(F.col("project").alias("p_project"), "rule_id", F.col("pattern").alias("p_pattern"), F.lit(None).cast("string").alias("p_group")).distinct()
    return M.matching_pairs(keys, r).select("project", "key", "rule_id", F.lit(True).alias("hit")).distinct()


@query("F9_placeholders", r"SELECT project, locale, key, array_to_string(regexp_extract_all(regexp_replace(value, '%%+\{', '{', 'g'), '%\{[^}]+\}'), ' ') AS found FROM x_translation")
def placeholders(spark, sf):
    return W.translation(spark, sf).select("project", "locale", "key", F.array_join(V.placeholders("value"), " ").alias("found"))


@query("F10_placeholder_name", r"SELECT project, locale, key, unnest([regexp_replace(regexp_replace(m, '^%\{', ''), '\}$', '') for m in regexp_extract_all(regexp_replace(value, '%%+\{', '{', 'g'), '%\{[^}]+\}')]) AS name FROM x_translation")
def placeholder_name(spark, sf):
    names = W.translation(spark, sf).select("project", "locale", "key", F.explode(V.placeholders("value")).alias("m"))
    return names.select("project", "locale", "key", V.placeholder_name("m").alias("name"))
