"""The derived relations in SQL, for the oracle. ``sql(body)`` puts them before a query."""

_CTES = {
    "x_locale": "SELECT * FROM (VALUES ('en',0,7),('de',1,11),('fr',2,13),('ja',3,17),('ru',4,19)) AS t(locale, locale_rank, gap)",
    "x_project": "SELECT * FROM (VALUES ('high'),('low'),('medium'),('not specified'),('urgent')) AS t(project)",
    "x_key": """SELECT o_orderkey AS id, lower(substr(o_orderpriority, 3)) AS project,
        'ns' || (o_custkey % 17)::VARCHAR || '.' || lower(o_orderstatus) || '.k' || o_orderkey::VARCHAR AS k,
        o_orderpriority AS p, o_totalprice AS total FROM orders""",
    "x_translation": """SELECT k.project, l.locale, l.locale_rank, k.id, f.n AS form_no,
        k.k || f.form AS key,
        CASE WHEN k.id % 23 = 0 THEN 'plain' ELSE 'str' END AS value_type,
        CASE WHEN k.id % 23 = 0 THEN k.id::VARCHAR
             WHEN k.id % 5 = 0 THEN k.p || ' %{n} ' || CASE WHEN k.id % (l.locale_rank + 9) = 0 THEN '%{scope}' ELSE '%%{esc}' END
             WHEN k.id % 4 = 0 THEN k.p ELSE k.p || ' ' || l.locale END AS value,
        'config/locales/' || split_part(k.k, '.', 1) || '.' || l.locale || '.yml' AS path,
        k.id * 10 + f.n AS ordinal,
        len(string_split(k.k || f.form, '.')) AS depth
      FROM x_key k JOIN x_locale l ON k.id % l.gap <> 5
      JOIN (VALUES ('', 0, 0), ('.one', 0, 1), ('.few', 1, 2), ('.other', 1, 3), ('.other', 2, 4)) AS f(form, n, c)
        ON CASE WHEN k.id % 10 <> 3 THEN c = 0 WHEN l.locale = 'ru' AND k.id % 3 <> 0 THEN c IN (1, 2, 4) ELSE c IN (1, 3) END""",
    "x_loaded": """SELECT project, locale, locale_rank, key, value_type, value, path, ordinal FROM x_translation
      UNION ALL SELECT project, locale, locale_rank, key, value_type, CASE WHEN id % 38 = 0 THEN value || ' again' ELSE value END,
        'config/locales/zz_override.' || locale || '.yml', ordinal FROM x_translation WHERE id % 19 = 0
      UNION ALL SELECT project, locale, locale_rank, key, value_type, value || ' twice', path, ordinal + 5 FROM x_translation WHERE id % 29 = 0""",
    "x_external": """SELECT p.project, l.locale, 'unknown.k' || p_partkey::VARCHAR AS key FROM part, x_project p, x_locale l WHERE p_size <= 10
      UNION ALL SELECT project, locale, k FROM x_key JOIN (VALUES ('en'), ('de')) AS l(locale) ON total > 400000""",
    "x_present": """SELECT DISTINCT project, locale, key FROM (
        SELECT project, locale, unnest([array_to_string(s[1:i], '.') for i in generate_series(1, len(s))]) AS key
        FROM (SELECT project, locale, string_split(key, '.') AS s FROM
          (SELECT project, locale, key FROM x_translation UNION ALL SELECT project, locale, key FROM x_external)))""",
    "x_dep": r"""SELECT *, CASE WHEN id % 10 = 3 THEN regexp_replace(key, '\.[a-z]+$', '') ELSE key END AS dep_key FROM x_translation""",
    "x_call": """SELECT k.project, 'app/views/s' || l_suppkey::VARCHAR || '/p' || (l_partkey % 50)::VARCHAR || '.html.slim' AS path,
        (l_orderkey * 8 + l_linenumber)::BIGINT AS pos, (l_orderkey + 1)::BIGINT AS line_num, l_linenumber::INT AS line_pos,
        CASE WHEN l_partkey % 29 = 0 THEN 'unknown.k' || l_partkey::VARCHAR ELSE k.k END AS key,
        CASE WHEN l_partkey % 29 = 0 AND l_returnflag = 'A' THEN k.k END AS second_key
      FROM lineitem JOIN x_key k ON l_orderkey = k.id""",
    "x_use": """SELECT project, path, pos, line_num, line_pos, key, second_key FROM x_call
      UNION ALL SELECT project, 'app/models/nation.rb', n_nationkey + 1, n_nationkey + 1, 0, 'ns' || n_nationkey::VARCHAR || '.p', NULL
        FROM nation, x_project WHERE n_regionkey = 0""",
    "x_pattern": """SELECT project, 'app/models/part.rb' AS path, (p_partkey + 1)::INT AS pos,
        'ns' || p_size::VARCHAR || '.' || CASE WHEN p_partkey % 2 = 0 THEN 'o' ELSE 'p' END || '.k*7' AS pattern
      FROM part, x_project WHERE p_size <= 3""",
    "x_opaque": """SELECT project, 'app/services/s' || s_suppkey::VARCHAR || '.rb' AS path, (s_suppkey + 1)::INT AS pos
      FROM supplier, x_project
      UNION ALL SELECT project, 'app/models/nation.rb', n_nationkey + 1 FROM nation, x_project WHERE n_regionkey <> 0
      UNION ALL SELECT project, 'app/models/part.rb', (p_partkey + 1)::INT FROM part, x_project WHERE p_size > 3""",
    "x_config": """SELECT project, n_nationkey * 5 + pi AS rule_id,
        ['ignore', 'ignore_missing', 'ignore_unused', 'ignore_eq_base', 'ignore_inconsistent_interpolations'][n_nationkey % 5 + 1] AS setting,
        CASE WHEN n_nationkey < 5 THEN 'ns' || n_nationkey || '.*' WHEN n_nationkey < 10 THEN 'ns' || n_nationkey || '.{o, f}.*'
             WHEN n_nationkey < 15 THEN '*.k' || n_nationkey || '*' WHEN n_nationkey < 20 THEN 'ns' || (n_nationkey % 17) || '.:.k*7'
             ELSE 'nothing' || n_nationkey || '.*' END AS pattern,
        CASE WHEN n_nationkey % 5 = 0 OR n_nationkey < 5 OR n_nationkey >= 15 THEN NULL WHEN n_nationkey < 10 THEN 'de, fr' ELSE 'all' END AS group_text,
        n_nationkey AS priority
      FROM nation, (SELECT project, row_number() OVER (ORDER BY project) - 1 AS pi FROM x_project)""",
    # re: the pattern as a regular expression of the oracle's own engine
    "x_rule": r"""SELECT project, rule_id, setting, pattern, priority, CASE WHEN group_text IS NULL THEN NULL ELSE trim(g) END AS locale_group,
        replace(replace(regexp_replace(replace(replace(replace(pattern, '.', '\.'), '*', '.*'), ':', '[^.]+'), '\{([^}]*)\}', '(?:\1)'), ', ', '|'), '{', '\{') AS re
      FROM (SELECT *, unnest(string_split(coalesce(group_text, '-'), ',')) AS g FROM x_config)""",
    # every (locale, rule) of a kind that applies when the locale is known
    "x_ignore": """SELECT r.*, l.locale, k.kind FROM x_rule r
      JOIN (VALUES ('ignore_missing','missing'),('ignore_unused','unused'),('ignore_eq_base','eq_base'),('ignore_inconsistent_interpolations','interpolations')) AS k(s, kind)
        ON r.setting = k.s OR r.setting = 'ignore'
      JOIN x_locale l ON r.locale_group IS NULL OR r.locale_group = 'all' OR r.locale_group = l.locale""",
    "x_plural": r"""SELECT project, locale, regexp_replace(key, '\.[a-z]+$', '') AS node, count(*) AS n, list(regexp_extract(key, '[a-z]+$')) AS forms
      FROM x_translation WHERE id % 10 = 3 GROUP BY ALL""",
    "x_used": "SELECT DISTINCT project, key FROM x_use",
    "x_used_leaf": r"""SELECT DISTINCT d.project, d.dep_key FROM
        (SELECT DISTINCT project, dep_key, split_part(dep_key, '.', 1) AS a1, array_to_string(string_split(dep_key, '.')[1:2], '.') AS a2 FROM x_dep) d
      JOIN x_used u ON u.project = d.project AND u.key IN (d.dep_key, d.a1, d.a2)""",
    "x_unused": r"""SELECT d.* FROM x_dep d
      LEFT JOIN x_used_leaf u ON u.project = d.project AND u.dep_key = d.dep_key
      WHERE u.dep_key IS NULL
        AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT project, pattern FROM x_pattern) p WHERE p.project = d.project AND regexp_full_match(d.key, replace(replace(p.pattern, '.', '\.'), '*', '.*')))
        AND NOT EXISTS (SELECT 1 FROM x_rule r WHERE r.project = d.project AND r.setting IN ('ignore', 'ignore_unused') AND (r.locale_group IS NULL OR r.locale_group = 'all') AND regexp_full_match(d.key, r.re))""",
    "x_unused_own": "SELECT u.* FROM x_unused u WHERE NOT EXISTS (SELECT 1 FROM x_external e WHERE e.project = u.project AND e.locale = u.locale AND (e.key = u.key OR e.key LIKE u.key || '.%'))",
    "x_unruled": r"""SELECT d.* FROM x_dep d
      LEFT JOIN x_used_leaf u ON u.project = d.project AND u.dep_key = d.dep_key
      WHERE u.dep_key IS NULL
        AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT project, pattern FROM x_pattern) p WHERE p.project = d.project AND regexp_full_match(d.key, replace(replace(p.pattern, '.', '\.'), '*', '.*')))""",
    "x_unruled_own": "SELECT u.* FROM x_unruled u WHERE NOT EXISTS (SELECT 1 FROM x_external e WHERE e.project = u.project AND e.locale = u.locale AND (e.key = u.key OR e.key LIKE u.key || '.%'))",
    "x_tree": """SELECT o_orderkey, lower(substr(o_orderpriority, 3)) AS project, CASE o_orderkey % 8 WHEN 0 THEN 'app/models/m' || o_orderkey || '.rb'
        WHEN 1 THEN 'app/assets/builds/b' || o_orderkey || '.js' WHEN 2 THEN 'app/assets/i' || o_orderkey || '.png' WHEN 3 THEN 'lib/.cache/c' || o_orderkey || '.rb'
        WHEN 4 THEN 'lib/tasks/t' || o_orderkey || '.rake' WHEN 5 THEN 'app/views/v' || o_orderkey || '/index.html.erb' WHEN 6 THEN 'vendor/x' || o_orderkey || '/lib/y.rb'
        ELSE 'app/.hidden' || o_orderkey || '.rb' END AS path FROM orders""",
    "x_layout": """SELECT DISTINCT project, root || '/' || CASE c % 8 WHEN 0 THEN l || '.yml' WHEN 1 THEN 'n' || c || '.' || l || '.yml' WHEN 2 THEN l || '/m' || c || '.yaml'
        WHEN 3 THEN l || '/a/b' || c || '.yml' WHEN 4 THEN 'sub' || c || '/' || l || '.yml' WHEN 5 THEN 'sub/x' || c || '.' || l || '.yml' WHEN 6 THEN 'odd' || c || '/names.yml'
        ELSE 'README' || c || '.md' END AS path
      FROM (SELECT c_custkey AS c, lower(c_mktsegment) AS project, ['en', 'de', 'pt-BR', 'zh_Hans'][c_nationkey % 4 + 1] AS l,
        CASE c_mktsegment WHEN 'BUILDING' THEN 'locales' WHEN 'MACHINERY' THEN 'app/locales' ELSE 'config/locales' END AS root FROM customer)""",
    "x_template": """SELECT *, CASE line_pos WHEN 1 THEN '= t(''' || key || ''')' WHEN 2 THEN 'p = I18n.t "' || key || '", default: "x"'
        WHEN 3 THEN 'é #{t(:"' || key || '")} text' WHEN 4 THEN '/ t(''' || key || ''')' WHEN 5 THEN '= t(:name, scope: ''' || key || ''')'
        WHEN 6 THEN '= t("' || key || '.#{x}")' ELSE '= t(:v, scope: obj) # ' || key END AS line,
        row_number() OVER (PARTITION BY project, path ORDER BY pos) AS n FROM x_call""",
}
_NAMES = list(_CTES)


def sql(body: str) -> str:
    """The relations ``body`` uses, directly or through one another, and then ``body``."""
    need: set[str] = set()

    def add(text: str) -> None:
        import re

        for name in re.findall(r"\bx_[a-z_]+\b", text):
            if name in _CTES and name not in need:
                need.add(name)
                add(_CTES[name])

    add(body)
    ctes = ",\n".join(f"{n} AS (\n{_CTES[n]}\n)" for n in _NAMES if n in need)
    return f"WITH {ctes}\n{body}" if need else body
