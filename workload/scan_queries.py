"""Scans of rendered source trees, and the text functions over order-derived texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import patterns as M
from polyglint.functions import values as V
from polyglint.operators import profile as L
from polyglint.operators import scan as S
from polyglint.operators import usage as U
from workload import relations as W
from workload.registry import query, vectors

MARK = W.MARK

# Where the call stands on each rendered line, and the text before the file's line.
_AT = "CASE line_pos WHEN 2 THEN 9 WHEN 3 THEN 5 ELSE 2 END"
_START = "coalesce(sum(strlen(line) + 1) OVER (PARTITION BY project, path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_CALLS = f"(SELECT *, {_AT} AS col, ({_START})::BIGINT AS start FROM x_template)"


@query("P1_extract_calls", f"""SELECT project, path, n AS line_num, col AS line_pos, CASE line_pos WHEN 1 THEN '''' || key || '''' WHEN 2 THEN '"' || key || '"' WHEN 3 THEN ':"' || key || '"' WHEN 4 THEN '''' || key || ''''
    WHEN 5 THEN ':name' WHEN 6 THEN '"' || key || '.#{{x}}"' ELSE ':v' END AS arg, CASE line_pos WHEN 5 THEN '''' || key || '''' WHEN 7 THEN 'obj' END AS scope FROM {_CALLS}""")
def extract_calls(spark, sf):
    return S.extract_calls(W.template_files(spark, sf)).select("project", "path", "line_num", "line_pos", "arg", "scope")


@query("P3_with_position", f"SELECT project, path, start + col AS pos, n AS line_num, col AS line_pos FROM {_CALLS}")
def with_position(spark, sf):
    return S.extract_calls(W.template_files(spark, sf)).select("project", "path", "pos", "line_num", "line_pos")


@query("P8_classify_key", f"""SELECT project, path, n AS line_num, CASE WHEN line_pos <= 3 OR line_pos = 5 THEN 'key' WHEN line_pos = 6 THEN 'pattern' ELSE 'opaque' END AS kind,
    CASE WHEN line_pos <= 3 THEN key WHEN line_pos = 5 THEN key || '.name' WHEN line_pos = 6 THEN key || '.*:' END AS key FROM {_CALLS} WHERE line_pos <> 4""")
def classify_key(spark, sf):
    return S.scan_templates(W.template_files(spark, sf), W.ROOTS).select("project", "path", "line_num", "kind", "key")


@query("J20_locate", f"SELECT project, path, start + col AS pos, n AS line_num, col AS line_pos FROM {_CALLS}")
def locate(spark, sf):
    files = W.template_files(spark, sf)
    return S.locate(S.extract_calls(files), S.line_offsets(S.source_lines(files)))


@query("W6_line_offsets", f"SELECT project, path, n AS line_num, start FROM {_CALLS}")
def line_offsets(spark, sf):
    return S.line_offsets(S.source_lines(W.template_files(spark, sf))).select("project", "path", "line_num", "start")


_PROSE = """(SELECT 'lib/docs/d' || doc_id::VARCHAR || '.txt' AS path, text AS content FROM documents UNION ALL SELECT 'app/pages/p' || page_id::VARCHAR || '.html', html FROM pages
    UNION ALL SELECT 'app/talk/c' || conv_id::VARCHAR || '_' || turn::VARCHAR || '.md', text FROM conversations)"""
_NEEDLE = "(contains(content, 't(') OR contains(content, 't ') OR contains(content, 't!') OR contains(content, 'translate') OR contains(content, 'I18n.') OR regexp_matches(content, 'i18n-[a-z]+-use'))"


@query("S3_needle_prefilter", f"SELECT path, CASE WHEN {_NEEDLE} THEN 'scanned' ELSE 'prefiltered' END AS verdict FROM {_PROSE}")
def needle_prefilter(spark, sf):
    return S.needle_prefilter(W.prose_files(spark, sf)).select("path", "verdict")


@query("A4_scan_counts", f"SELECT 'low' AS project, count(*) FILTER ({_NEEDLE}) AS files_scanned, count(*) FILTER (NOT {_NEEDLE}) AS files_prefiltered FROM {_PROSE}")
def scan_counts(spark, sf):
    return U.scan_counts(S.needle_prefilter(W.prose_files(spark, sf)))


@query("R16_relative_key_roots", """SELECT DISTINCT project, 'app/controllers' AS root, 'false' AS detected FROM x_key UNION ALL SELECT DISTINCT 'high', 'app/views', 'false' FROM part
    UNION ALL SELECT DISTINCT project, 'app/w' || (id % 7)::VARCHAR, 'true' FROM x_key""")
def relative_key_roots(spark, sf):
    """Relative calls in the rendered tree, in the same controllers moved to odd places, and prose."""
    ruby = W.ruby_files(spark, sf)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    moved = ruby.withColumn("path", W.text("app/w", (number % 7).cast("string"), "/o", number.cast("string"), ".rb"))
    tree = W.tag_files(spark, sf).unionByName(ruby).unionByName(moved).unionByName(W.prose_files(spark, sf))
    return L.relative_key_roots(tree).select("project", "root", F.col("detected").cast("string").alias("detected"))


@query("P13_magic_comments", """SELECT 'app/views/parts/b' || p_size::VARCHAR || '/_p' || p_partkey::VARCHAR || '.html.erb' AS path, n AS line_num, 'part.' || w || p_partkey::VARCHAR AS key
    FROM part JOIN (VALUES ('note', 2), ('next', 6)) AS v(w, n) ON true""")
def magic_comments(spark, sf):
    return S.magic_comments(W.tag_files(spark, sf), W.ROOTS).select("path", "line_num", "key")


@query("P11_extract_template_tags", """SELECT 'app/views/parts/b' || p_size::VARCHAR || '/_p' || p_partkey::VARCHAR || '.html.erb' AS path, n AS line_num, k AS kind,
    replace(replace(replace(w, '{k}', p_partkey::VARCHAR), '{b}', 'parts.b' || p_size::VARCHAR || '.p' || p_partkey::VARCHAR), '{n}', p_name) AS key
    FROM part JOIN (VALUES (1, 'key', '{b}.title'), (2, 'key', 'part.note{k}'), (4, 'key', 'part.{n}'), (5, 'pattern', 'part.*:.k{k}'), (5, 'opaque', NULL), (6, 'key', 'part.next{k}')) AS v(n, k, w) ON true""")
def extract_template_tags(spark, sf):
    return S.scan_code_tags(W.tag_files(spark, sf), W.ROOTS).select("path", "line_num", "kind", "key")


@query("W7_comment_covers_next", """SELECT 'app/views/parts/b' || p_size::VARCHAR || '/_p' || p_partkey::VARCHAR || '.html.erb' AS path, 5 AS line_num FROM part""")
def comment_covers_next(spark, sf):
    return S.scan_code_tags(W.tag_files(spark, sf), W.ROOTS).where("kind = 'opaque'").select("path", "line_num")


@query("P10_relative_key", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'plain.key' WHEN 1 THEN 'parts.b' || p_size::VARCHAR || '.p' || p_partkey::VARCHAR || '.title' END AS absolute FROM part")
def relative_key(spark, sf):
    n = F.col("p_partkey") % 3
    below = W.text("parts/b", W.s("p_size"), "/_p", W.s("p_partkey"), ".html.slim")
    path = F.when(n == 2, W.text("lib/", below)).otherwise(W.text("app/views/", below))
    rows = W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), path.alias("path"), F.when(n == 0, "plain.key").otherwise(".title").alias("key"))
    return S.relative_key(rows, W.ROOTS).select("id", "absolute")


_RB = "'app/controllers/admin/o' || id::VARCHAR || '_controller.rb' AS path"


@query("P16_full_key", f"""SELECT project, {_RB}, n AS line_num, v.kind, replace(w, '{{k}}', id::VARCHAR) AS key, replace(c, '{{k}}', id::VARCHAR) AS candidates FROM x_key JOIN (VALUES
    (4, 'key', 'shop.admin.o{{k}}.index.label', 'shop.admin.o{{k}}.index.label shop.admin.o{{k}}.label shop.admin.label shop.label'), (6, 'key', 'abs.k{{k}}', 'abs.k{{k}}'),
    (10, 'key', 'shop.admin.o{{k}}.show.short', 'shop.admin.o{{k}}.show.short shop.admin.o{{k}}.short shop.admin.short shop.short'),
    (16, 'pattern', 'dyn.*:.k{{k}}', 'dyn.*:.k{{k}}'), (17, 'pattern', 'shop.*.m', 'shop.*.m'), (18, 'opaque', NULL, '')) AS v(n, kind, w, c) ON true""")
def full_key(spark, sf):
    found = S.scan_ruby(W.ruby_files(spark, sf), W.ROOTS)
    return found.select("project", "path", "line_num", "kind", "key", F.array_join("candidate_keys", " ").alias("candidates"))


@query("P21_skips_method_name", f"SELECT project, {_RB}, 'shop.admin.o' || id::VARCHAR || '.' || w AS key FROM x_key JOIN (VALUES ('label'), ('short')) AS v(w) ON true")
def skips_method_name(spark, sf):
    found = S.scan_ruby(W.ruby_files(spark, sf), W.ROOTS, ["app/controllers"]).where("kind = 'key' and key not like 'abs.%'")
    return found.select("project", "path", "key")


@query("W5_definition_ranges", f"SELECT project, {_RB}, a AS start_line, b AS end_line, w AS what, replace(n, '{{k}}', id::VARCHAR) AS name FROM x_key JOIN (VALUES (1, 21, 'module', 'Shop'), (2, 20, 'class', 'Admin::O{{k}}Controller'), (3, 8, 'def', 'index'), (10, 10, 'def', 'show'), (14, 19, 'def', 'helper')) AS v(a, b, w, n) ON true")
def definition_ranges(spark, sf):
    return S.definition_ranges(S.source_lines(W.ruby_files(spark, sf))).select("project", "path", "start_line", "end_line", "what", "name")


@query("J19_innermost_scope", f"SELECT project, {_RB}, l AS line_num, w AS name FROM x_key JOIN (VALUES (4, 'index'), (6, 'index'), (10, 'show'), (15, 'helper'), (16, 'helper'), (17, 'helper'), (18, 'helper')) AS v(l, w) ON true")
def innermost_scope(spark, sf):
    files = W.ruby_files(spark, sf)
    points = S.extract_calls(files).select("project", "path", "line_num")
    return S.innermost_scope(points, S.definition_ranges(S.source_lines(files))).select("project", "path", "line_num", "name")


def _line_calls(text):
    """Number of calls on a line, by the extraction's own expression."""
    return F.size(F.regexp_extract_all(text, F.lit(S._T_CALL), F.lit(0)))


def _staged(name, expression, table, sources):
    """Vectors for operators that take a relation: ``sources`` turns the text into columns."""
    vectors(name, lambda t: t, table)
    from workload.registry import QUERIES

    base = QUERIES[name]
    QUERIES[name] = lambda spark, sf: expression(sources(base(spark, sf).drop("result"))).select("id", "text", "result")


vectors("P2_call_guard", _line_calls, [
    ("= t('a{id}')", "1"), ("theme_t 'a{id}'", "0"), ("x't :a{id}", "0"), ("x-t :a{id}", "0"), ("Shop.t 'a{id}'", "0"), ("I18n.t 'a{id}'", "1"), ("é t('a{id}') #{t :b}", "2"), ("bientôt 'a{id}'", "0"),
])
vectors("P5_line_kind", lambda t: S.line_kind(F.substring_index(t, "|", 1), F.when(F.substring_index(t, "|", 1) == "rb", "ruby").otherwise("template"), F.regexp_replace(t, r"(?s)\A[^|]*\|", "")), [
    ("slim|/ note {id} ", "comment"), (f"slim|/ {MARK} {{id}} ", "magic"), ("slim|p {id} ", "code"), ("js| // {id} ", "comment"), ("ts|// {id} ", "code"), ("haml|- # {id} ", "comment"),
    (f"haml|-# {MARK} {{id}}", "magic"), ("coffee|# {id}", "comment"), ("rb|# {id} ", "comment"), (f"rb|  # {MARK} {{id}} ", "magic"), ('rb|x = "#{{id}" + ', "code"), ("rb|x = {id} # ", "comment"),
])
vectors("P6_strip_literal", S.strip_literal, [
    ("'a{id}'", "a{id}"), (':"a.{id}"', "a.{id}"), (":a{id}", "a{id}"), ("key{id}", "#{key{id}}"), ("@x{id}.y", "#{@x{id}.y}"), ('"a{id}', '"a{id}'),
])
_staged("P7_resolve_scope", lambda df: S.resolve_scope(df).withColumnRenamed("prefix", "result"), [
    ("'a{id}'", "a{id}"), ("[:a{id}, :b]", "a{id}.b"), ("%i[a{id} b]", "a{id}.b"), ("%I[a{id} #{x}]", None), ("nil", ""), ("[]", ""), ("[:a{id}, v]", "a{id}.*"), ("[:a{id}, nil]", "a{id}"), ("[:a{id}, f(1", None), (" ", None), ("[:a{id}, [:b]]", None), ("v{id}", "*"),
], lambda df: df.withColumn("scope", F.col("text")))
vectors("P9_valid_key", S.valid_key, [
    ("a.b{id}", "true"), ("key with {id}", "true"), ("a .{id}", "false"), ("", "false"), ("a?b!c-{id}/d", "true"), ("привет мир {id}", "true"), ("a(b){id}", "false"), ("#{x}.{id}[y]@z", "true"), (" {id}", "false"), ("a%{id}", "false"),
])
vectors("P12_receiver_filter", _line_calls, [
    ("Foo{id}.t('x')", "0"), ("foo.translate('x{id}')", "0"), ("::I18n.t('x{id}')", "1"), ("I18n.translate!('x{id}')", "1"), ("a&.t('x{id}')", "0"),
])
_staged("P14_reduce_argument", lambda df: S.reduce_argument(df).withColumn("result", F.concat_ws(" ", "arg_kind", "arg_text")), [
    ("'a.{id}'", "key a.{id}"), ('"a" ".b{id}"', "key a.b{id}"), ('"a{id}" \\\n  ".b"', "key a{id}.b"), (':"a.#{x}.{id}"', "pattern a.*:.{id}"), ("var{id}", "opaque var{id}"), ("CONST_{id}", "opaque CONST_{id}"), ("@x{id}", "opaque @x{id}"), (":sym{id}", "key sym{id}"), ("1{id}", "1{id}"),
], lambda df: df.withColumn("arg", F.col("text")))
vectors("P15_keyword_scope", S.keyword_scope, [
    ("[:a{id}, [:b, nil]]", "a{id}.b"), ("'a{id}'", "a{id}"), ("[:a{id}, CONST]", "a{id}.*"), ('"a.#{x}.{id}"', "a.*:.{id}"), ("CONST{id}", None), ("[v{id}]", None), ("5", None), ("{a: {id}}", None), ("nil", ""), ("%w[a b{id}]", "a.b{id}"), ("", None),
])
vectors("F1_split_key", lambda t: F.array_join(K.split_key(t), "|"), [
    ("a.b{id}", "a|b{id}"), ("a.#{b.c{id}}.d", "a|#{b.c{id}}|d"), ("a.{id}.", "a|{id}"), ("a.(b.{id}).[c.d].<e.f>", "a|(b.{id})|[c.d]|<e.f>"), ("a.b.<e.{id}", "a|b|<e|{id}"), ("", ""), ("a..{id}", "a||{id}"), ("a.<b.{c.{id}}", "a|<b|{c|{id}}"),
])
vectors("F5_underscore", K.underscore, [
    ("HTTPServer{id}", "http_server{id}"), ("Admin::V2::JobsController{id}", "admin/v2/jobs_controller{id}"), ("already_{id}", "already_{id}"), ("Foo-Bar{id}", "foo_bar{id}"), ("APIv2Thing{id}", "ap_iv2_thing{id}"), ("ABCDef{id}", "abc_def{id}"), ("V{id}", "v{id}"), ("User{id}Thing", "user{id}_thing"),
])
vectors("F6_join_key", lambda t: K.join_key(F.split(t, r"\|")), [
    ("a|b{id}", "a.b{id}"), ("a||b{id}", "a.b{id}"), ("a.|b{id}", "a.b{id}"), ("|{id}", "{id}"), ("a..|b{id}", "a..b{id}"),
])
vectors("F7_pattern_to_regex", lambda t: M.pattern_match(F.substring_index(t, " ", -1), F.substring_index(t, " ", 1)), [
    ("a.*.e* a.b.{id}.eeee", "true"), ("a.b.: a.b.{id}", "true"), ("a.b.: a.b.{id}.d", "false"), (":.b.c {id}.b.c", "true"), (":.b.c x.{id}.b.c", "false"), ("a.pre-*:-post.c a.pre-{id}-post.c", "true"), ("a.pre-*:-post.c a.pre-{id}.-post.c", "false"),
    ("a.{x,y}.* a.y.{id}", "true"), ("a.{x,y}.* a.z.{id}", "false"), ("{:}.c {id}.c", "true"), ("a{b a{b", "true"), (":x {id}x", "false"), ("a+b.* a+b.{id}", "true"), ("*.a.*.b x.a.{id}.b", "true"), ("*.a.*.b x.{id}.b", "false"),
])
vectors("F11_typed_scalar", V.typed_scalar, [
    ("{id}", "number"), ("-1{id}.5", "number"), ("0x1{id}", "number"), ("1{id}:30", "number"), ("~", "null"), ("Yes", "bool"), ("a{id}", "str"), ("2020-01-1", "timestamp"), ("y", "str"), (".inf", "number"), ("1,{id}", "number"), ("1{id}e", "str"), ("5_{id}", "number"), ("", "null"),
])
vectors("F12_number_value", V.number_value, [
    ("1{id}", "1{id}"), ("-1{id}", "-1{id}"), ("+1_{id}", "1{id}"), ("1{id}.", "1{id}.0"), ("1{id}.5", "1{id}.5"), ("0x1f", "31"), ("0b101", "5"), ("1:30:15", "5415"), ("a{id}", None), ("2020-01-01", None), ("2,5", "25"), ("017", "15"),
])
vectors("F13_quote_scalar", V.quote_scalar, [
    ("text {id}", "text {id}"), ("a: {id}", "'a: {id}'"), ("{id}", "'{id}'"), ("%{n} {id}", '"%{n} {id}"'), ("it's: {id}", "'it''s: {id}'"), ("tab\t{id}", '"tab\\t{id}"'), ("", "''"), ("yes", "'yes'"), ("a{id} ", "'a{id} '"), ("a #{id}", "'a #{id}'"), ('-"{id}', "'-\"{id}'"), ("é{id}", "é{id}"),
])
vectors("F14_block_scalar", lambda t: V.scalar_text(F.lit("str"), t, F.lit(1)), [
    ("a\nb{id}", "|-\n    a\n    b{id}"), ("a{id}\n\nb\n", "|\n    a{id}\n\n    b"), ("a{id}\n\n", "|+\n    a{id}\n"), ("\na{id}", '"\\na{id}"'), ("a \n{id}", '"a \\n{id}"'), ("a{id}", "a{id}"),
])
vectors("F15_interpolation_to_pattern", S.interpolation_to_pattern, [
    ("a.#{x{id}}.b", "a.*:.b"), ("a.#{h[:k]}#{y}.{id}", "a.*:*:.{id}"), ("a.#{h{k}}.{id}", "a.*:.{id}"), ("plain{id}", "plain{id}"), ("a.#{h{k{m}}}.{id}", "a.*:.{id}"),
])
vectors("F24_display_value", lambda t: V.display_value(F.substring_index(t, "|", 1), F.regexp_replace(t, r"(?s)\A[^|]*\|", "")), [
    ('seq|["a",{id},null]', '["a", {id}, nil]'), ('seq|[{"k":"v, {id}"},true]', '[{"k" => "v, {id}"}, true]'), ("str|x{id}", "x{id}"), ("nil|", ""), ("plain|{id}", "{id}"),
])
vectors("F25_json_value", lambda t: V.json_value(F.substring_index(t, "|", 1), F.regexp_replace(t, r"(?s)\A[^|]*\|", "")), [
    ('str|say "{id}"', '"say \\"{id}\\""'), ("plain|1{id}", "1{id}"), ("plain|:day{id}", '"day{id}"'), ("plain|2020-01-01", '"2020-01-01"'), ("nil|", "null"), ("bool|true", "true"), ('seq|[{id}]', "[{id}]"),
])
