"""Call extraction on small texts: keys, patterns and opaque calls per line form."""

import pytest
from pyspark.sql import functions as F

from polyglint.operators import scan as S

ROOTS = ["app/views", "app/controllers", "app/components"]
MARK = S.MARKER


def run(spark, sources):
    """sources: list of (path, content); one scan for all of them."""
    df = spark.createDataFrame([("p", p, c) for p, c in sources], "project string, path string, content string")
    out = {p: {"key": [], "pattern": [], "opaque": 0, "lines": {}} for p, _ in sources}
    for r in S.scan(df, ROOTS).orderBy("path", "pos").collect():
        o = out[r["path"]]
        if r["kind"] == "opaque":
            o["opaque"] += 1
        else:
            o[r["kind"]].append(r["key"])
            o["lines"].setdefault(r["key"], []).append((r["line_num"], r["line_pos"]))
    return out


def cases(spark, ext, table):
    """table: (source, keys, patterns, opaque)."""
    sources = [(f"app/views/x/case{i}.{ext}", src) for i, (src, *_rest) in enumerate(table)]
    got = run(spark, sources)
    wrong = []
    for (path, src), (_, keys, patterns, opaque) in zip(sources, table):
        g = got[path]
        if (sorted(g["key"]), sorted(g["pattern"]), g["opaque"]) != (sorted(keys), sorted(patterns), opaque):
            wrong.append((src, g, keys, patterns, opaque))
    assert not wrong


def test_template_calls(spark):
    """Every call shape with every kind of scope; then the corner cases."""
    keys = ["cart.total", "nav_bar", "menü.größe", "two words", "a-b?!.c"]
    shapes = ['= t "{k}"{s}', "p t('{k}'{s})", "= t(:\"{k}\"{s})", "| #{{I18n.t('{k}'{s})}}", "= I18n.translate(\n  '{k}'{s})"]
    scopes = [
        ("", ""), (", scope: :shop", "shop."), (", :scope => 'shop.list'", "shop.list."), (", scope: [:shop, \"list\"]", "shop.list."),
        (", scope: %w(shop list)", "shop.list."), (", scope: %i[shop list]", "shop.list."), (", scope: nil", ""), (", scope: []", ""),
    ]
    table = [(shape.format(k=k, s=s), [prefix + k], [], 0) for shape in shapes for k in keys for s, prefix in scopes]
    table += [(shape.format(k=k, s=", scope: [:shop, kind]"), [], [f"shop.*.{k}"], 0) for shape in shapes for k in keys]
    table += [(shape.format(k="nav_bar", s=s), [], [], 1) for shape in shapes for s in (", scope: place", ", scope: [place]", ", scope: [:shop, at(1)]")]
    table += [(f'= t "cart.#{{{x}}}.sum"{s}', [], [f"{prefix}cart.*:.sum"], 0) for x in ("x", "h[:k]", "h{k}") for s, prefix in scopes]
    # corner cases: no calls, empty and blank keys, an end dot, a scope for a variable key, nested calls, marked comments
    table += [(text, [], [], 0) for text in ("theme_t 'x.y'", "Shop.t 'x.y'", "| it't :quote", "= t key", "t('')", "t(' x')", "t('x .y')", "/ t(:dead)", "-# t(:dead)")]
    table += [
        ("= t 'cart.'", ["cart.:"], ["cart.*:"], 0), ("= t kind, scope: :shop", [], ["shop.*:"], 0), ("= t :outer, scope: :a, x: t(:inner, scope: :b)", ["a.outer", "b.inner"], [], 0),
        (f"/ {MARK} t(:live)", ["live"], [], 0), (f"-# {MARK} t(:kept)", ["kept"], [], 0), (f"/ {MARK} t(:name, scope: any)", [], [], 0),
    ]
    table.append(("t('.line')", [f"x.case{len(table)}.line"], [], 0))
    cases(spark, "html.slim", table)


def test_comment_rules_follow_the_extension(spark):
    got = run(spark, [("a.js", "// t('x.a')"), ("b.js", f"// {MARK} t('x.a')"), ("a.coffee", "# t('x.a')"), ("a.haml", "- # t('x.a')"),
                      ("b.haml", f"-# {MARK} t('x.a')"), ("a.ts", "// t('x.a')")])
    assert {p: bool(g["key"]) for p, g in got.items()} == {"a.js": False, "b.js": True, "a.coffee": False, "a.haml": False, "b.haml": True, "a.ts": True}


def test_positions_count_lines_and_bytes(spark):
    got = run(spark, [("app/views/a.slim", "ä\né = I18n.t 'a.b'; t('c')\n\n= t( \\\n  'd')\n= t('e')\n")])["app/views/a.slim"]
    assert got["lines"] == {"a.b": [(2, 10)], "c": [(2, 19)], "d": [(4, 2)], "e": [(6, 2)]}


def test_template_tags(spark):
    src = "\n".join([
        "<b><%= t('a') %></b><% what = t 'a' %>", 'I18n.t("outside")', f"<% # {MARK} t('c.one') %>", f"<%# {MARK} t('c.two')",
        f"{MARK} t('c.three') %>", "<%# t('dead') %>", "<%#", "  t('dead.too')", "%>", '<%= t("dyn.#{x}") %>', "<%% t('literal') %>",
        "<%= t(v) %>", "<%= t 'w', scope: 'a.b', default: t('.nested') %>", "<%= x do %>", " <% c.title { t('in.block') } %>", "<% end %>", "<%= t('.title') %>", "é <%= theme_t 'no' %> <%= t('after') %>",
    ])
    got = run(spark, [("app/views/things/_event.html.erb", src)])["app/views/things/_event.html.erb"]
    assert sorted(got["key"]) == ["a", "a", "a.b.w", "after", "c.one", "c.three", "c.two", "in.block", "things.event.nested", "things.event.title"]
    assert got["pattern"] == ["dyn.*:"] and got["opaque"] == 1
    assert [n for n, _ in got["lines"]["a"]] == [1, 1] and got["lines"]["c.three"][0][0] == 5 and got["lines"]["after"] == [(18, 27)]


def test_ruby_arguments(spark):
    table = [
        ("t('a')\nt!('b')\ntranslate('c')\ntranslate!('d')\nI18n.t('e')\n::I18n.t('f')\n", list("abcdef"), [], 0),
        ("t('a', scope: [:x, :y])\nt('b', scope: 'x.y')\nt('c', scope: :x)\n", ["x.y.a", "x.y.b", "x.c"], [], 0),
        *[(s, [w], [], 0) for s, w in (("t('a', scope: nil)", "a"), ("t('a', scope: [])", "a"), ("t('a', scope: [nil])", "a"), ("t('a', scope: [:x, nil])", "x.a"), ("t('a', scope: [nil, :x, []])", "x.a"))],
        *[(f't("{pre}#{{{inner}}}{post}")\n', [], [f"{pre}*:{post}"], 0) for pre in ("shelf.", "row_") for inner in ("n", "@n[0]", "n.size") for post in ("", ".label")],
        ('t(:"shelf.#{n}")\nt("#{n}")\n', [], ["shelf.*:"], 1),
        *[(f"t({v})\nt(:read)\n", ["read"], [], 1) for v in ("shelf", "@shelf", "SHELF", "Shelf::NAME", "shelf.name", "$shelf")],
        ("t('category.')\n", ["category."], ["category.*:"], 0),
        ('t("adj.split" \\\n  ".key")\nI18n.t("adj" ".three" ".parts")\nt(:leaf, scope: "adj" ".scope")', ["adj.split.key", "adj.three.parts", "adj.scope.leaf"], [], 0),
        ('t("adj.#{s}" \\\n ".rest")', [], ["adj.*:.rest"], 0),
        ("t(:title, scope: [:products, category])\nt(:name, scope: \"products.#{category}\")\nt('a.', scope: [:x, category])\n", [], ["products.*.title", "products.*:.name", "x.*.a.*:"], 0),
        ("t(:c, scope: CONST)\nt(:m, scope: method_call)\nt(:v, scope: [category])\nt(:s, scope:)\n", [], [], 4),
        *[(f"{receiver}{dot}{name}(:gone)\n", [], [], 0) for receiver in ("Library", "shelf", "self.class", "Library::I18n") for dot in (".", "&.") for name in ("t", "translate!")],
        ("def translate(key)\nend\ndef self.t(key)\nend\n", [], [], 0),
        ("# t('dead')\nx = 1 # t('dead')\ny = \"#{t('live')}\" # no\n", ["live"], [], 0),
        (f"# {MARK} t('one') t('two')\nt(dynamic)\nt(other)\n", ["one", "two"], [], 1),
        ("t(5)\nt([1])\nt({a: 1})\n", [], [], 0),
    ]
    sources = [(f"app/models/m{i}.rb", t[0]) for i, t in enumerate(table)]
    got = run(spark, sources)
    wrong = [(t, got[p]) for (p, _), t in zip(sources, table) if (sorted(got[p]["key"]), sorted(got[p]["pattern"]), got[p]["opaque"]) != (sorted(t[1]), sorted(t[2]), t[3])]
    assert not wrong


def test_ruby_context(spark):
    controller = """
module Shop
  class Admin::OrdersController < Base
    class Empty
    end

    def index
      x = {label: t(".label")}
      if x
        t("abs.key")
      end
    end

    def self.build = t('.short')

    private

    def helper
      t('.hidden')
      t('abs.hidden')
    end
  end
end
"""
    mailer = "class UserMailer\n  def welcome\n    t('.subject')\n  end\nend\n"
    model = "class Thing\n  def label\n    t('.dropped')\n  end\nend\n"
    late = f"class UsersController\n  def create\n    render\n    # {MARK} t('.late')\n  end\nend\n"
    got = run(spark, [("lib/orders_controller.rb", controller), ("lib/user_mailer.rb", mailer), ("lib/thing.rb", model), ("app/controllers/users_controller.rb", late)])
    assert sorted(got["lib/orders_controller.rb"]["key"]) == ["abs.hidden", "abs.key", "shop.admin.orders.build.short", "shop.admin.orders.index.label"]
    assert got["lib/user_mailer.rb"]["key"] == ["user_mailer.welcome.subject"]
    assert got["lib/thing.rb"]["key"] == []
    assert got["app/controllers/users_controller.rb"]["key"] == ["users.create.late"]


def test_candidates_of_a_controller_key(spark):
    df = spark.createDataFrame([("p", "lib/a_controller.rb", "class Admin::AController\n  def show\n    t('.k')\n  end\nend\n")], "project string, path string, content string")
    row = S.scan_ruby(df, ROOTS).collect()[0]
    assert row["candidate_keys"] == ["admin.a.show.k", "admin.a.k", "admin.k"]
    skipped = S.scan_ruby(df.replace("lib/a_controller.rb", "app/controllers/a_controller.rb"), ROOTS, ["app/controllers/"]).collect()[0]
    assert skipped["key"] == "admin.a.k"


@pytest.mark.parametrize("pos,want", [(0, (1, 0)), (4, (2, 0)), (9, (3, 1)), (3, (1, 3))])
def test_locate(spark, pos, want):
    files = spark.createDataFrame([("p", "a", "one\ntwo\nthree")], "project string, path string, content string")
    starts = S.line_offsets(S.source_lines(files))
    points = spark.createDataFrame([("p", "a", pos)], "project string, path string, pos int")
    r = S.locate(points, starts).first()
    assert (r["line_num"], r["line_pos"]) == want


def test_streaming_scan_equals_batch(spark, tmp_path):
    from polyglint.streaming.scans import stream_files, stream_occurrences

    data = [(f"app/views/s{i}.slim", f"= t('k{i}')\n= t(\"d.#{{x}}.k{i}\")\n") for i in range(20)]
    spark.createDataFrame(data, "path string, content string").write.parquet(str(tmp_path / "in"))
    q = stream_occurrences(stream_files(spark, str(tmp_path / "in"), "p"), ROOTS).writeStream.format("memory").queryName("scan_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from scan_out where kind = 'key'").first()[0] == 20
    assert spark.sql("select count(*) from scan_out where kind = 'pattern'").first()[0] == 20


def test_ruby_scope_anywhere_and_any_depth(spark):
    nested = "[:b, " * 12 + ":c" + "]" * 12
    deep = "#{" + "{" * 9 + "x" + "}" * 10
    calls = [
        ("t('key', count: 1, scope: :x)", "x.key"),
        ("t('key', default: 'd, scope: :no', scope: [:a, :b])", "a.b.key"),
        ("t('key', count: n(scope: :inner, at: [1, 2]), :scope => 'out')", "out.key"),
        (f"t(:a, scope: {nested})", "b." * 12 + "c.a"),
        ("t 'k', scope: :x if scope?", "x.k"),
        ("t(\n  'multi',\n  count: 2,\n  scope: [\n    :p,\n    :q\n  ]\n)", "p.q.multi"),
        ("t('key') + f(scope: :other)", "key"),
        ("t('single.#{x}.k')", "single.#{x}.k"),
        (f't("a.{deep}.z")', "a.*:.z"),
    ]
    files = [(f"lib/f{i}.rb", text + "\n") for i, (text, _) in enumerate(calls)] + [("lib/block.rb", "=begin\nt('dead')\n=end\nt('live')\n")]
    rows = S.scan(spark.createDataFrame([("p", p, c) for p, c in files], "project string, path string, content string"), ROOTS).collect()
    got = {r.path: r.key for r in rows}
    assert got == {f"lib/f{i}.rb": key for i, (_, key) in enumerate(calls)} | {"lib/block.rb": "live"}
    template = spark.createDataFrame([("p", "a.slim", f'= t("k.{deep}.z")\n')], "project string, path string, content string")
    assert [(r.kind, r.key) for r in S.scan(template, ROOTS).collect()] == [("pattern", "k.*:.z")]


def test_lists_of_any_shape(spark):
    """Scopes made of strings with commas, calls with arguments, indexing, comments and nested arrays, to any depth."""
    import random

    rng = random.Random(2)
    atoms = [(":b", "b"), ("'c,d'", "c,d"), ("foo(:c, [:d, 1])", "*"), ("names[:a, 0]", "*"), ("nil", ""), ('"e.#{x}"', "e.*:"), ("x.map { |y, z| y }", "*"), ("Shop::KIND", "*"), ("[]", "")]

    def listed(depth: int) -> tuple[str, list[str]]:
        if depth == 0 or rng.random() < 0.3:
            text, part = rng.choice(atoms)
            return text, [part] if part else []
        items = [listed(depth - 1) for _ in range(rng.randrange(1, 4))]
        gap = rng.choice([", ", ",", ",\n  ", ", # with: a note, [and more\n  "])
        return "[" + gap.join(t for t, _ in items) + "]", [p for _, parts in items for p in parts]

    cases = [listed(6) for _ in range(150)]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "i int, scope string").repartition(4)
    got = {r.i: r.prefix for r in rows.select("i", S.keyword_scope(F.col("scope")).alias("prefix")).collect()}
    wrong = []
    for i, (text, parts) in enumerate(cases):
        want = ".".join(parts)
        want = None if parts and set(want) <= set(".*:") else want
        if got[i] != want:
            wrong.append((text, got[i], want))
    assert not wrong


def test_calls_inside_interpolations(spark):
    deep = "\"o.#{t(\"m.#{t('i')}\")}\""
    calls = [
        ("t(\"a.#{t('inner')}.b\")", ["inner"], ["a.*:.b"]),
        (f"t({deep})", ["i"], ["o.*:", "m.*:"]),
        ("t(\"a.#{h.map { |x| t('k', scope: :s) }}.#{t 'z'}\")", ["s.k", "z"], ["a.*:.*:"]),
        ("t(\"t('no').#{x}\")", [], ["t('no').*:"]),
        ("t('v', # note, scope: :zz\n  scope: :w)", ["w.v"], []),
        ("t(:q, scope: \"a,b\")", ["a,b.q"], []),
        ("t(:a, scope: [:b, foo(:c, :d)])", [], ["b.*.a"]),
    ]
    files = [(f"lib/f{i}.rb", f"# first\n  {text}\n") for i, (text, _, _) in enumerate(calls)]
    got = run(spark, files)
    for (path, _), (text, keys, patterns) in zip(files, calls, strict=True):
        assert (sorted(got[path]["key"]), sorted(got[path]["pattern"])) == (sorted(keys), sorted(patterns)), text
    assert got["lib/f0.rb"]["lines"] == {"inner": [(2, 9)], "a.*:.b": [(2, 2)]}


def test_many_calls_in_a_file_cost_their_number(spark):
    import time

    took = {}
    for n in (2000, 8000):
        files = spark.createDataFrame([("p", "lib/big.rb", "".join(f"t('k{i}')\n" for i in range(n)))], "project string, path string, content string")
        begin = time.perf_counter()
        assert S.scan_ruby(files, ROOTS).where("kind = 'key'").count() == n
        took[n] = time.perf_counter() - begin
    assert took[8000] < 8 * took[2000] + 5
