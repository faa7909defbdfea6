"""Ruby files are scanned in their own rows."""

from pyspark.sql import functions as F

from polyglint.operators import scan as S
from workload import relations as W

SOURCES = [
    "class A\n  def x\n    t('.a')\n  end\n  private\n  def y = t('.b')\nend\n", "module M\n\tclass B::C < D\n\t def self.z?\n\t t '.c'\n\t end\n\tend\nend",
    "class << self\n  def q; t('.d'); end\nend\nend\nendless\nprivate_class_method :x\ndefine x\n", "class E\n  def open\n    t('.e')\n", "  private def w(a) = t(\".f\")\r\n  end\r\n",
    "", "\n\nend\n", "def a = 1\ndef b(x) = x ; end\n  def c.d\n  end # x\n\n  end_of\nclass \tSpaced\nclass X;end\n", "x = 1 def hidden\n  def t(x)\n  end", "t('#{t(:in)}', scope: [:a, f(:b), [nil, \"c.#{d}\"]])",
]


def files(spark):
    return spark.createDataFrame([("p", f"app/controllers/f{i}.rb", c) for i, c in enumerate(SOURCES)], "project string, path string, content string")


def test_definitions_in_a_row_equal_those_of_lines(spark):
    lines = S._definition_lines(S.source_lines(files(spark)))
    expected = {(r["path"], r["start_line"], r["end_line"], r["what"], r["name"] if r["what"] != "private" else None) for r in lines.collect()}
    rows = S._file_definitions(files(spark)).select("path", F.explode("all").alias("d")).select("path", "d.*")
    got = [(r["path"], r["start"], r["end"], r["what"], r["name"] if r["what"] != "private" else None) for r in rows.collect()]
    assert set(got) == expected and len(got) == len(expected) > 15


def test_no_join_and_one_window(spark, sf_dir):
    """Contexts stand in the file's row; only files with a marked comment are moved, for its window."""
    plan = S.scan_ruby(W.ruby_files(spark, sf_dir), W.ROOTS)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Window [") == 1


def test_texts_are_not_made_to_look_for_needles_where_keys_are_read(spark, sf_dir):
    plan = S.scan_ruby(W.ruby_files(spark, sf_dir), W.ROOTS)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression"):].split("Union")[0]
    assert "I18n." not in below.split("Relation [")[0]


def test_marked_comments_cover_the_next_line_only_in_their_file(spark):
    marked = f"class A\n  # {S.MARKER} a.b\n  # {S.MARKER} t('c.d')\n  t(x)\n  t(y)\nend\n"
    df = spark.createDataFrame([("p", "app/a.rb", marked), ("p", "app/b.rb", "t(x)\nt(y)\n"), ("p", "app/c.rb", None), ("p", "app/d.rb", "nothing")], "project string, path string, content string")
    got = sorted((r["path"], r["line_num"], r["kind"]) for r in S.scan_ruby(df, W.ROOTS).collect())
    assert got == [("app/a.rb", 3, "key"), ("app/a.rb", 5, "opaque"), ("app/b.rb", 1, "opaque"), ("app/b.rb", 2, "opaque")]
