import re

from pyspark.sql import functions as F

from polyglint.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TEXTS = [
    None,
    "",
    "a@b.c_d@e.f.g. x.y+z@q-r.st\n.@-.-@a.b",
    "1.2.3.4.5.6.7.8 999.1.1.1 00255.0.0.000 256.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 12 5500005555555559x4111  1111",
    "+1 (555) 010-9999. +49 30 1234567890123 +12 +1-2-3-4-5-6-7-8-9-0",
    "é+1 555 010 9999 ü 10.0.0.1 déjà@vu.example.org\n\n \né 4111111111111111",
    "9" * 5000 + " " + "a" * 5000 + "@" + "." * 50,
    "1 " * 4000,
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark, sf_dir):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], "x"), (2, TEXTS[2], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit("x"))
    for table in (docs, real):
        texts = {r.doc_id: r.text for r in table.collect()}
        got = pii.personal_data(table).collect()
        assert len(got) == table.count()
        for r in got:
            assert [tuple(s) for s in r.found if s["kind"] != "term"] == brute(texts[r.doc_id] if r.doc_id is not None else TEXTS[2])
    assert pii.personal_data(docs.limit(0)).count() == 0


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"Report of zubrowka by ann@example.org, common words\nother common line {i}") for i in range(4)]
    rows += [(10 + i, "common words and a report") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.found] for r in pii.personal_data(docs).collect()}
    assert found[0] == [("term", 10, 18), ("email", 22, 37)]
    assert found[12] == []
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0].split("\n")[0] == "Report of [TERM] by [EMAIL], common words"
    assert clean[12] == "common words and a report"
