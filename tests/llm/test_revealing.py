"""Terms that reveal entities of few documents, off their line and in other documents."""

from polyglint.llm import pii

FILLER = [(100 + i, f"ordinary words of a letter, number {i}") for i in range(150)]


def marked(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    return {r.doc_id: [texts[r.doc_id][s["start"] : s["end"]] for s in r.found if s["kind"] == "term"] for r in pii.personal_data(docs).collect()}, docs


def test_entities_of_one_and_two_documents(spark):
    rows = [(1, "ordinary zubrowka ann@example.org"), (2, "ordinary kielbasa 10.1.2.3"), (3, "Kielbasa words 10.1.2.3")]
    got, _ = marked(spark, rows + FILLER)
    assert got[1] == ["zubrowka"] and got[2] == ["kielbasa"] and got[3] == ["Kielbasa"]
    assert not any(got[i] for i, _ in FILLER)


def test_a_term_of_a_class_of_entities(spark):
    """No address is repeated, but the word stands with addresses of one domain."""
    rows = [(i, f"ordinary clinic {name}@ward.example") for i, name in enumerate(["ann", "bob", "cid", "dan"])]
    rows += [(10 + i, f"ordinary words x{i}@other.example") for i in range(8)] + [(20, "The Clinic of letters")]
    got, _ = marked(spark, rows + FILLER)
    assert all(got[i] == ["clinic"] for i in range(4)) and got[20] == ["Clinic"]
    assert not any(got[i] for i in range(10, 18))


def test_terms_are_marked_off_the_line_and_in_documents_without_the_entity(spark):
    rows = [(i, "İ\U0001d11e Zubrowka wrote\nordinary zubrowka ann@example.org\nzubrowkas letter") for i in range(8)]
    rows += [(20, "a letter to ZUBROWKA, words"), (21, "zubrowka@example.org")]
    got, docs = marked(spark, rows + FILLER)
    assert all(set(got[i]) == {"Zubrowka", "zubrowka"} and len(got[i]) == 2 for i in range(8))
    assert got[20] == ["ZUBROWKA"] and got[21] == []
    clean = {r.doc_id: r.text for r in pii.sanitised(docs).collect()}
    assert clean[0] == "İ\U0001d11e [TERM] wrote\nordinary [TERM] [EMAIL]\nzubrowkas letter" and clean[20] == "a letter to [TERM], words" and clean[21] == "[EMAIL]"
