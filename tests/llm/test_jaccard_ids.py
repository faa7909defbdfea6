"""Links of a doc_id with two texts, one of which is a copy."""

from polyglint.llm import jaccard


def test_the_other_text_of_a_copied_id_keeps_its_links(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (2, a), (2, b), (3, b + " more"), (4, "alone in the table with words")]
    got = jaccard.similar_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (2, 1), (3, 1), (4, 4)]
