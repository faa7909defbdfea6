"""Lines that repeat alone."""

import random

import pytest

import corpus_pipeline
from polyglint.llm import lineruns


@pytest.mark.parametrize("min_lines", [1, 2, 3])
def test_lone_lines_and_runs_equal_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    lines = ["a", "b", "one two three four", "one two three four five", " six  seven eight nine\tten eleven "]
    texts = ["\n".join(rng.choice(lines) + rng.choice(["", "", " x y"]) for _ in range(rng.randint(1, 9))) for _ in range(40)]
    seen, want = set(), {}
    for i, text in enumerate(texts):
        own, gone = text.split("\n"), set()
        for size in {1, min_lines}:
            for p in range(len(own) - size + 1):
                run = tuple(own[p : p + size])
                if size == min_lines or len(run[0].split()) >= 5:
                    gone |= set(range(p, p + size)) if (size, run) in seen else set()
                    seen.add((size, run))
        want[i] = "\n".join(x for p, x in enumerate(own) if p not in gone)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = lineruns.without_repeated_runs(docs, min_lines=min_lines, lone_words=5)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_pipeline_stage_takes_later_copies_of_single_lines(spark):
    rows = [(1, "own\none line of five words"), (2, "one line of five words\nother"), (3, "one line of five words"), (4, "own")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_line_runs(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == [(1, rows[0][1], 26), (2, "other", 5), (3, "", 0), (4, "own", 3)]
