"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from polyglint.llm import decontamination, exact, jaccard, lineruns, mixing, pii, quality, substring, toxicity, warc

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, key string, row long, pos int, name int, _row int, epoch int, quality string, toxicity string, target int, lines_removed int, n int, size int"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma\nsecond line here\nthird line here", "s1"),
    (1, "alpha beta gamma\nsecond line here\nthird line here", "s1"),
    (2, None, None),
    (3, "", "s1"),
    (None, "alpha beta gamma\nsecond line here\nthird line here", "s2"),
    (4, LONG, "s2"),
    (5, LONG + " end", "s2"),
    (6, " \t\n ", None),
    (7, "second line here\nthird line here\nown line", "s1"),
    (1, "another text under one id", "s1"),
]


@pytest.fixture(scope="module")
def docs(spark):
    filler = ("k", 1, 2, 3, 4, 5, "q", "t", 6, 7, 8, 9)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *filler) for i, t, s in ROWS], CLASHING)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (3, None, 1), (7, 0, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")


def by(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_exact(docs):
    got = by(exact.exact_duplicates(docs, block_bytes=16), "doc_id", "keep_id", "group_size", "kept")
    assert len(got) == len(ROWS)
    same = [r for r in got if r[1] == 1 and r[2] == 3]
    assert sorted(map(repr, (r[3] for r in same))) == ["False", "False", "True"] and (None, 1, 3, False) in got
    assert (3, 2, 2, False) in got and (6, 6, 1, True) in got
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_substring(docs):
    got = by(substring.repeated_passages(docs, min_words=5), "doc_id", "n_words", "n_removed")
    assert len(got) == len(ROWS)
    assert (4, 60_000, 60_000 - 977 * 13, ) not in got  # repeats inside one document stay
    assert (4, 60_000, 0) in got and (5, 60_001, 60_000) in got
    assert (7, 8, 6) in got and (None, 9, 0) in got and got.count((1, 9, 0)) == 2 and (2, 0, 0) in got
    assert substring.repeated_passages(docs.limit(0)).count() == 0


def test_line_runs(docs):
    got = lineruns.without_repeated_runs(docs)
    assert got.columns == [c for c in docs.columns if c != "lines_removed"] + ["lines_before", "lines_removed"]
    rows = by(got, "doc_id", "text", "lines_removed", "_row")
    assert (7, "own line", 2, 4) in rows and (2, None, 0, 4) in rows and len(rows) == len(ROWS)
    assert rows.count((1, ROWS[0][1], 0, 4)) == 2 and (None, ROWS[0][1], 0, 4) in rows
    assert lineruns.without_repeated_runs(docs.limit(0)).count() == 0


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_runs_equal_brute_force(spark, min_lines):
    import random

    rng = random.Random(min_lines)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(30)]
    seen, want = set(), {}
    for i, text in enumerate(texts):
        lines, gone = text.split("\n"), set()
        for p in range(len(lines) - min_lines + 1):
            run = tuple(lines[p : p + min_lines])
            gone |= set(range(p, p + min_lines)) if run in seen else set()
            seen.add(run)
        want[i] = "\n".join(x for p, x in enumerate(lines) if p not in gone)
    got = lineruns.without_repeated_runs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_lines=min_lines)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_jaccard(docs):
    got = by(jaccard.similar_components(docs), "doc_id", "component_id")
    assert len(got) == len(ROWS)
    assert (5, 4) in got and (2, 2) in got and (3, 3) in got and (None, None) in got and got.count((1, 1)) == 3
    assert jaccard.similar_components(docs.limit(0)).count() == 0


def test_jaccard_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 60))] for _ in range(12)]
    texts = []
    for words in base:
        for _ in range(rng.randint(1, 12)):
            copy = list(words)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy + ["x y z boiler plate line of text"] * rng.randint(0, 1)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} for w in (t.split() for t in texts)]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = jaccard.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def test_decontamination(spark, docs):
    item = " ".join(LONG.split()[2000:2020])
    bench = spark.createDataFrame([(9, item), (10, None), (None, "too short"), (11, "")], "item_id long, text string")
    got = by(decontamination.contaminated(docs, bench), "doc_id", "item_id", "n_words", "distance")
    assert got == [(4, 9, 20, 0), (5, 9, 20, 0)]
    clean = decontamination.without_contaminated(docs, bench)
    assert clean.schema == docs.schema and clean.count() == len(ROWS) - 2
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_recall_against_all_windows():
    """Items with random edits in random text: of the windows within the edits, 9 of 10 at least are found."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(0)
    items = [[f"v{rng.integers(3000)}" for _ in range(rng.integers(10, 50))] for _ in range(60)]
    texts, wanted, found = [], 0, 0
    for words in items * 4:
        copy = list(words)
        for _ in range(rng.integers(0, int(decontamination.edits(len(words))) + 1)):
            at, kind = rng.integers(len(copy)), rng.integers(3)
            copy[at : at + (kind > 0)] = ["edit"] if kind < 2 else []
        around = [f"v{rng.integers(3000)}" for _ in range(40)]
        texts.append(" ".join(around[:20] + copy + around[20:]))
    prepared = decontamination.prepare(pa.table({"item_id": list(range(60)), "text": [" ".join(w) for w in items]}))
    hits = set(zip(*(x.tolist() for x in decontamination.search(prepared, pa.array(texts))[:2]), strict=True))

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for k, text in enumerate(texts):
        item, words = items[k % 60], text.split()
        near = min(edit(words[s : s + len(item)], item) for s in range(len(words) - len(item) + 1)) <= decontamination.edits(len(item))
        wanted, found = wanted + near, found + (near and (k, k % 60) in hits)
        assert near or (k, k % 60) not in hits
    assert wanted > 150 and found >= 0.95 * wanted


def test_scorers(docs, labels):
    for module, apply, value, more in ((quality, quality.line_quality, "quality", "good_lines"), (toxicity, toxicity.toxic_spans, "toxicity", "toxic_spans")):
        for known in (labels, labels.limit(0)):
            model = module.train(docs, known)
            got = apply(docs, model)
            assert got.columns == [c for c in docs.columns if c != value] + [value, more]
            assert got.count() == len(ROWS) and got.where(f"{value} BETWEEN 0 AND 1").count() == len(ROWS)
            assert apply(docs.limit(0), model).count() == 0
    assert toxicity.without_toxic(docs, toxicity.train(docs, labels.limit(0))).schema == docs.schema


def test_scorers_on_held_out_rows(spark, sf_dir):
    path = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    for module, apply, value, label, least in ((quality, quality.line_quality, "quality", "quality", 0.97), (toxicity, toxicity.toxic_spans, "toxicity", "toxic", 0.9)):
        rows = apply(docs, module.train(docs, labels)).join(labels.withColumnRenamed("quality", "q"), "doc_id") if label == "toxic" else apply(docs.select("doc_id", "text"), module.train(docs, labels)).join(labels.withColumnRenamed("quality", "q"), "doc_id")
        held = rows.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
        truth = F.col("toxic" if label == "toxic" else "q")
        right = held.where((F.col(value) >= module.THRESHOLD).cast("int") == truth).count()
        assert right >= least * held.count(), (value, right, held.count())


def test_mixing(docs):
    sized = docs.select("doc_id", "source", "epoch", "target", mixing.words_in(F.col("text")).alias("size"))
    from polyglint.llm.queries import curriculum_plan

    plan = curriculum_plan(sized)
    stream = mixing.curriculum(sized, plan).collect()
    wanted = {r.source: int(r.target) for r in plan.collect()}
    sizes = {r.source: r.source_size for r in plan.collect()}
    taken = dict.fromkeys(wanted, 0)
    for r in stream:
        taken[r.source] += r.take
        assert 0 < r.take <= r.size and 0 <= r.position <= 1 and r.epoch in (0, 1)
    assert taken == wanted and all(wanted[s] <= 2 * sizes[s] for s in sizes)
    assert [r.position for r in stream] == sorted(r.position for r in stream)
    assert mixing.curriculum(sized.limit(0), curriculum_plan(sized.limit(0))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    body = "<p>é\r\n\r\nWARC/1.1\r\n</p>" * 5000
    rows = [(1, "http://a", body), (2, None, body), (3, "http://c\nx", None), (4, "d", ""), (None, "e", "only"), (5, "f", "only"), (6, "g", body), (6, "g", body)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    for split in (500, 1 << 23):
        got = warc.round_trip(pages, folder=str(tmp_path / f"w{split}"), split_bytes=split).collect()
        assert len(got) == len(rows)
        for r in got:
            want = next((h or "").encode() for p, _, h in rows if p == r.page_id)
            assert r.payload_bytes == len(want) and r.payload_digest == base64.b32encode(hashlib.sha1(want).digest()).decode()
            assert r.payload == (want if r.record_type == "response" else None)
        kinds = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got)
        assert kinds == [("1", "revisit", 6), ("2", "revisit", 6), ("3", "revisit", 4), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("6", "revisit", 6), ("None", "revisit", 5)]
    assert warc.round_trip(pages.limit(0), folder=str(tmp_path / "none")).count() == 0


def test_pii_counts_every_row(docs):
    assert pii.personal_data(docs).count() == len(ROWS)


def test_pipeline_stages_take_odd_tables(spark, docs, labels, tmp_path):
    bench = spark.createDataFrame([(1, "x")], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for table in (docs, docs.limit(0)):
        now = table
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, str(tmp_path))
            assert now.columns == table.columns
        corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
