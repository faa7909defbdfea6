"""Benchmark items with words inserted, deleted or replaced, inside longer texts."""

import numpy as np

from polyglint.llm import decontamination


def free(words, item):
    """Least distance of the item to any stretch of the words."""
    row = list(range(len(item) + 1))
    least = row[-1]
    for x in words:
        last, row[0] = row[0], 0
        for j, y in enumerate(item, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        least = min(least, row[-1])
    return least


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_recall_against_free_distance(spark):
    """The whole budget spent on one kind of edits, or mixed: of each, 0.95 of what is within the edits is found."""
    rng = np.random.default_rng(1)
    items = [[f"v{rng.integers(3000)}" for _ in range(rng.integers(10, 50))] for _ in range(60)]
    kinds, texts = ("insert", "replace", "delete", "mixed"), {}
    for k, kind in enumerate(kinds):
        for i, words in enumerate(items):
            copy = list(words)
            for _ in range(int(decontamination.edits(len(words)))):
                at, how = rng.integers(len(copy)), rng.integers(3) if kind == "mixed" else k
                copy[at : at + (how > 0)] = ["edit"] if how < 2 else []
            around = [f"v{rng.integers(3000)}" for _ in range(40)]
            # some copies stand at an end of their text
            texts[100 * k + i] = around[: 20 * (i % 3 > 0)] + copy + around[20 + 20 * (i % 3 > 1) :]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    for k, kind in enumerate(kinds):
        wanted = [i for i, x in enumerate(items) if free(texts[100 * k + i], x) <= decontamination.edits(len(x))]
        hits = [i for i in wanted if (100 * k + i, i) in found]
        print(kind, len(wanted), len(hits))
        assert len(wanted) == len(items) and len(hits) >= 0.95 * len(wanted), kind
    for (d, i), r in found.items():
        assert r.distance == edit(texts[d][r.start : r.start + r.n_words], items[i]) == free(texts[d], items[i]) <= decontamination.edits(len(items[i]))
    left = {r.doc_id for r in decontamination.without_contaminated(docs, bench).collect()}
    assert left == set(texts) - {d for d, _ in found}
