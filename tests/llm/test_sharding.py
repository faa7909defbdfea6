"""Shards: the law, the slots, and groups kept whole where the quotas allow it."""

import zlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from polyglint.llm import placing, sharding

SCHEMA = "doc_id long, text string, lang string, id long, node string, by long, shard int, slot int, low int"


def docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", 1, "n", 2, 3, 4, 5) for i, t in zip(ids, texts, strict=True)], SCHEMA).repartition(3)


def held(df):
    got = df.collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    return got, by


@pytest.mark.parametrize("n", [0, 1, 5, 8, 203])
def test_counts_are_at_most_one_apart(spark, n):
    got, by = held(sharding.sharded(docs(spark, [f"text {i % 90}" for i in range(n)])))
    assert len(got) == n and [len(by.get(s, [])) for s in range(8)] == sharding.quotas(n, 8)


def test_groups_stay_whole(spark):
    texts = [f"group {i % 40}" for i in range(120)] + [f"alone {i}" for i in range(280)]
    got, _ = held(sharding.sharded(docs(spark, texts)))
    shards = {}
    for r in got:
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert max(map(len, shards.values())) == 1


def test_a_group_larger_than_shards(spark):
    texts = ["same"] * 300 + [f"alone {i}" for i in range(340)]
    got, _ = held(sharding.sharded(docs(spark, texts)))
    parts = Counter(r.shard for r in got if r.doc_id < 300)
    # 80 rows a shard: four shards are needed, and hashes may leave one more row or two elsewhere
    assert sum(sorted(parts.values())[-4:]) >= 290


def test_cut_against_the_best_of_all(spark):
    """Three groups of different sizes and two loose rows in two shards: nothing is cut, as the best split does."""
    texts = ["a"] * 4 + ["b"] * 3 + ["c"] * 3 + ["d", "e"]
    got, _ = held(sharding.sharded(docs(spark, texts), n_shards=2))
    shard = {r.doc_id: r.shard for r in got}
    cut = sum(shard[i] != shard[j] for i, j in combinations(range(len(texts)), 2) if texts[i] == texts[j])
    best = min(
        sum((i in half) != (j in half) for i, j in combinations(range(len(texts)), 2) if texts[i] == texts[j])
        for half in map(set, combinations(range(len(texts)), len(texts) // 2))
    )
    assert best == 0 and cut <= 3


def test_links_of_several_nodes(spark):
    """A chain of documents, each linked with the next: most links stay in a shard."""
    rows = spark.range(400).select("id", F.col("id").alias("by"))
    links = rows.select("id", "id").toDF("id", "node").union(rows.select("id", (F.col("id") + 1).alias("node")))
    got, by = held(sharding.balanced_shards(rows, links.unionByName(links).unionByName(links.limit(1).withColumn("node", F.lit(None).cast("long"))), n_shards=4))
    assert [len(by[s]) for s in range(4)] == [100] * 4
    shard = {r.id: r.shard for r in got}
    assert sum(shard[i] != shard[i + 1] for i in range(399)) < 200


def test_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(placing, "LARGE_PART", 4)
    monkeypatch.setattr(sharding, "LARGE_PART", 4)
    texts = [None, "", "", "long " * 50_000, "é", "é", "é", "é", "é", "é"]
    got, by = held(sharding.sharded(docs(spark, texts, [7, 7, None, 1, 2, 2, 2, 3, 4, 5])))
    assert Counter(r.text_crc32 for r in got)[0] == 3 and Counter(r["size"] for r in got)[1] == 3
    assert sum(r.text_crc32 == zlib.crc32("é".encode()) and r["size"] == 3 for r in got) == 6
    assert sorted(len(v) for v in by.values()) == [1, 1, 1, 1, 1, 1, 2, 2]
