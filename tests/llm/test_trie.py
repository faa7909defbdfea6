"""The trie of beginnings against one made of Python tuples, and its defined cases."""

import hashlib
import random
import zlib

import pytest

from polyglint.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p1 long, pos int, chars int, n_convs int"


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    nodes, ends = {}, {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = set()
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        parent = min(nodes[p[:-1]]) if p else None
        out.add((min(members), len(p), parent, len(members), len(kids.get(p, [])), sum(q not in kids for q in below), saved, sha))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = ["hi", "çé\U0001f600", "", None, "a longer turn\nof two lines", "x" * 3000]
    out = [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for c in [*range(0, 12), *range(100, 140), *range(205, 240)] for t in range(rng.randrange(1, 9))]
    out += [(300, t, "user", str(t)) for t in range(70)] + [(301, t, "user", str(t)) for t in range(71)]
    out += [(c, t, "u", "same") for c in range(400, 460) for t in range(4)]
    return [*out, (500, None, "u", "first"), (500, 0, "u", "next"), (None, 0, "u", "nobody"), out[0], out[0]]


@pytest.mark.parametrize("height", [2, 5, 16])
def test_against_brute_force(spark, rows, height):
    got = [tuple(r) for r in trie.prefix_trie(conversations(spark, rows), height=height).select(COLUMNS).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_groups_and_blocks(spark, rows, monkeypatch):
    from polyglint.llm import placing

    monkeypatch.setattr(placing, "LARGE_PART", 3)
    monkeypatch.setattr(trie, "_BLOCK", 4)
    assert {tuple(r) for r in trie.prefix_trie(conversations(spark, rows), height=3).select(COLUMNS).collect()} == brute(rows)


def test_empty_table(spark, rows):
    assert trie.prefix_trie(conversations(spark, rows[:1]).limit(0)).count() == 0
    assert trie.prefix_trie(conversations(spark, [(None, 0, "u", "x")])).count() == 0
