"""Phrases against a plain count of every run of words, and the sort against a counter."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from polyglint.llm import phrases

SCHEMA = "doc_id long, text string, lang string, source string, code long, phrase string, times int, n int, rank int"


def brute(rows, least, top):
    pieces = []
    for lang, text in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        pieces += [(lang or "und", re.findall(r"[^ \t]+", p)) for p in re.split(r"[.,;:!?\n-\r]", text)]
    n, f = Counter(), Counter()
    for lang, words in pieces:
        n[lang] += len(words)
        f.update((lang, tuple(words[i : i + d])) for d in range(1, 6) for i in range(len(words) - d + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, g), a in candidates.items():
        inside = any(la == lang and len(h) > len(g) and b >= a and any(h[i : i + len(g)] == g for i in range(len(h))) for (la, h), b in candidates.items())
        if not inside:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {
        (lang, rank, phrase.decode(), -a, left, right, n[lang], -score)
        for lang, rows in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1)
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = ["the", "of", "And", "es", "en", "çé", "\U0001f600x", "new", "york", "city"]
    out = [(lang, " ".join(rng.choice([*vocabulary, "new york city", "of.", "the,", "a\tb", "x\ny", " "]) for _ in range(rng.randrange(60)))) for lang in ("en", "es", None, "und") for _ in range(12)]
    out += [("en", None), ("en", ""), (None, " \t "), ("fr", "the the the the the the"), ("en", "new york city " * 3000), out[0], out[0]]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, text, lang, "s", 1, "p", 2, 3, 4) for i, (lang, text) in enumerate(rows)], SCHEMA)


def collected(df):
    return {tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}


def test_against_brute_force(docs, rows):
    assert collected(phrases.collocations(docs, least=4, top=25)) == brute(rows, 4, 25)


def test_pairs_dealt_out_by_suffix(docs, rows, monkeypatch):
    monkeypatch.setattr(phrases, "TASK_SUFFIXES", 50)
    assert collected(phrases.collocations(docs, least=4, top=1000)) == brute(rows, 4, 1000)


def test_a_full_filter_changes_nothing(docs, rows, monkeypatch):
    full = phrases.Bits(np.full(1 << (phrases.FILTER_BITS - 6), np.uint64(2**64 - 1)))
    monkeypatch.setattr(phrases, "_bits", lambda codes: full)
    assert collected(phrases.collocations(docs, least=4, top=25)) == brute(rows, 4, 25)


def test_empty_table(docs):
    assert phrases.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_equal_parts_are_counts(seed):
    rng = np.random.default_rng(seed)
    words = rng.integers(0, 2 + seed, (400, 5)).astype(np.uint64)
    words[np.cumsum(words == 0, axis=1) > 0] = 0
    times, split, least = rng.integers(1, 4, 400), rng.random(400) < 0.1 * (seed % 2), 5
    at, depth, total = phrases.equal_parts(words, times, split, least)
    got = {tuple(words[p, :d]): t for p, d, t in zip(at, depth, total, strict=True)}
    want, some = Counter(), set()
    for row, t, s in zip(words, times, split, strict=True):
        for d in range(2, 6):
            if row[d - 1]:
                want[tuple(row[:d])] += t
                some |= {tuple(row[:d])} if s else set()
    assert {k: v for k, v in got.items() if v >= least or k in some} == {k: v for k, v in want.items() if v >= least or k in some}
    assert len(got) == len(at)
