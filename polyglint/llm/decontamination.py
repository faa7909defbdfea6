"""Benchmark items hidden in documents: edit distance by random-walk embedding, bit-sampling LSH and verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyglint.llm.words import Prefix, chunks, mixed, words_of

#: Edits of words (insert, delete, replace) that an item may have gone through, as a part of its words.
MOST_EDITS = 0.2
#: Items with fewer words are not looked for: they stand in ordinary text.
LEAST_WORDS = 8
#: Random walks, and bits sampled from each. A pair of windows is a candidate if all bits of one walk agree.
WALKS, SAMPLED = 32, 2
#: Bits of a hash by which words' runs that no item has are set aside before the sorted runs are searched.
_FILTER_BITS = 22
#: Items and bytes of their texts worked on at once, which bounds what is broadcast. More take more passes over the
#: documents.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20
_PAD = np.uint64(0xFFFFFFFFFFFFFFFF)
FOUND = "item_id long, start long, n_words long, distance int"


def edits(n_words):
    """Edits allowed for an item of so many words."""
    return np.floor(MOST_EDITS * n_words).astype(np.int64)


class Group(NamedTuple):
    """Items with equal numbers of words. Grams are runs of words: one of each item stands unedited in any window
    within its edits (an item of m words with e edits keeps m - e words in at most e + 1 runs)."""

    words: int
    ids: np.ndarray
    hashes: np.ndarray
    gram: int
    grams: np.ndarray
    owners: np.ndarray
    codes: np.ndarray


class Items(NamedTuple):
    """Groups by number of words, and for each length of runs the hashes that any of their runs have."""

    groups: list[Group]
    marks: dict[int, np.ndarray]


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _walk(sequences, starts: np.ndarray, stops: np.ndarray, n_words: int) -> np.ndarray:
    """Codes of windows of a word sequence, one per walk: the CGK embedding of each window, and its sampled places.

    A walk reads the window's current word once per step and moves on by a bit that the word, the step and the walk
    determine; behind the window it reads padding. Equal words at equal steps move two walks alike, so after an edit
    walks meet again by chance, and the embeddings differ in few places. SAMPLED of the first n_words places are drawn
    per walk, and the words read there make its code: a walk is half through the window by then, and those that ask for
    little let more candidates through to the exact distance, never fewer.
    """
    rng = np.random.default_rng(n_words)
    places = np.sort(rng.integers(0, n_words, (WALKS, SAMPLED)), axis=1)
    at = np.repeat(starts[:, None], WALKS, axis=1)
    codes = np.zeros(at.shape, np.uint64)
    shifts = np.arange(WALKS, dtype=np.uint64)
    for step in range(places.max() + 1):
        inside = at < stops[:, None]
        word = np.where(inside, sequences[np.minimum(at, len(sequences) - 1)], _PAD)
        sampled = (places == step).any(axis=1)
        codes[:, sampled] = mixed(codes[:, sampled] ^ word[:, sampled], step)
        at += ((mixed(word, 1000 + step) >> shifts) & np.uint64(1)).astype(np.int64)
    return codes


def distances(windows: np.ndarray, items: np.ndarray) -> np.ndarray:
    """Edit distance of words of each window (rows, padded) to each item (rows), in step."""
    n, width = items.shape
    row = np.repeat(np.arange(width + 1)[None, :], n, axis=0)
    steps = np.arange(width + 1)
    for j in range(windows.shape[1]):
        word = windows[:, j]
        real = word != _PAD
        replaced = row[:, :-1] + (items != word[:, None])
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + 1
        new[:, 1:] = np.minimum(replaced, row[:, 1:] + 1)
        new = np.minimum.accumulate(new - steps, axis=1) + steps
        row = np.where(real[:, None], new, row)
    return row[:, -1]


def free_distances(texts: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text (rows, padded) the stretch of it that is nearest to the item (rows): edit distance, first word and
    end. Of stretches at equal distance, the one that begins first, and of those the longest."""
    n, width = items.shape
    # a cell is the distance and, below it, the first word of the stretch, so that the least cell decides both
    unit = texts.shape[1] + 1
    steps = unit * np.arange(width + 1)
    row = np.repeat(steps[None, :], n, axis=0)
    best, end = row[:, -1].copy(), np.zeros(n, np.int64)
    for j in range(texts.shape[1]):
        word = texts[:, j]
        replaced = row[:, :-1] + unit * (items != word[:, None])
        new = np.empty_like(row)
        new[:, 0] = j + 1
        new[:, 1:] = np.minimum(replaced, row[:, 1:] + unit)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        better = (row[:, -1] <= best) & (word != _PAD)
        best, end = np.where(better, row[:, -1], best), np.where(better, j + 1, end)
    return best // unit, best % unit, end


def prepare(rows: pa.Table) -> Items:
    """Items (item_id, text) by number of words. Null texts and short ones are left out; equal items stay apart."""
    words = words_of(rows.column("text").combine_chunks(), lower=True)
    hashes, lengths = words.hashes(), np.diff(words.first)
    ids = np.array([-1 if x is None else x for x in rows.column("item_id").to_pylist()], np.int64)
    out, marks = [], {}
    for m in np.unique(lengths[lengths >= LEAST_WORDS]):
        which = np.flatnonzero(lengths == m)
        own = hashes[words.first[which][:, None] + np.arange(m)]
        gram = int(-(-(m - edits(m)) // (edits(m) + 1)))
        runs = np.stack([Prefix(x).windows(gram, 3) for x in own])
        flat = np.arange(len(which) * m)
        codes = _walk(own.ravel(), flat[::m], flat[::m] + m, int(m))
        order = np.argsort(runs.ravel(), kind="stable")
        out.append(Group(int(m), ids[which], own, gram, runs.ravel()[order], order, codes))
        marks.setdefault(gram, np.zeros(1 << _FILTER_BITS, bool))[_slot(runs.ravel())] = True
    return Items(out, marks)


def search(items: Items, texts: pa.Array, *, free_ends: bool = False) -> tuple[np.ndarray, ...]:
    """Row, item, first word, words and distance of the best window of each item found in each text.

    Windows have the item's number of words. With ``free_ends`` those are candidates only, and what is given is the
    stretch of any number of words around them that is nearest to the item.
    """
    words = words_of(texts, lower=True)
    hashes, first = words.hashes(), words.first
    prefix, rows, found, some = Prefix(hashes), words.row_of_word(), [], {}
    for gram, marks in items.marks.items():
        seen = prefix.windows(gram, 3)
        hit = np.flatnonzero(marks[_slot(seen)])
        hit = hit[rows[hit] == rows[hit + gram - 1]]
        some[gram] = hit, seen[hit]
    for group in items.groups:
        hit, seen = some[group.gram]
        low, high = (np.searchsorted(group.grams, seen, side=side) for side in ("left", "right"))
        times = high - low
        if not times.any():
            continue
        owner = group.owners[np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())]
        at, per_item = np.repeat(hit, times), group.words - group.gram + 1
        item, offset, reach = owner // per_item, owner % per_item, int(edits(group.words))
        places = np.unique(np.stack([item, at - offset, rows[at]]), axis=1)
        # windows of the item's size that hold the run at its place, or shifted by as many words as there may be edits
        shifted = places[1][:, None] + np.arange(-reach, reach + 1)
        row = np.repeat(places[2], 2 * reach + 1)
        # a stretch with words deleted may begin where the text is too short for a whole window
        least = group.words - reach if free_ends else group.words
        starts = np.clip(shifted.ravel(), first[row], np.maximum(first[row], first[row + 1] - least))
        pairs, pair = np.unique(np.stack([np.repeat(places[0], 2 * reach + 1), starts]), axis=1, return_inverse=True)
        unique, back = np.unique(pairs[1], return_inverse=True)
        codes = _walk(hashes, unique, np.minimum(unique + group.words, first[rows[unique] + 1]), group.words)
        agree = (codes[back] == group.codes[pairs[0]]).any(axis=1)
        if free_ends:
            # what stands within the edits and has the run at this place lies inside these words
            item, place, row = places[:, agree[pair.ravel()].reshape(shifted.shape).any(axis=1)]
            starts, stops = np.maximum(place - reach, first[row]), np.minimum(place + group.words + reach, first[row + 1])
        else:
            item, starts = pairs[:, agree]
            row = rows[starts]
            stops = np.minimum(starts + group.words, first[row + 1])
        if not len(item):
            continue
        cells = starts[:, None] + np.arange(group.words + 2 * reach * free_ends)
        windows = np.where(cells < stops[:, None], hashes[np.minimum(cells, len(hashes) - 1)], _PAD)
        if free_ends:
            distance, begin, end = free_distances(windows, group.hashes[item])
        else:
            distance, begin, end = distances(windows, group.hashes[item]), np.zeros_like(starts), stops - starts
        near = np.flatnonzero(distance <= reach)
        found.append(np.stack([row, group.ids[item], starts + begin - first[row], end - begin, distance])[:, near])
    if not found:
        return tuple(np.zeros((5, 0), np.int64))
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((-every[3], every[2], every[4], every[1], every[0]))]
    best = np.ones(every.shape[1], bool)
    best[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
    return tuple(every[:, best])


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark in blocks that fit a broadcast."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for part in range(parts):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield prepare(own.toArrow())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document and item that it holds, up to edits: doc_id, item_id, start and n_words of the best window
    (in words), and its distance.

    Words are compared with A to Z as small letters. Places that share a run of words which any stretch within the
    allowed edits must share are looked at by windows of the item's number of words, embedded by random walks; where a
    window agrees with an item in all sampled places of one walk (of WALKS), the edit distance is computed to the nearest
    stretch of the text around it, of any number of words within the edits.

    Defined cases: null and empty texts hold nothing; of stretches at equal distance, the first is given, and of those
    the longest; items with fewer than LEAST_WORDS words are not looked for; repeated rows are reported
    each, repeated items once per item_id and document in a block; null ids are kept (item_id -1); other columns are not
    looked at; an empty table on either side gives an empty result.
    """
    parts = []
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                row, item, start, size, distance = search(shared.value, batch.column("text"), free_ends=True)
                arrays = [batch.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(start), pa.array(size), pa.array(distance.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "start", "n_words", "distance"])

        parts.append(docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, {FOUND}"))
    return reduce(DataFrame.unionByName, parts)


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; columns as they are. Cases as in ``contaminated``."""
    for items in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, "text"):
                clean = np.ones(batch.num_rows, bool)
                clean[search(shared.value, batch.column("text"), free_ends=True)[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
