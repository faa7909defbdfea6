"""Repeated passages of words by seed and extend."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyglint.llm.storage import saved
from polyglint.llm.words import Prefix, chunks, joined, mixed, sliding_min, words_of

#: Words of the shortest passage that counts.
MIN_WORDS = 50
_NOTHING = hashlib.sha256(b"").hexdigest()


def _seed_words(min_words: int) -> int:
    """Words of a seed: a third of the passage. The rest of the passage is the winnowing window, so that each passage
    of ``min_words`` holds exactly one winnowed seed, chosen by its own words alone."""
    return max(1, min_words // 3)


def _anchors(hashes: np.ndarray, min_words: int) -> np.ndarray:
    """For each passage of ``min_words`` words, the seed that stands for it: the least hash of its seeds."""
    k = _seed_words(min_words)
    return sliding_min(Prefix(hashes).windows(k, seed=7), min_words - k + 1)


def _sketch(min_words: int):
    """Per row: n_words, a signature of the word sequence, SHA-256 of the words, and the winnowed seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"))
            hashes = words.hashes()
            first, n = words.first, np.diff(words.first)
            one, two = (Prefix(mixed(hashes, s)).ranges(first[:-1], first[1:], s) for s in (1, 2))
            anchors = _anchors(hashes, min_words)
            seeds = [np.unique(anchors[a : max(a, b - min_words + 1)]).view(np.int64) for a, b in zip(first, first[1:], strict=False)]
            buffer, cuts = joined(words, np.ones(len(hashes), bool))
            shas = [hashlib.sha256(buffer[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts, cuts[1:], strict=False)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, seeds)]).astype(np.int32), np.concatenate(seeds))
            arrays = [batch.column("doc_id"), batch.column("key"), pa.array(n.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(shas), lists]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_words", "sig1", "sig2", "sha", "seeds"])

    return run


def _extend(min_words: int):
    """The passages around the seeds that documents share: every passage that has such a seed, with its own hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"))
            hashes = words.hashes()
            anchors = _anchors(hashes, min_words)
            shared = batch.column("shared")
            found = []
            for d, (a, b) in enumerate(zip(words.first, words.first[1:], strict=False)):
                own = anchors[a : max(a, b - min_words + 1)]
                seeds = shared[d].values.to_numpy(zero_copy_only=False).view(np.uint64)
                found.append(a + np.flatnonzero(np.isin(own, seeds)))
            rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
            starts = np.concatenate(found).astype(np.int64)
            one, two = (Prefix(mixed(hashes, s)).ranges(starts, starts + min_words, s) for s in (1, 2))
            take = pa.array(rows)
            arrays = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), batch.column("doc_id").take(take), batch.column("key").take(take), pa.array((starts - words.first[rows]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["one", "two", "doc_id", "key", "start"])

    return run


def _cut(min_words: int):
    """Rows without the words that the passages at ``starts`` cover: n_removed, the kept words and their SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"))
            depth = np.zeros(len(words.starts) + 1, np.int64)
            for d, starts in enumerate(batch.column("starts")):
                at = np.unique(starts.values.to_numpy(zero_copy_only=False)) + words.first[d]
                depth[at] += 1
                depth[at + min_words] -= 1
            keep = np.cumsum(depth)[:-1] == 0
            gone = np.concatenate([[0], np.cumsum(~keep)])[words.first]
            buffer, cuts = joined(words, keep)
            kept = [buffer[a : max(a, b - 1)] for a, b in zip(cuts, cuts[1:], strict=False)]
            arrays = [batch.column("doc_id"), batch.column("key"), pa.array(np.diff(gone)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "n_removed", "kept_sha256"])

    return run


def repeated_passages(docs: DataFrame, *, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256.

    A word goes if a passage of ``min_words`` words that covers it also starts in a document with a smaller doc_id.

    1. Seeds: each document is winnowed to the seeds of its passages. Documents with the same words as one with a
       smaller doc_id are wholly repeated (a signature of 128 bits tells) and stand back from what follows.
    2. Join: seeds that two documents hold are joined back to their documents.
    3. Extend: around a shared seed all passages that it stands for, up to its furthest on both sides, are compared by
       a hash of 128 bits; those whose first document is another one are repeated. Passages meet in a map-side
       minimum, never in pairs, so a passage in thousands of documents costs its own occurrences.
    4. Repeated passages that touch are one maximal repeat; its words are cut.

    Texts are moved once, and only those with shared seeds are kept. Defined cases: a null text has no words; documents
    shorter than ``min_words`` keep all; a null doc_id is neither earlier nor later than another document; rows that
    repeat a doc_id never cut each other; empty tables give empty results; other columns are not looked at.
    """
    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    sketch = saved(keyed.mapInArrow(_sketch(min_words), "doc_id long, key long, n_words long, sig1 long, sig2 long, sha string, seeds array<long>"))
    long_enough = sketch.where((F.col("n_words") >= min_words) & F.col("doc_id").isNotNull())
    signature = ["n_words", "sig1", "sig2"]
    groups = long_enough.groupBy(*signature).agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last")).where("keep < last")
    copies = saved(long_enough.select("doc_id", "key", *signature).join(saved(groups), signature).where("doc_id > keep").select("doc_id", "key").distinct())

    seeds = long_enough.join(copies, ["doc_id", "key"], "left_anti").select("doc_id", "key", F.explode("seeds").alias("seed"))
    shared = seeds.groupBy("seed").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("seed")
    own = seeds.join(saved(shared), "seed").groupBy("doc_id", "key").agg(F.collect_set("seed").alias("shared"))
    texts = saved(keyed.join(own, ["doc_id", "key"]))

    passages = texts.mapInArrow(_extend(min_words), "one long, two long, doc_id long, key long, start int")
    firsts = passages.groupBy("one", "two").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("one", "two", "a")
    later = passages.join(saved(firsts), ["one", "two"]).where("doc_id > a")
    cuts = later.groupBy("doc_id", "key").agg(F.collect_set("start").alias("starts"))
    cut = texts.drop("shared").join(cuts, ["doc_id", "key"]).mapInArrow(_cut(min_words), "doc_id long, key long, n_removed long, kept_sha256 string")
    cut = cut.dropDuplicates(["doc_id", "key"]).withColumn("found", F.lit(True))
    gone = copies.withColumn("copied", F.lit(True))
    return (
        sketch.select("doc_id", "key", "n_words", "sha")
        .join(gone, ["doc_id", "key"], "left")
        .join(cut, ["doc_id", "key"], "left")
        .select(
            "doc_id",
            "n_words",
            F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(F.col("copied"), F.lit(_NOTHING)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        )
    )
