"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from polyglint.llm import crf, labelled
from polyglint.llm.scoring import scored
from polyglint.llm.words import Words, chunks, mixed, words_of

#: Weights of the hashed features; fixes the size of the model.
FEATURE_BITS = 18
#: Bytes of the word beginnings and endings that are features.
PREFIXES, SUFFIXES = (4, 5, 6), (4,)
#: A word counts as toxic for learning if one of its features stands in this part of the toxic documents at least, and
#: so many times (as a natural logarithm) as often there as in others.
LEAST_PART, LEAST_RATIO = 0.03, 3.0
THRESHOLD = 0.3


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    transitions: crf.Transitions
    calibration: np.ndarray


def _features(words: Words) -> list[np.ndarray]:
    """Buckets of each word's features: itself, its beginnings and endings, and its neighbours' beginnings."""
    mask = np.uint64((1 << FEATURE_BITS) - 1)
    starts, ends = words.starts, words.ends
    own = [words.codes.ranges(starts, ends, 1)]
    own += [words.codes.ranges(starts, np.minimum(ends, starts + n), 2 + i) for i, n in enumerate(PREFIXES)]
    own += [words.codes.ranges(np.maximum(starts, ends - n), ends, 9 + i) for i, n in enumerate(SUFFIXES)]
    stem = words.codes.ranges(starts, np.minimum(ends, starts + 5), 20)
    before, after = np.zeros_like(stem), np.zeros_like(stem)
    before[1:], after[:-1] = mixed(stem[:-1], 21), mixed(stem[1:], 22)
    heads, tails = words.first[:-1], words.first[1:] - 1
    some = heads <= tails
    before[heads[some]], after[tails[some]] = 1, 2
    return [(f & mask).astype(np.int64) for f in [*own, before, after]]


def _sampled(rows: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """Features of all words of the sample, made a chunk at a time, and the first word of each row."""
    parts, first = [], [np.zeros(1, np.int64)]
    for batch in chunks(rows.to_batches(), "text"):
        words = words_of(batch.column("text"), lower=True)
        parts.append([f.astype(np.int32) for f in _features(words)])
        first.append(first[-1][-1] + words.first[1:])
    return [np.concatenate(f) for f in zip(*parts, strict=True)], np.concatenate(first)


def _token_labels(first: np.ndarray, features: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Words of toxic documents that mark them: by how often their features stand in toxic and other documents."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n1, n0 = max(1, toxic.sum()), max(1, (1 - toxic).sum())
    best = np.full(len(rows), -np.inf)
    for buckets in features[: 1 + len(PREFIXES)]:
        seen = np.unique(rows * (1 << FEATURE_BITS) + buckets)
        row, bucket = seen >> FEATURE_BITS, seen & ((1 << FEATURE_BITS) - 1)
        in_toxic = np.bincount(bucket, toxic[row], minlength=1 << FEATURE_BITS)
        elsewhere = np.bincount(bucket, 1 - toxic[row], minlength=1 << FEATURE_BITS)
        ratio = np.log((in_toxic + 0.2) / (n1 + 0.4)) - np.log((elsewhere + 0.2) / (n0 + 0.4))
        ratio[in_toxic < max(3, LEAST_PART * n1)] = -np.inf
        best = np.maximum(best, ratio[buckets])
    return ((best >= LEAST_RATIO) & (toxic[rows] == 1)).astype(np.int64)


def _document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each document: the expected number of toxic words, how likely there is any, and the surest one."""
    sums = np.concatenate([[0], np.cumsum(p)])
    none = np.concatenate([[0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-6)))])
    lengths = np.diff(first)
    most = np.zeros(len(lengths))
    if len(p):
        some = lengths > 0
        most[some] = np.maximum.reduceat(p, first[:-1][some])
    return np.column_stack([np.log1p(sums[first[1:]] - sums[first[:-1]]), 1 - np.exp(none[first[1:]] - none[first[:-1]]), most])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the bounded sample of ``labelled.sample`` (documents doc_id, text; labels doc_id, toxic).

    Labels are of documents; words get theirs from them by ``_token_labels``, and the field learns to find such words
    from their own and their neighbours' features. Without a toxic or a clean example the model scores 0.
    """
    rows = labelled.sample(docs, labels, "toxic")
    toxic = rows.column("label").to_numpy()
    size = 1 << FEATURE_BITS
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(size), -30.0, crf.Transitions(1, 1, 1, 1), np.array([0.0, 0.0, 0.0, -30.0]))
    features, first = _sampled(rows)
    tags = _token_labels(first, features, toxic)

    def scores(w):
        return sum(w[f] for f in features) + w[-1]

    def gradient(residual):
        return np.append(sum(np.bincount(f, residual, minlength=size) for f in features), residual.sum())

    weights, transitions = crf.fit(scores, gradient, size + 1, tags, first, rounds=30, pull=5.0)
    p = crf.marginals(scores(weights), first, transitions)
    calibration = crf.logistic(_document_features(p, first), toxic)
    return Model(weights[:-1].astype(np.float32), float(weights[-1]), transitions, calibration)


def score(model: Model, texts: pa.Array) -> list[pa.Array]:
    """Score and spans (words whose marginal is at least one half, as code points from and to) of each text."""
    words = words_of(texts, lower=True)
    unary = sum(model.weights[f] for f in _features(words)).astype(np.float64) + model.bias if len(words.starts) else np.zeros(0)
    p = crf.marginals(unary, words.first, model.transitions)
    values = crf.sigmoid(_document_features(p, words.first) @ model.calibration[:-1] + model.calibration[-1])
    found = np.flatnonzero(p >= 0.5)
    points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    rows = np.searchsorted(words.first, found, side="right") - 1
    base = points[words.offsets[:-1]][rows]
    spans = pa.StructArray.from_arrays([pa.array((points[x[found]] - base).astype(np.int64)) for x in (words.starts, words.ends)], ["start", "end"])
    cuts = np.searchsorted(found, words.first).astype(np.int32)
    return [pa.array(values), pa.ListArray.from_arrays(pa.array(cuts), spans)]


def toxic_spans(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and toxic_spans (code points, end exclusive), by forward-backward marginals.

    Defined cases: null and empty texts have no words and get the score that a document without toxic words gets; any
    length; other columns are carried along, but for ones named toxicity or toxic_spans, which are replaced; an empty
    table gives an empty result. Rows stand for themselves, so repeated rows and null ids do not matter.
    """
    return scored(docs, model, score, "toxicity double, toxic_spans array<struct<start: long, end: long>>")


def without_toxic(docs: DataFrame, model: Model, *, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose toxicity is at least ``threshold``; columns as they are. Cases as above."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield batch.filter(pc.less(score(shared.value, batch.column("text"))[0], threshold))

    return docs.mapInArrow(run, docs.schema)
