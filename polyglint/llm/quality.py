"""Quality of documents from lines that a linear-chain conditional random field labels good or bad."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from polyglint.llm import crf, labelled
from polyglint.llm.scoring import scored
from polyglint.llm.words import chunks, mixed, words_of

THRESHOLD = 0.7
_KINDS = ("upper", "lower", "digit", "blank", "stop", "mark", "wide")


def _kinds() -> np.ndarray:
    """Kind of each byte: letters by case, digits, blanks, stops, other marks, and bytes of non-ASCII letters."""
    kind = np.full(256, _KINDS.index("wide"), np.uint8)
    for code in range(128):
        c = chr(code)
        kind[code] = _KINDS.index(
            "upper" if c.isupper() else "lower" if c.islower() else "digit" if c.isdigit() else "blank" if c.isspace() else "stop" if c in ".,;:?'\"-()" else "mark"
        )
    return kind


_KIND = _kinds()


class Model(NamedTuple):
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    transitions: crf.Transitions
    calibration: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows, and the first line of each row. A row has one line more than breaks."""
    breaks = np.flatnonzero(data == 0x0A)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    rows_breaks = np.searchsorted(breaks, offsets)
    first = rows_breaks + np.arange(len(offsets))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    return starts, ends, first


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line, the first line of each row, and the lines' lengths.

    Of a line: its length and words, parts of its bytes by kind, parts of words that end in a mark, follow themselves
    or stand there before, mean word length, whether the row has the line more than once; then the same of the line
    before and behind.
    """
    words = words_of(texts, lower=True)
    starts, ends, first = lines_of(words.data, words.offsets)
    # an empty row at a line break's end shares its start with the next: order of equal starts is that of the rows
    n = len(starts)
    length = (ends - starts).astype(np.float64)
    kinds = _KIND[words.data]
    parts = []
    for k in range(len(_KINDS)):
        sums = np.concatenate([[0], np.cumsum(kinds == k, dtype=np.int64)])
        parts.append((sums[ends] - sums[starts]) / np.maximum(1, length))
    line = np.searchsorted(starts, words.starts, side="right") - 1
    hashes = words.hashes()
    count = np.bincount(line, minlength=n).astype(np.float64)
    some = np.maximum(1, count)
    marked = np.bincount(line, kinds[words.ends - 1] == _KINDS.index("mark"), minlength=n) / some
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    follows = np.bincount(line, again, minlength=n) / some
    distinct = np.unique(mixed(hashes + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    repeated = 1 - np.bincount(line[distinct], minlength=n) / some
    repeated[count == 0] = 0
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ids = words.codes.ranges(starts, ends, 5) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, inverse, times = np.unique(ids, return_inverse=True, return_counts=True)
    twice = (times[inverse] > 1) & (length > 0)
    own = np.column_stack([np.log1p(length), np.log1p(count), *parts, *map(np.sqrt, parts), marked, follows, repeated, np.sqrt(repeated), length / some / 10, twice, length == 0])
    before, behind = np.zeros_like(own), np.zeros_like(own)
    before[1:], behind[:-1] = own[:-1], own[1:]
    before[first[:-1]] = 0
    behind[first[1:] - 1] = 0
    return np.hstack([own, before, behind]), first, length


def _weighted(p: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Mean marginal of each row, weighed by line length, and its logit."""
    weight = length + 1
    mean = np.add.reduceat(p * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
    clipped = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.column_stack([mean, np.log(clipped / (1 - clipped)) / 10])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the bounded sample of ``labelled.sample`` (documents doc_id, text; labels doc_id, quality).

    Each line starts from its document's label; the field weighs the line's and its neighbours' features and how labels
    follow each other. Without examples of both labels every score is the part of good ones (1 if there are none).
    """
    rows = labelled.sample(docs, labels, "quality")
    good = rows.column("label").to_numpy()
    if not len(good) or good.min() == good.max():
        part = 30.0 if not len(good) or good.min() else -30.0
        width = _features(pa.array([""]))[0].shape[1]
        return Model(np.zeros(width), np.ones(width), np.zeros(width + 1), crf.Transitions(1, 1, 1, 1), np.array([0, 0, part]))
    parts = [_features(batch.column("text")) for batch in chunks(rows.to_batches(), "text")]
    x, length = (np.concatenate([part[i] for part in parts]) for i in (0, 2))
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(part[1]) for part in parts]))])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x = (x - centre) / scale
    tags = np.repeat(good, np.diff(first))
    weights, transitions = crf.fit(lambda w: x @ w[:-1] + w[-1], lambda r: np.append(r @ x, r.sum()), x.shape[1] + 1, tags, first, rounds=150, rate=0.1)
    p = crf.marginals(x @ weights[:-1] + weights[-1], first, transitions)
    return Model(centre, scale, weights, transitions, crf.logistic(_weighted(p, first, length), good, ridge=1e-3))


def score(model: Model, texts: pa.Array) -> list[pa.Array]:
    """Score of each text and the marginal of each of its lines."""
    x, first, length = _features(texts)
    p = crf.marginals((x - model.centre) / model.scale @ model.weights[:-1] + model.weights[-1], first, model.transitions)
    values = crf.sigmoid(_weighted(p, first, length) @ model.calibration[:-1] + model.calibration[-1])
    return [pa.array(values), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(p))]


def line_quality(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality (0 to 1, higher is better) and good_lines (the marginal of each line), one pass.

    Defined cases: null and empty texts are one empty line; any length; other columns are carried along, but for ones
    named quality or good_lines, which are replaced; an empty table gives an empty result. Rows stand for themselves,
    so repeated rows and null ids do not matter.
    """
    return scored(docs, model, score, "quality double, good_lines array<double>")
