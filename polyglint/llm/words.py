"""Words of whole Arrow columns at once: byte ranges and 64-bit hashes, by numpy on the column's own buffer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once. A longer text is worked on alone.
CHUNK_BYTES = 1 << 20

#: ASCII blanks part words: space and 0x09 to 0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

# An odd multiplier has an inverse modulo 2^64, so that a substring's polynomial follows from two prefix sums.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if base not in _tables or len(_tables[base]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        powers = np.full(size, base, np.uint64)
        powers[0] = 1
        _tables[base] = np.multiply.accumulate(powers)
    return _tables[base][:n]


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scramble of 64-bit numbers, so that all bits depend on all bits."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hashes of any ranges of a sequence of numbers, from running sums."""

    def __init__(self, values: np.ndarray):
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * _powers(_BASE, len(values)), out=self.sums[1:])

    def ranges(self, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * _powers(_INVERSE, len(self.sums))[starts]
        return mixed(raw + (ends - starts).astype(np.uint64), seed)

    def windows(self, n: int, seed: int = 0) -> np.ndarray:
        """Hashes of all runs of ``n`` values."""
        starts = np.arange(max(0, len(self.sums) - n))
        return self.ranges(starts, starts + n, seed)


class Words(NamedTuple):
    """Words of a column. ``first[d]`` to ``first[d + 1]`` are the words of row d; byte positions are in ``data``,
    where row d takes ``offsets[d]`` to ``offsets[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    codes: Prefix

    def hashes(self) -> np.ndarray:
        return self.codes.ranges(self.starts, self.ends)

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and the offsets of its rows in them; null is empty."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, len(column) + 1, 8 * column.offset) if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0] : ends[-1]], ends - ends[0]


def words_of(column: pa.Array, *, lower: bool = False) -> Words:
    """Words of a string column; ``lower`` turns A to Z into small letters for the hashes."""
    data, offsets = text_bytes(column)
    blank = _BLANK[data]
    begin, end = ~blank, ~blank
    if len(data):
        begin[1:] &= blank[:-1]
        end[:-1] &= blank[1:]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        begin[heads] = ~blank[heads]
        end[tails] = ~blank[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    codes = (_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), Prefix(codes))


def chunks(batches: Iterator[pa.RecordBatch], column: str, size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``size`` bytes, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        which = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(which)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by running minima of blocks from both ends."""
    n = len(values)
    if n < width:
        return values[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def joined(words: Words, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of all rows, a space behind each, as one buffer, and the offsets of the rows in it."""
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.starts[keep]] += 1
    inside[words.ends[keep]] -= 1
    mask = np.cumsum(inside).astype(bool)
    # the byte behind a word may be the first of the next row, so lengths are laid out anew
    lengths = (words.ends - words.starts + 1) * keep
    sums = np.concatenate([[0], np.cumsum(lengths)])
    out = np.full(sums[-1], 0x20, np.uint8)
    into = np.ones(sums[-1], bool)
    into[sums[1:][keep] - 1] = False
    out[into] = words.data[mask[:-1]]
    return out.tobytes(), sums[words.first]
