"""Phrase collocations, by multikey three-way quicksort of suffix pointers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.storage import saved
from polyglint.llm.words import Prefix, chunks, mixed, text_bytes

#: Words of the shortest and of the longest phrase; the longest is the depth to which suffixes are sorted.
SHORTEST, LONGEST = 2, 5
#: Occurrences from which a phrase is a candidate.
LEAST = 100
#: Phrases returned for each language.
TOP = 2000
#: The language of rows without one.
NO_LANG = "und"
#: Bits of a filter of frequent words or pairs. It bounds what is broadcast (2^FILTER_BITS / 8 bytes); when it fills up,
#: more suffixes are sorted, and nothing else changes.
FILTER_BITS = 26
#: Suffixes that one task sorts. Leading pairs of more occurrences are dealt out by the whole suffix.
TASK_SUFFIXES = 1 << 20
#: Parts for each task that sorts, so that tasks get about as much.
PARTS_OF_TASK = 4
#: Bytes of text that are worked on at once, and suffixes that a task puts together before they are moved.
_CHUNK, _HELD = 1 << 20, 1 << 20

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


class Bits(NamedTuple):
    """Which 64-bit codes are in a set, by their first FILTER_BITS bits: it may say yes of others, never no of its own."""

    cells: np.ndarray

    def has(self, codes: np.ndarray) -> np.ndarray:
        at = codes >> np.uint64(64 - FILTER_BITS)
        return (self.cells[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _bits(codes: DataFrame) -> Bits:
    """The filter of ``codes`` (code long). Cells are put together on the executors; at most 2^(FILTER_BITS - 6) come here."""
    at = F.shiftrightunsigned("code", 64 - FILTER_BITS)
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    rows = codes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    cells = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    cells[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().astype(np.int64).view(np.uint64)
    return Bits(cells)


class Tokens(NamedTuple):
    """Words of a batch: bytes in ``data`` (A to Z lowered), their codes, the row each is in, whether the next word goes
    on in the same piece, and where asked for a second code, which tells words of one code apart."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    codes: np.ndarray
    goes_on: np.ndarray
    second: np.ndarray | None


def _tokens(langs: pa.Array | pa.DictionaryArray, texts: pa.Array, seed: int, *, checked: bool = False) -> Tokens:
    raw, offsets = text_bytes(texts)
    data = _LOWER[raw]
    apart = _APART[data]
    begin, end = ~apart, ~apart
    begin[1:] &= apart[:-1]
    end[:-1] &= apart[1:]
    filled = offsets[:-1] < offsets[1:]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[heads], end[tails] = ~apart[heads], ~apart[tails]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.cumsum(_BREAK[data])[starts] if len(starts) else np.zeros(0, np.int64)
    goes_on = np.zeros(len(starts), bool)
    goes_on[:-1] = (rows[1:] == rows[:-1]) & (breaks[1:] == breaks[:-1])
    # the language is part of a word's code, so that languages never meet
    names = langs if isinstance(langs, pa.DictionaryArray) else langs.dictionary_encode()
    spelled_names = [bytes(x, "utf-8") for x in names.dictionary.to_pylist()]
    edges = np.cumsum([0, *map(len, spelled_names)])
    of_row = names.indices.to_numpy()

    def coded(salt: int) -> np.ndarray:
        values = mixed(np.arange(256, dtype=np.uint64), salt)
        salts = Prefix(values[np.frombuffer(b"".join(spelled_names), np.uint8)]).ranges(edges[:-1], edges[1:], salt + 1)
        return mixed(Prefix(values[data]).ranges(starts, ends, salt) * np.uint64(3) + salts[of_row[rows]], salt)

    # 0 marks the end of a suffix
    return Tokens(data, starts, ends, rows, np.maximum(coded(2 * seed), np.uint64(1)), goes_on, coded(2 * seed + 1) if checked else None)


def _langs(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column("lang"), NO_LANG)


def _distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of one row of each kind, over rows that are equal in all columns, and the kind of every row."""
    codes = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        codes = mixed(codes + c)
    _, first, kind = np.unique(codes, return_index=True, return_inverse=True)
    if all((c[first][kind] == c).all() for c in columns):
        return first, kind
    return np.arange(len(codes)), np.arange(len(codes))  # two kinds with one code: put together later


def _counted(seed: int):
    """(lang, code, times) of each batch: a row for each word with its code, and one for each language without a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _CHUNK):
            langs = _langs(batch).dictionary_encode()
            t = _tokens(langs, batch.column("text"), seed)
            codes, times = np.unique(t.codes, return_counts=True)
            n = np.bincount(langs.indices.to_numpy()[t.rows], minlength=len(langs.dictionary))
            none = pa.nulls(len(n), pa.int64())
            arrays = [
                pa.concat_arrays([pa.nulls(len(codes), pa.string()), langs.dictionary.cast(pa.string())]),
                pa.concat_arrays([pa.array(codes.view(np.int64)), none]),
                pa.array(np.concatenate([times, n]).astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "code", "times"])

    return run


def _named(seed: int, frequent):
    """(code, lang, word) of the frequent words of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _CHUNK):
            langs = _langs(batch)
            t = _tokens(langs, batch.column("text"), seed, checked=True)
            often = np.flatnonzero(frequent.value.has(t.codes))
            first = often[_distinct([t.codes[often], t.second[often]])[0]]
            buffer = t.data.tobytes()
            words = [buffer[a:b].decode() for a, b in zip(t.starts[first].tolist(), t.ends[first].tolist(), strict=True)]
            arrays = [pa.array(t.codes[first].view(np.int64)), langs.take(pa.array(t.rows[first])), pa.array(words, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["code", "lang", "word"])

    return run


def _pair_codes(t: Tokens) -> np.ndarray:
    """A code for each word and the one behind it."""
    behind = np.zeros(len(t.codes), np.uint64)
    behind[:-1] = t.codes[1:]
    return _pair_code(t.codes, behind)


def _pair_code(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mixed(one * np.uint64(3) + mixed(two, 3), 3)


def _pairs(seed: int, frequent):
    """(code, times) of the pairs of frequent words of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", _CHUNK):
            t = _tokens(_langs(batch), batch.column("text"), seed)
            often = frequent.value.has(t.codes)
            joined = t.goes_on.copy()
            joined[:-1] &= often[:-1] & often[1:]
            codes, times = np.unique(_pair_codes(t)[joined], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(times.astype(np.int64))], ["code", "times"])

    return run


_SUFFIX = [f"w{i}" for i in range(1, LONGEST + 1)]


def _suffixes(seed: int, frequent, pairs, crowded, parts: int):
    """The suffixes that begin with a frequent pair, each cut where a pair is not frequent: w1 to w5 (0 behind the end),
    times, split. Equal ones are put together over so many batches as a task can hold, and travel in blocks: a row is a
    task's suffixes for one of ``parts``, as lists. The part follows from the leading pair, or from the whole suffix where
    so many begin with the pair that they are split."""

    def columns_of(t: Tokens) -> list[np.ndarray]:
        joined = t.goes_on & frequent.value.has(t.codes)
        joined[joined] = pairs.value.has(_pair_codes(t)[joined])
        at = np.flatnonzero(joined)
        columns, alive = [t.codes[at]], np.ones(len(at), bool)
        for i in range(1, LONGEST):
            alive &= joined[np.minimum(at + i - 1, len(joined) - 1)]
            columns.append(np.where(alive, t.codes[np.minimum(at + i, len(joined) - 1)], np.uint64(0)))
        return [*columns, np.ones(len(at), np.int64)]

    def merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
        *columns, times = (np.concatenate(c) for c in zip(*parts, strict=True))
        first, kind = _distinct(columns)
        return [*(c[first] for c in columns), np.bincount(kind, times, len(first)).astype(np.int64)]

    def blocks(columns: list[np.ndarray]) -> pa.RecordBatch:
        *words, _ = columns
        pair = _pair_code(words[0], words[1])
        split, whole = crowded.value.has(pair), words[0]
        for c in words[1:]:
            whole = mixed(whole + c)
        part = (np.where(split, whole, pair) % np.uint64(parts)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        heads = np.flatnonzero(np.diff(part[order], prepend=-1))
        offsets = pa.array(np.append(heads, len(order)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c[order].view(np.int64))) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array(part[order][heads]), *lists, pa.ListArray.from_arrays(offsets, pa.array(split[order]))], ["part", *_SUFFIX, "times", "split"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in chunks(batches, "text", _CHUNK):
            held.append(merged([columns_of(_tokens(_langs(batch), batch.column("text"), seed))]))
            if sum(len(c[0]) for c in held) > _HELD:
                held = [merged(held)]
                if len(held[0][0]) > _HELD // 2:
                    yield blocks(held.pop())
        if held:
            yield blocks(merged(held))

    return run


def equal_parts(words: np.ndarray, times: np.ndarray, split: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multikey three-way quicksort of pointers to rows of ``words`` (columns are depths, 0 is an end), all parts of a
    round at once. Returns (pointer, depth, occurrences) of the equal parts of SHORTEST words or more.

    A part is split by a word of its own at its depth into those before, equal and behind; the equal part goes one word
    deeper. Parts with fewer than ``least`` occurrences are abandoned, unless they are ``split``: those may go on in
    other tasks.
    """
    pointers = np.flatnonzero(words[:, 0] != 0)
    starts, depths = np.zeros(int(len(pointers) > 0), np.int64), np.zeros(int(len(pointers) > 0), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(pointers):
        sizes = np.diff(np.append(starts, len(pointers)))
        part = np.repeat(np.arange(len(starts)), sizes)
        value = words[pointers, depths[part]]
        pivot = value[starts + sizes // 2][part]
        side = (value >= pivot).astype(np.int8) + (value > pivot)
        counts = np.bincount(part * 3 + side, minlength=3 * len(starts))
        begin = np.cumsum(counts) - counts
        moved = np.empty_like(pointers)
        for s in range(3):
            own = counts[s::3]
            to = np.repeat(begin[s::3] - (np.cumsum(own) - own), own)
            moved[np.arange(len(to)) + to] = pointers[side == s]
        real = counts > 0
        begin, counts, depth, equal = begin[real], counts[real], np.repeat(depths, 3)[real], np.tile(np.arange(3) == 1, len(starts))[real]
        depth = depth + equal
        total = np.add.reduceat(times[moved], begin)
        stays = (total >= least) | np.logical_or.reduceat(split[moved], begin)
        told = stays & equal & (depth >= SHORTEST)
        found.append((moved[begin[told]], depth[told], total[told]))
        stays &= depth < words.shape[1]
        keep = np.repeat(stays, counts)
        part = np.repeat(np.arange(len(begin)), counts)[keep]
        pointers = moved[keep]
        open_ = words[pointers, depth[part]] != 0
        pointers, part = pointers[open_], part[open_]
        heads = np.flatnonzero(np.diff(part, prepend=-1))
        starts, depths = heads, depth[part[heads]] if len(heads) else heads
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _sorted(least: int):
    """Counts of the phrases of a task's suffixes: (phrase, times)."""

    def flat(table: pa.Table, column: str) -> np.ndarray:
        return table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = [b for b in batches if b.num_rows]
        if not filled:
            return
        table = pa.Table.from_batches(filled)
        words, times, split = np.column_stack([flat(table, c).view(np.uint64) for c in _SUFFIX]), flat(table, "times"), flat(table, "split")
        at, depth, total = equal_parts(words, times, split, least)
        inside = np.arange(words.shape[1]) < depth[:, None]
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(depth)]).astype(np.int32), words[at][inside].view(np.int64))
        yield pa.RecordBatch.from_arrays([lists, pa.array(total.astype(np.int64))], ["phrase", "times"])

    return run


class WordCounts(NamedTuple):
    """(code, lang, word, times) of the words that stand often enough, the words of each language (lang, n), and the
    seed with which no two of the former have one code."""

    words: DataFrame
    totals: DataFrame
    seed: int
    frequent: object


def word_counts(docs: DataFrame, *, least: int) -> WordCounts:
    seed = 0
    while True:
        each = docs.mapInArrow(_counted(seed), "lang string, code long, times long")
        counts = saved(each.groupBy("lang", "code").agg(F.sum("times").alias("times")).where((F.col("times") >= least) | F.col("code").isNull()))
        often = counts.where("code IS NOT NULL").select("code", "times")
        frequent = docs.sparkSession.sparkContext.broadcast(_bits(often))
        name = F.struct("lang", "word")
        named = docs.mapInArrow(_named(seed, frequent), "code long, lang string, word string").groupBy("code").agg(F.min(name).alias("low"), F.max(name).alias("high"))
        words = saved(often.join(named, "code"))
        if words.where("low <> high").isEmpty():
            totals = saved(counts.where("code IS NULL AND times > 0").select("lang", F.col("times").alias("n")))
            return WordCounts(words.select("code", "low.lang", "low.word", "times"), totals, seed, frequent)
        seed += 1


def phrase_counts(docs: DataFrame, counts: WordCounts, *, least: int) -> DataFrame:
    """(phrase, times): phrases of SHORTEST to LONGEST words, as arrays of codes, that stand ``least`` times or more in
    ``docs`` (lang, text)."""
    spark = docs.sparkSession
    shared, seed, frequent = spark.sparkContext.broadcast, counts.seed, counts.frequent
    pairs = docs.mapInArrow(_pairs(seed, frequent), "code long, times long").groupBy("code").agg(F.sum("times").alias("times"))
    pairs = saved(pairs.where(F.col("times") >= least))
    total = pairs.agg(F.sum("times")).first()[0] or 0
    common, crowded = shared(_bits(pairs)), shared(_bits(pairs.where(F.col("times") >= TASK_SUFFIXES)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_SUFFIXES))
    schema = ", ".join(["part int", *(f"{c} array<long>" for c in [*_SUFFIX, "times"]), "split array<boolean>"])
    suffixes = docs.mapInArrow(_suffixes(seed, frequent, common, crowded, PARTS_OF_TASK * tasks), schema)
    sorted_ = suffixes.repartition(tasks, "part").mapInArrow(_sorted(least), "phrase array<long>, times long")
    return saved(sorted_.groupBy("phrase").agg(F.sum("times").alias("times")).where(F.col("times") >= least))


def scored(phrases: DataFrame, ones: DataFrame, totals: DataFrame) -> DataFrame:
    """``phrases`` (phrase, times) with lang, n, and l, r, score of the cut that scores least (the first of such).
    ``ones``: (code, lang, times) of words; ``totals``: (lang, n)."""
    every = saved(phrases.unionByName(ones.select(F.array("code").alias("phrase"), "times")))
    size = F.size("phrase")
    cuts = phrases.select("phrase", F.col("times").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("phrase", F.lit(1), F.col("k"))).withColumn("right", F.slice("phrase", F.col("k") + 1, size))
    left = every.select(F.col("phrase").alias("left"), F.col("times").alias("l"))
    right = every.select(F.col("phrase").alias("right"), F.col("times").alias("r"))
    of = ones.select(F.col("code").alias("_code"), "lang")
    known = phrases.select("phrase", F.element_at("phrase", 1).alias("_code")).join(of, "_code").join(F.broadcast(totals), "lang").select("phrase", "lang", "n")
    each = cuts.join(left, "left").join(right, "right").join(known, "phrase")
    score = F.expr("cast((1000 * cast(a AS decimal(20,0)) * cast(n AS decimal(20,0))) div (cast(l AS decimal(20,0)) * cast(r AS decimal(20,0))) AS bigint)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best")
    return each.groupBy("phrase", "lang", "a", "n").agg(best).select("phrase", "lang", "a", "best.l", "best.r", "n", "best.score")


def not_inside(phrases: DataFrame) -> DataFrame:
    """``phrases`` (phrase, times) but for those that lie in a longer one which stands as often."""
    size = F.size("phrase")
    lengths = F.sequence(F.lit(SHORTEST), size - 1)
    parts = F.flatten(F.transform(lengths, lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.slice("phrase", i, n))))
    inner = phrases.where(size > SHORTEST).select(F.explode(parts).alias("phrase"), F.col("times").alias("longer"))
    most = inner.groupBy("phrase").agg(F.max("longer").alias("longer"))
    return phrases.join(most, "phrase", "left").where(F.coalesce(F.col("longer") < F.col("times"), F.lit(True))).drop("longer")


def spelled(phrases: DataFrame, ones: DataFrame) -> DataFrame:
    """``phrases`` with the codes of ``phrase`` put as words (``ones``: code, word), joined by a space."""
    codes = phrases.select("phrase", F.posexplode("phrase").alias("i", "code")).join(ones.select("code", "word"), "code")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ")
    return phrases.join(codes.groupBy("phrase").agg(text.alias("_text")), "phrase").withColumn("phrase", F.col("_text")).drop("_text")


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The best phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Texts (A to Z lowered) are cut into pieces at ``. , ; : ! ?`` and line breaks and those into words at blanks. A
    phrase of SHORTEST to LONGEST words in a piece that stands ``least`` times is a candidate; its score is the least of
    floor(1000 a n / (l r)) over its cuts in two. Candidates inside a longer one that stands as often are left out.

    1. Words are counted by a code of 64 bits; another seed is taken if two words, one of them frequent, have the same.
    2. Pairs of frequent words are counted. What is frequent goes to the tasks as filters of 2^FILTER_BITS bits.
    3. Suffixes of up to LONGEST words that begin with a frequent pair are aggregated where they are read, and dealt out
       by their leading pair; a pair of TASK_SUFFIXES occurrences or more is dealt out by the whole suffix.
    4. Each task sorts its suffix pointers by multikey three-way quicksort. The sizes of equal parts are the counts;
       parts below ``least`` are abandoned at once. Counts of pairs that were dealt out are added up.

    Defined cases: a null text is empty, a null lang is NO_LANG (and meets a language of that name); any length; rows
    that repeat count each time; phrases that tie in score and occurrences are in byte order; other columns are not
    looked at; an empty table gives an empty result.
    """
    texts = docs.select("lang", "text")
    counts = word_counts(texts, least=least)
    ones, totals = counts.words, counts.totals
    phrases = phrase_counts(texts, counts, least=least)
    kept = not_inside(phrases).select("phrase")
    best = spelled(scored(phrases, ones, totals).join(kept, "phrase", "left_semi"), ones)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
