"""Repeated runs of lines, by a suffix array over line numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.mixing import words_in
from polyglint.llm.naming import named
from polyglint.llm.storage import saved

#: Lines of the shortest run that counts.
MIN_LINES = 2
#: Words from which a line that repeats alone counts too, where that is asked for.
LONE_WORDS = 5


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _doubled(ranks: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """One round of prefix doubling: ranks of runs that are ``step`` lines longer, and the table of intervals.

    ``ranks``: doc_id, key, pos, rank. A run's new rank is the place of (its rank, the rank ``step`` lines on) among all
    such pairs, sorted: pairs are aggregated, dealt out by range and numbered in order. A pair is an interval of the
    suffix array whose suffixes share so many lines; ``first`` is its earliest suffix. Suffixes alone in their interval
    are in their place already and go no further.
    """
    # suffixes that left earlier leave gaps, so the line that is ``step`` further on is looked up by its number
    on = Window.partitionBy("doc_id", "key").orderBy("pos").rangeBetween(step, step)
    pairs = ranks.withColumn("next", F.max("rank").over(on)).where("next IS NOT NULL")
    place = F.struct("doc_id", "key", "pos")
    intervals = pairs.groupBy("rank", "next").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    intervals = saved(intervals.repartitionByRange("rank", "next").sortWithinPartitions("rank", "next").withColumn("new", F.monotonically_increasing_id()))
    longer = pairs.join(intervals.select("rank", "next", "new", "first"), ["rank", "next"])
    return saved(longer.select("doc_id", "key", "pos", F.col("new").alias("rank"), "first")), intervals


def _first(ranks: DataFrame) -> DataFrame:
    """``ranks`` of lines that stand twice at least, with the earliest place of each. Frequent lines have negative names
    and are few, so they are met by broadcast."""
    first = ranks.groupBy("rank").agg(F.min(F.struct("doc_id", "key", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = saved(first.drop("n"))
    often = ranks.where("rank < 0").join(F.broadcast(first.where("rank < 0")), "rank")
    return ranks.where("rank >= 0").join(first.where("rank >= 0"), "rank").unionByName(often)


def _later(ranks: DataFrame, n_lines: int) -> DataFrame:
    """Where runs of ``n_lines`` lines begin and end that are not the earliest of their rank."""
    later = ranks.where(F.struct("doc_id", "key", "pos") > F.col("first")).select("doc_id", "key", "pos")
    return later.withColumn("end", F.col("pos") + n_lines)


def repeated_runs(docs: DataFrame, *, min_lines: int = MIN_LINES, lone_words: int | None = None) -> DataFrame:
    """(doc_id, key, start, end): the maximal stretches of each document (doc_id, text) that are made of runs of
    ``min_lines`` lines which stand earlier as well, in an earlier document or further up in this one, and with
    ``lone_words`` also of single lines of so many words that do.

    Lines get integer names by their content, once. Then prefix doubling ranks the runs of 2, 4, ... lines that begin
    at each place, up to ``min_lines`` (the last step overlaps where that is no power of two): equal ranks are an
    interval of the suffix array with a common prefix of so many lines. All its suffixes but the earliest begin a later
    copy; copies that touch are one stretch. ``key`` tells texts of one doc_id apart.
    """
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("key"), F.posexplode(_lines(F.col("text"))).alias("pos", "line")
    )
    if lone_words is not None:
        lines = lines.withColumn("long", words_in(F.col("line")) >= lone_words)
    ranks = saved(named(lines, ["line"], "rank"))
    lone = None if lone_words is None else _later(_first(ranks.where("long").drop("long")), 1)
    ranks = ranks.select("doc_id", "key", "pos", "rank")
    if min_lines == 1:
        ranks = _first(ranks)
    length = 1
    while length < min_lines:
        step = min(length, min_lines - length)
        ranks, _ = _doubled(ranks.select("doc_id", "key", "pos", "rank"), step)
        length += step
    later = _later(ranks, min_lines)
    later = later if lone is None else later.unionByName(lone)
    later = later.groupBy("doc_id", "key", "pos").agg(F.max("end").alias("end"))
    by_doc = Window.partitionBy("doc_id", "key").orderBy("pos")
    reach = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("pos") > reach, F.lit(True))
    runs = later.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_doc))
    return runs.groupBy("doc_id", "key", "run").agg(F.min("pos").alias("start"), F.max("end").alias("end")).drop("run")


def without_repeated_runs(docs: DataFrame, *, min_lines: int = MIN_LINES, lone_words: int | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` freed of the later copies of repeated runs of lines (the columns keep their order), and
    ``lines_before`` and ``lines_removed``. With ``lone_words``, later copies of single lines of so many words go too.

    Defined cases: null and empty texts are one empty line, and a null text stays null; a text whose lines all go
    becomes empty, its row stays; a null doc_id is neither earlier nor later than another document; rows that repeat a
    doc_id and a text count as one document and keep the same lines; a longer text only has more lines; other columns
    are carried along, but for ones named lines_before or lines_removed, which are replaced; an empty table gives an
    empty result.
    """
    runs = repeated_runs(docs.select("doc_id", F.col(text).alias("text")), min_lines=min_lines, lone_words=lone_words)
    runs = runs.groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_runs"))
    runs = runs.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), "_runs")
    # the row's own columns stand in a struct, so that their names meet none of these
    own = [c for c in docs.columns if c not in ("lines_before", "lines_removed")]
    rows = docs.select(F.col("doc_id").alias("_at"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"), F.struct(*own).alias("_row"))
    joined = rows.join(runs, (F.col("_at") == F.col("_doc")) & (F.col("_hash") == F.col("_key")), "left")
    found = F.col("_runs")
    gaps = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform(found, lambda r: r["end"])),
        F.concat(F.transform(found, lambda r: r["start"]), F.array(F.size("_lines"))),
        lambda a, b: F.slice(F.col("_lines"), a + 1, b - a),
    )
    removed = F.aggregate(found, F.lit(0), lambda n, r: n + r["end"] - r["start"])
    kept = F.array_join(F.flatten(gaps), "\n")
    done = joined.withColumn("_lines", _lines(F.col("_text"))).withColumn("_kept", F.when(found.isNotNull(), kept).otherwise(F.col("_text")))
    return done.select(
        *[F.col("_kept").alias(text) if c == text else F.col("_row")[c].alias(c) for c in own],
        F.size("_lines").cast("long").alias("lines_before"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("lines_removed"),
    )
