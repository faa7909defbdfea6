"""Mixing sources to target weights with a curriculum: weights that change over training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Digits of the order key that name a slice of a source. Running sums are taken in a slice and over the slices.
SLICE_DIGITS = 3
_INNER = ("_key", "_slice", "_in_slice", "_source", "_of", "_before", "_plan", "_within", "_at")


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` (source, source_size) with ``rank`` from 0 by code point, null last. A row per source, so few rows."""
    return sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def targets(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """``sources`` (source, source_size, weight) with ``target``: parts by weight of ``share`` times all
    words, none above ``repeats`` times its source, the excess shared again by weight.

    The fixed point of that sharing is min(cap, weight * level). Sources are sorted by cap / weight; those below the
    level are full, and the level is what they leave, per weight left.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("rank"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = (
        sources.withColumn("total", share * F.sum("source_size").over(everything))
        .withColumn("cap", repeats * F.col("source_size"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
    )
    open_ = F.col("cap") >= F.col("weight") * F.col("level")
    level = F.min(F.when(open_, F.struct(F.col("cap") / F.col("weight"), F.col("rank"), F.col("level").alias("level")))).over(everything)
    return (
        levels.withColumn("level", level["level"])
        .withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap").cast("double"))))
        .drop("total", "cap", "level")
    )


def curriculum(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The training stream: a row per time a document is used, range-sorted by ``position``.

    ``docs``: doc_id, source, size (words) and whatever else is to be carried. ``plan``: a row per source with
    ``target`` (words, at most a whole number of times its size), and the weight schedule of the source, linear from
    ``w_start`` at time 0 to ``w_end`` at time 1.

    The integral of the schedule up to time t, over the integral up to 1, is the part of the target demanded by then.
    A source's documents stand in the order of md5(doc_id); each use demands the words from its running sum on, and the
    time at which half of them are demanded, found by inverting the integral, is its position. So at any time the
    sources stand to each other as their schedules say. The last use of a source may be cut (``take`` < size) so that
    its words meet floor(target).

    Running sums: a source is cut into slices by the first digits of the key; slices are summed, their sums
    accumulated per source (a few thousand rows), and each slice accumulates its own rows. No task holds a source.

    Adds: epoch (0, 1, ...), take, position in [0, 1], source_size, target; columns of these names are replaced. Ties in md5 are in the order of doc_id; rows that repeat a
    doc_id are ordered by size. A null source is a source of its own, a null doc_id has its own key. Documents without
    words are never taken and so are not in the stream.
    """
    docs = docs.drop("epoch", "take", "position", "source_size", "target", "w_start", "w_end", *_INNER)
    key = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.withColumn("_key", key).withColumn("_slice", F.substring("_key", 1, SLICE_DIGITS))
    slices = keyed.groupBy("source", "_slice").agg(F.sum("size").alias("_in_slice"))
    by_slice = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        F.col("source").alias("_source"), F.col("_slice").alias("_of"), F.coalesce(F.sum("_in_slice").over(by_slice), F.lit(0)).alias("_before")
    )
    starts = starts.join(plan.select(F.col("source").alias("_plan"), "source_size", "target", "w_start", "w_end"), F.col("_source").eqNullSafe(F.col("_plan"))).drop("_plan")
    in_slice = Window.partitionBy("source", "_slice").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.withColumn("_within", F.coalesce(F.sum("size").over(in_slice), F.lit(0)))
    placed = summed.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_slice") == F.col("_of")))
    wanted = F.floor("target").cast("long")
    last_epoch = F.greatest(F.lit(0), F.ceil(wanted / F.col("source_size")).cast("int") - 1)
    uses = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), last_epoch)))
    uses = uses.withColumn("_at", F.col("epoch") * F.col("source_size") + F.col("_before") + F.col("_within"))
    uses = uses.withColumn("take", F.least(F.col("size"), wanted - F.col("_at"))).where("take > 0")
    part = (F.col("_at") + F.col("take") / 2) / F.col("target")
    stream = uses.withColumn("position", _invert(part, F.col("w_start"), F.col("w_end")))
    stream = stream.select(*docs.columns, "epoch", "take", "position", "source_size", "target")
    return stream.repartitionByRange("position").sortWithinPartitions("position", "doc_id", "epoch")


def _invert(part: Column, start: Column, end: Column) -> Column:
    """The time at which the integral of a weight that goes from ``start`` to ``end`` has come to ``part`` of its whole.

    start * t + (end - start) * t^2 / 2 = part * (start + end) / 2, solved without cancellation.
    """
    area = part * (start + end)
    return area / (start + F.sqrt(start * start + (end - start) * area))
