"""Places of rows in ordered groups, and joins on keys, where one group or key may hold most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.storage import saved

#: A group is large if it has more than 1 / LARGE_PART of the rows. Fewer than LARGE_PART groups are.
LARGE_PART = 1000
_INNER = ("_at", "_task", "_low", "_before")


def placed(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the place of each row in its group, from 0. For few groups of any size.

    Rows are dealt out by range and sorted, so that a group lies in successive tasks; each task's part of a group begins
    where the parts before it end. There are no more parts than tasks and groups together, and these are broadcast.
    """
    keys = [*group, *order]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = saved(ordered.withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)))
    parts = at.groupBy("_task", *group).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    parts = parts.select("_low", "_before", F.col("_task").alias("_of_task"), *[F.col(c).alias(f"_of_{c}") for c in group])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group], F.col("_task") == F.col("_of_task"))
    found = at.join(F.broadcast(parts), same).withColumn(name, F.col("_before") + F.col("_at") - F.col("_low"))
    return found.select(*rows.columns, name)


def ranked(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``rows`` (``key`` never null) with ``name``: the place of each row in its group, from 0. For any number of groups;
    those that are large go by ``placed``, the others by a window."""
    large = saved(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("_all")))).where(F.col("_n") * LARGE_PART > F.col("_all")).select(key))
    small = rows.join(F.broadcast(large), key, "left_anti")
    in_order = Window.partitionBy(key).orderBy(*order)
    small = small.withColumn(name, (F.row_number().over(in_order) - 1).cast("long"))
    often = placed(rows.join(F.broadcast(large), key).select(rows.columns), [key], order, name)
    return small.unionByName(often)


def met(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` joined with ``facts``, which has one row for a key and in ``n`` how many of ``total`` rows have it. Large
    keys are met by broadcast, so that no task gets all rows of one."""
    large, small = facts.where(F.col(n) * LARGE_PART > total), facts.where(F.col(n) * LARGE_PART <= total)
    often = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(small, keys)
    return often.unionByName(rest)
