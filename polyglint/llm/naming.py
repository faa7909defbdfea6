"""Integer names for equal keys, without hashing: equal keys get one name, different keys never share one.

Shared by block naming and line naming.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Keys that are named aside because many rows hold them. At most this many are broadcast.
FREQUENT_KEYS = 1000


def named(rows: DataFrame, keys: list[str], name: str, *, frequent: int = FREQUENT_KEYS) -> DataFrame:
    """``rows`` with a bigint column ``name`` in place of the columns ``keys``; nulls are a key of their own.

    Rows are dealt out by the key itself and sorted, and a run of equal keys takes the number of its first row. The
    ``frequent`` commonest keys would make one task large, so they are aggregated instead and joined by broadcast: their
    hashes (counted first, used only to choose the way) are at most ``frequent``, and so are their names but for
    collisions. What is left has at most 1 / ``frequent`` of all rows in a group.

    Names are negative for keys named by broadcast and not negative for the others, so that the two never meet.
    """
    code = "_key_hash"
    hashed = rows.withColumn(code, F.xxhash64(*keys))
    top = hashed.groupBy(code).count().where("count > 1").orderBy(F.desc("count"), code).limit(frequent)
    common = [row[0] for row in top.collect()]
    numbered = hashed.withColumn("_row_number", F.monotonically_increasing_id())
    first = F.min("_row_number")
    is_common = F.col(code).isin(common) if common else F.lit(False)
    rare = numbered.where(~is_common).withColumn(name, first.over(Window.partitionBy(*keys)))
    out = rare.drop(*keys, code, "_row_number")
    if not common:
        return out
    often = numbered.where(is_common)
    names = often.groupBy(*keys).agg((-1 - first).alias(name))
    names = names.select(name, *[F.col(k).alias(f"_{k}") for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    joined = often.join(F.broadcast(names), same).select(*out.columns)
    return out.unionByName(joined)
