"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyglint.llm.storage import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node reachable.

    Each round hangs every node's larger neighbours on its smallest one, then the smallest neighbour on all others, until
    each component is a star around its least node. Rounds grow with the logarithm of the component's size; a round is
    aggregations and joins on nodes, and no component is ever in one place. Links of a node to itself, repeated links and
    nulls do not matter.
    """
    edges = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low")))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        low = saved(small_low)
        large = saved(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        after = saved(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        if after.count() == edges.count() and after.exceptAll(edges).isEmpty():
            break
        edges = after
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
