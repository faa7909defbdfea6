"""Shards of equal numbers of rows by balanced label propagation over linked documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.llm.placing import LARGE_PART, met, placed
from polyglint.llm.storage import saved

N_SHARDS = 8
#: Most rounds of label propagation.
ROUNDS = 16
#: A shard with less than 1 / LEAST_ROOM of its quota left draws nobody; unlinked documents fill it in the end.
LEAST_ROOM = 20


def quotas(total: int, n_shards: int) -> list[int]:
    """Rows of each shard: as equal as they can be."""
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def _votes(members: DataFrame, n_shards: int, total: int) -> DataFrame:
    """(id, by, shard, nodes, low, most, votes): for each linked document how many members of its nodes are in each shard.

    ``members``: id, by, shard, nodes. Members are counted by node and shard first, so that a node of any size sends
    one row, and meets its members by broadcast if it is large."""
    each = members.select("id", "by", "shard", F.explode("nodes").alias("node"))
    counts = [F.count_if(F.col("shard") == s) for s in range(n_shards)]
    of_node = saved(each.groupBy("node").agg(F.array(*counts).alias("votes"), F.count(F.lit(1)).alias("n")))
    heard = met(each, of_node, ["node"], "n", total)
    sums = F.array(*[F.sum(F.col("votes")[s]) for s in range(n_shards)])
    own = [F.collect_list("node").alias("nodes"), F.min("node").alias("low"), F.max("n").alias("most"), sums.alias("votes")]
    summed = heard.groupBy("id", "by", "shard").agg(*own)
    # a document is in all its nodes, but has one vote
    once = F.transform("votes", lambda v, s: F.when(s == F.col("shard"), v - F.size("nodes") + 1).otherwise(v))
    return summed.withColumn("votes", once)


def _favourite(open_shards: list[int]) -> Column:
    """The open shard, or the own one, with most votes; ties are broken alike for all members of a node."""
    def option(s):
        return F.struct(F.col("votes")[s].alias("votes"), F.xxhash64(F.col("low"), s).alias("tie"), s.alias("shard"))

    own = F.array(option(F.col("shard")))
    others = F.array(*[option(F.lit(s)) for s in open_shards]) if open_shards else own
    return F.array_max(F.concat(own, others))["shard"]


def _unit(*columns) -> Column:
    """A number from 0 to 1 that follows from the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def _shares(flow: dict, room: list[int], exchange: bool) -> list[float]:
    """For each pair of shards, the part of those who want to go from one to the other that may."""
    n = len(room)
    coming = [sum(flow.get((s, t), 0) for s in range(n)) for t in range(n)]
    allowed = lambda s, t: min(flow.get((s, t), 0), flow.get((t, s), 0)) / flow.get((s, t), 1) if exchange else min(1.0, room[t] / max(1, coming[t]))
    return [allowed(s, t) for s in range(n) for t in range(n)]


def propagated(members: DataFrame, room_of: list[int], *, rounds: int, total: int) -> DataFrame:
    """(id, by, shard, low, votes) after label propagation of ``members`` (id, by, shard, nodes).

    In a round each document wants the shard that holds most of its neighbours. In every other one it looks at shards
    with room only, and as many go as there is room for; in those between, at all shards, and as many go from one to
    another as come the other way. Where more want to, a part of the nodes (of a large node, of its members), taken by a
    hash, goes. It ends when nobody could move in two rounds.
    """
    n_shards, idle = len(room_of), 0
    for turn in range(rounds + 1):
        heard = saved(_votes(members, n_shards, total))
        held = {r["shard"]: r["n"] for r in heard.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        room = [max(0, most - held.get(s, 0)) for s, most in enumerate(room_of)]
        exchange = turn % 2 == 1
        wants = heard.withColumn("to", _favourite([s for s in range(n_shards) if exchange or room[s] * LEAST_ROOM >= max(room_of[s], LEAST_ROOM)]))
        moves = wants.where("to <> shard").groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n"))
        shares = _shares(flow := {(r["shard"], r["to"]): r["n"] for r in moves.collect()}, room, exchange)
        idle = 0 if any(shares[s * n_shards + t] for s, t in flow) else idle + 1
        if turn == rounds or idle == 2:
            break
        share = F.element_at(F.array(*map(F.lit, shares)), F.col("shard") * n_shards + F.col("to") + 1)
        one = F.when(F.col("most") * LARGE_PART > total, _unit("id", F.lit(turn))).otherwise(_unit("low", F.lit(turn)))
        members = wants.select("id", "by", F.when(one < share, F.col("to")).otherwise(F.col("shard")).alias("shard"), "nodes")
    return heard.select("id", "by", "shard", "low", "votes")


def balanced_shards(rows: DataFrame, links: DataFrame, *, n_shards: int = N_SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(id, shard, slot) for each of ``rows`` (id, by): shards 0 to n_shards - 1 whose numbers of rows are at most one
    apart, with linked documents together where that goes; slots count from 0 in each shard.

    ``links`` (id, node): documents with a node in common are linked, so a group of any size costs its members, never
    its pairs. ``id`` is unique and stable; ``by`` orders rows and gives the first shards, ties going by id.

    1. Linked documents start in a shard by hash and move by ``propagated`` under the quotas.
    2. Where a hash let more in than the quota, the documents with the fewest neighbours there leave.
    3. These and the unlinked documents, in an order that keeps nodes together, fill every shard up to its quota.

    Places are counted by range, so no task holds a shard. Defined cases: a null node links nothing; links to ids that
    are not in rows do not count; repeated links count once; without links, rows are dealt out in their order; an empty
    table gives an empty result.
    """
    rows = rows.select("id", "by")
    total = rows.count()
    quota = quotas(total, n_shards)
    links = links.where("node IS NOT NULL").select("id", "node").distinct()
    shared = saved(links.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    tied = met(links, shared, ["node"], "n", total).groupBy("id").agg(F.collect_list("node").alias("nodes"))
    start = F.pmod(F.xxhash64("by", F.lit(0)), F.lit(n_shards)).cast("int")
    members = saved(rows.join(tied, "id").select("id", "by", start.alias("shard"), "nodes"))
    moved = saved(propagated(members, quota, rounds=rounds, total=total))

    held = {r["shard"]: r["n"] for r in moved.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    excess = {s: held.get(s, 0) - quota[s] for s in range(n_shards) if held.get(s, 0) > quota[s]}
    columns = ["id", "by", "shard", "low"]
    stay, leave = moved.select(columns), moved.select(columns).limit(0)
    if excess:
        full = moved.where(F.col("shard").isin(*excess)).withColumn("near", F.col("votes")[F.col("shard")])
        ordered = placed(full.select(*columns, "near"), ["shard"], ["near", "low", "by", "id"], "place")
        goes = F.col("place") < reduce(lambda w, s: w.when(F.col("shard") == s, excess[s]), excess, F.when(F.lit(False), 0))
        leave = ordered.where(goes).select(columns)
        stay = stay.where(~F.col("shard").isin(*excess)).unionByName(ordered.where(~goes).select(columns))
    free = rows.join(members.select("id"), "id", "left_anti").withColumn("low", F.lit(None).cast(dict(moved.dtypes)["low"]))
    free = free.unionByName(leave.drop("shard")).withColumn("of", F.lit(0))
    queue = placed(saved(free), ["of"], ["low", "by", "id"], "place")
    deal, upto = F.when(F.lit(False), 0), 0
    for s in range(n_shards):
        upto += quota[s] - min(held.get(s, 0), quota[s])
        deal = deal.when(F.col("place") < upto, s)
    every = stay.select("id", "by", "shard").unionByName(queue.select("id", "by", deal.alias("shard")))
    return placed(saved(every), ["shard"], ["by", "id"], "slot").select("id", "shard", "slot")


def sharded(docs: DataFrame, *, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes and one), text_crc32, shard, slot, by
    ``balanced_shards`` with equal texts linked.

    Defined cases: a null text is an empty one; a null doc_id comes before all others; rows that repeat are rows of their
    own, linked with each other; any length; other columns are not looked at; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("id"),
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("node"),
    )
    rows = saved(rows)
    placed_rows = balanced_shards(rows.select("id", F.col("doc_id").alias("by")), rows.select("id", "node"), n_shards=n_shards)
    return rows.join(placed_rows, "id").select("doc_id", "size", "text_crc32", "shard", "slot")
