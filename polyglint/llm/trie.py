"""The trie of the beginnings of conversations, rolled up in bands of depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.placing import met, ranked
from polyglint.llm.storage import saved

#: Depths of a band. A node explodes to its ancestors in its band, so to at most so many.
HEIGHT = 16
#: Turns whose running hash is taken at once.
_BLOCK = 1024
#: Conversations whose ids differ in their last two digits share beginnings of up to MOST_SHARED turns.
FAMILY, SHARED_KINDS = 100, 6
_NODE = ["depth", "p1", "p2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, t1, t2, chars) of ``conversations`` (conv_id, turn, role, text): each turn with its place and 128
    bits of hash of its role and text."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    told = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", *[F.xxhash64(F.lit(i), role, text).alias(f"t{i}") for i in (1, 2)], F.char_length(text).cast("long").alias("chars")
    )
    return ranked(saved(told), "conv_id", ["turn", "t1", "t2"], "pos").drop("turn")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED_KINDS


def rebuilt(own: DataFrame) -> DataFrame:
    """(conv_id, depth, t1, t2, chars): the conversations of ``turns``, where the first h turns of conversation
    conv_id - conv_id % FAMILY stand for the first h of each. Conversations that keep no turn are not in it."""
    h = shared_turns(F.col("conv_id"))
    convs = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"))
    heads = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < SHARED_KINDS - 1)).withColumnRenamed("conv_id", "base")
    heads = saved(heads)
    taken = convs.join(heads, "base").where("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "t1", "t2", "chars")
    # where the first conversation is short or missing, what follows moves up
    n_heads = heads.groupBy("base").agg(F.count(F.lit(1)).alias("n"))
    gaps = convs.join(n_heads, "base", "left").select("conv_id", (F.col("h") - F.coalesce("n", F.lit(0))).alias("gap")).where("gap > 0")
    rest = own.where(F.col("pos") >= h).join(gaps, "conv_id", "left")
    rest = rest.select("conv_id", (F.col("pos") + 1 - F.coalesce("gap", F.lit(0))).alias("depth"), "t1", "t2", "chars")
    return taken.unionByName(rest)


def beginnings(turns_: DataFrame) -> DataFrame:
    """``rebuilt`` turns as the nodes they end in: (conv_id, depth, p1, p2, q1, q2, chars). p1 and p2 are 128 bits that
    tell a sequence of turns (each turn's hash with its depth, put together by exclusive or), q1 and q2 those of the
    sequence without its last turn.

    Running hashes are taken in blocks of depths and over the blocks, so that no task holds a long conversation.
    """
    each = [F.xxhash64(F.lit(i), "depth", "t1", "t2").alias(f"x{i}") for i in (1, 2)]
    rows = saved(turns_.select("conv_id", "depth", ((F.col("depth") - 1) / F.lit(_BLOCK)).cast("long").alias("block"), *each, "chars"))
    upto = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = rows.select("*", *[F.bit_xor(f"x{i}").over(upto).alias(f"p{i}") for i in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("conv_id", "block").agg(*[F.bit_xor(f"x{i}").alias(f"b{i}") for i in (1, 2)])
    blocks = blocks.select("conv_id", "block", *[F.bit_xor(f"b{i}").over(before).alias(f"b{i}") for i in (1, 2)]).where("block > 0")
    later = inside.where("block > 0").join(blocks, ["conv_id", "block"])
    later = later.select(*rows.columns, *[F.col(f"p{i}").bitwiseXOR(F.col(f"b{i}")).alias(f"p{i}") for i in (1, 2)])
    parents = [F.col(f"p{i}").bitwiseXOR(F.col(f"x{i}")).alias(f"q{i}") for i in (1, 2)]
    return inside.where("block = 0").unionByName(later).select("conv_id", *_NODE, *parents, "chars")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, of rows sorted by node and id. A node's text is never whole in
    memory; the digest goes on over batches."""
    node, sha = None, None
    for batch in batches:
        keys = np.column_stack([batch.column(c).to_numpy() for c in _NODE])
        ids = batch.column("conv_id").to_pylist()
        heads = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        done = []
        for a, b in zip([0, *heads], [*heads, len(ids)], strict=True):
            if a == b:
                continue
            text = ",".join(map(str, ids[a:b])).encode()
            if node is not None and tuple(keys[a]) == node:
                sha.update(b"," + text)
                continue
            if node is not None:
                done.append((*node, sha.hexdigest()))
            node, sha = tuple(keys[a]), hashlib.sha256(text)
        yield _rows(done)
    if node is not None:
        yield _rows([(*node, sha.hexdigest())])


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) if done else [[]] * 4
    return pa.RecordBatch.from_arrays([*(pa.array([int(x) for x in c], pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], [*_NODE, "ends_sha256"])


def _within(nodes: DataFrame, paths: DataFrame, height: int, sums: list[str]) -> DataFrame:
    """For each node, the sums over those of ``nodes`` that are below it in its band, itself included, and the smallest
    conv_id, which is its own. A conversation has at most ``height`` rows of a band on either side of the join."""
    band = lambda df: df.withColumn("band", F.floor(F.col("depth") / height))
    below = band(nodes).select("conv_id", "band", F.col("depth").alias("_depth"), *sums)
    each = below.join(band(paths), ["conv_id", "band"]).where("depth <= _depth")
    return each.groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])


def rolled_up(nodes: DataFrame, paths: DataFrame, sums: list[str], *, height: int = HEIGHT) -> DataFrame:
    """(depth, p1, p2, conv_id) and each of ``sums`` added over the node's subtree.

    ``nodes``: a row for each node: depth, p1, p2, conv_id (its smallest member), and the sums' own values. ``paths``:
    (conv_id, depth, p1, p2), the nodes on the way of each conversation, the root included.

    1. Each node explodes to its ancestors in its band of ``height`` depths, which gives every node the sum of its
       subtree as far as the band goes.
    2. The roots of bands with these sums are a trie of their own, ``height`` times less deep, and are rolled up in the
       same way.
    3. The totals of the band roots go to the nodes of the band above them that lead there.

    So there are as many rounds as the depth has digits to the base ``height``, and no node explodes to more than
    ``height`` ancestors in one of them.
    """
    part = saved(_within(nodes, paths, height, sums))
    if (part.agg(F.max("depth")).first()[0] or 0) < height:
        return part
    higher = (F.col("depth") / height).cast("long").alias("depth")
    at_root = F.col("depth") % height == 0
    columns = ["p1", "p2", "conv_id"]
    roots = rolled_up(part.where(at_root).select(higher, *columns, *sums), saved(paths.where(at_root).select(higher, *columns)), sums, height=height)
    below = roots.where("depth > 0").select("conv_id", (F.col("depth") - 1).alias("band"), *sums)
    above = paths.where(~at_root).withColumn("band", F.floor(F.col("depth") / height))
    into = below.join(above, ["conv_id", "band"]).select(*_NODE, "conv_id", *sums)
    inner = part.where(~at_root).unionByName(into).groupBy(*_NODE).agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])
    return saved(inner.unionByName(roots.withColumn("depth", F.col("depth") * height)))


def prefix_trie(conversations: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, turn, role, text) after ``rebuilt``: conv_id (its
    smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (code points that need not be
    read again where members share the node, over its subtree), ends_sha256 (of the ids that end there).

    Nodes are told by 128 bits of hash and their depth. A digest of ids is one stream by its nature: a node's ids are
    sorted and read in batches, never held. Sums come from ``rolled_up``.

    Defined cases: null roles and texts are empty; turns that tie, null ones first, are in the order of a hash of role
    and text, so that rows which repeat are turns of their own; rows without conv_id are left out; any length of text or
    conversation; other columns are not looked at; an empty table gives no node.
    """
    own = saved(turns(conversations.select("conv_id", "turn", "role", "text")))
    convs = saved(own.select("conv_id").distinct())
    steps = saved(beginnings(rebuilt(own)))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in _NODE], *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], "conv_id", "n_convs", zero.alias("chars"))
    nodes = steps.groupBy(*_NODE).agg(*[F.max(c).alias(c) for c in ("q1", "q2")], F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
    nodes = saved(nodes.unionByName(root))

    parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = saved(nodes.where("depth > 0").groupBy(*parent).agg(F.count(F.lit(1)).alias("n_children")))
    counted = saved(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)))
    above = counted.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    total = counted.count()
    told = met(counted.where("depth > 0"), saved(above), ["depth", "q1", "q2"], "_n", total).drop("_n")
    told = told.unionByName(counted.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))

    values = counted.select(*_NODE, "conv_id", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    paths = steps.select("conv_id", *_NODE).unionByName(convs.select("conv_id", *[zero.alias(c) for c in _NODE]))
    sums = rolled_up(values, saved(paths), ["n_leaves", "saved_tokens"], height=height).drop("conv_id")

    last = steps.groupBy("conv_id").agg(F.max(F.struct(*_NODE)).alias("last")).select("conv_id", "last.*")
    still = convs.join(last, "conv_id", "left").select("conv_id", *[F.coalesce(c, zero).alias(c) for c in _NODE])
    ends = still.repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id").mapInArrow(_digests, "depth long, p1 long, p2 long, ends_sha256 string")
    out = told.join(sums, _NODE).join(ends, _NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
