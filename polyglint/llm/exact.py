"""Exact duplicates by deterministic block naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.llm.naming import named
from polyglint.llm.storage import saved, stable

#: Bytes of a block.
BLOCK_BYTES = 1024


def normalised(text: Column) -> Column:
    """Runs of ASCII blanks as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    A text is cut into blocks of ``block_bytes``; equal blocks get one integer name, then equal pairs of adjacent names
    get one, and so on until a document has a single name. Two texts are equal exactly if they have the same number of
    blocks and the same name: names come from comparing contents, so nothing can collide. Each round halves the rows,
    and its rows are a few integers.

    Defined cases: a null or empty text is one empty block; texts may be of any length; a null doc_id sorts behind all
    others; of rows that repeat a doc_id and a text, one is kept; an empty table gives an empty result; other columns
    are not looked at.
    """
    bytes_ = F.encode("_text", "UTF-8")
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("_text") / F.lit(block_bytes))).cast("int")
    texts = stable(docs.select("doc_id", "text")).select("doc_id", normalised(F.col("text")).alias("_text")).select(
        "doc_id",
        F.monotonically_increasing_id().alias("row"),
        F.unhex(F.sha2("_text", 256)).alias("sha"),
        n_blocks.alias("size"),
        bytes_.alias("_bytes"),
    )
    block = F.substring(F.col("_bytes"), F.col("pos") * block_bytes + 1, F.lit(block_bytes))
    blocks = (
        texts.select("doc_id", "row", "sha", "size", "_bytes", F.explode(F.sequence(F.lit(0), F.col("size") - 1)).alias("pos"))
        .select(
            *[F.when(F.col("pos") == 0, F.col(c)).alias(c) for c in ("doc_id", "sha")],
            "row",
            "size",
            "pos",
            block.alias("block"),
        )
    )
    level = saved(named(blocks, ["block"], "name"))
    longest = level.agg(F.max("size")).first()[0] or 1
    for _ in range((longest - 1).bit_length()):
        even = F.col("pos") % 2 == 0
        pairs = level.groupBy("row", "size", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max("doc_id").alias("doc_id"),
            F.max("sha").alias("sha"),
            F.max(F.when(even, F.col("name"))).alias("left"),
            F.max(F.when(~even, F.col("name"))).alias("right"),
        )
        level = saved(named(pairs, ["left", "right"], "name"))
    doc_key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))
    # written, so that both sides of the join are dealt out by it and a large group can be split
    groups = saved(level.groupBy("size", "name").agg(F.min(doc_key).alias("first"), F.count(F.lit(1)).alias("group_size")))
    return level.join(groups, ["size", "name"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
