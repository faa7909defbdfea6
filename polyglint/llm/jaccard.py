"""Jaccard join of documents on word n-grams, as a blocked sparse product of the document by n-gram incidence."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from polyglint.llm.components import components
from polyglint.llm.placing import met
from polyglint.llm.storage import saved
from polyglint.llm.words import Prefix, chunks, mixed, words_of

#: Words of an n-gram.
N = 5
#: N-grams that are known to be common, from the documents whose hash has this remainder. They only order n-grams, so
#: that the product has short columns; results do not depend on them.
COMMON, SAMPLE_PART = 100_000, 16


class Order(NamedTuple):
    """Common n-grams, sorted, and how common each is (as a power of 2). Others are of level 0."""

    grams: np.ndarray
    levels: np.ndarray

    def level(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.grams):
            return np.zeros(len(grams), np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, self.levels[at], 0)


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The distinct n-grams of each text, as sorted hashes. Fewer words than N are one n-gram; none are no n-gram."""
    words = words_of(texts, lower=True)
    prefix = Prefix(words.hashes())
    grams = prefix.windows(N, 4)
    out = []
    for a, b in zip(words.first, words.first[1:], strict=False):
        if b - a >= N:
            out.append(np.unique(grams[a : b - N + 1]))
        else:
            out.append(prefix.ranges(np.array([a]), np.array([b]), 5)[: int(b > a)])
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32)), pa.array(values))


def _signatures(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two sums of 64 bits that tell the sets apart."""
    sums = [[mixed(s, seed).sum(dtype=np.uint64) for s in sets] for seed in (1, 2)]
    return [pa.array(np.array(x, np.uint64).view(np.int64)) for x in sums]


def _tags(signature: pa.Array) -> pa.Array:
    """Half of a signature."""
    return pa.array((signature.to_numpy() >> 32).astype(np.int32))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        sets = _sets(batch.column("text"))
        sums = _signatures(sets)
        arrays = [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), *sums, _tags(sums[0])]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "sig1", "sig2", "tag"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        grams, times = np.unique(np.concatenate([np.zeros(0, np.uint64), *_sets(batch.column("text"))]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "times"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        sets = _sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), _lists(sets)], ["doc_id", "n", "grams"])


def _order(docs: DataFrame) -> Order:
    """The commonest n-grams of a part of the documents: at most COMMON."""
    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE_PART)) == 0)
    counts = part.mapInArrow(_counted, "gram long, times long").groupBy("gram").agg(F.sum("times").alias("times"))
    rows = counts.where("times > 2").orderBy(F.desc("times"), "gram").limit(COMMON).toArrow()
    grams = rows.column("gram").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return Order(grams[order], np.log2(rows.column("times").to_numpy()[order]).astype(np.int64) + 1)


#: N-grams that two sets must share at the front of both orders before they are compared, as far as they must share so
#: many at all. The front is so much longer than for one.
FRONT = 3


def prefix_length(n):
    """N-grams of which FRONT at least are shared by any other set that is similar enough: 3/4 of a set is shared."""
    return n - (3 * n + 3) // 4 + FRONT


def _incidence(docs: DataFrame, order: Order) -> DataFrame:
    """Rows of the incidence that can begin a link: (gram, doc_id, n, place, common, tag) for the rarest n-grams of each
    document, with their place in its order and the ``tag`` of its set, which tells sets of one doc_id apart."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            ids, sets = batch.column("doc_id"), _sets(batch.column("text"))
            tags = _tags(_signatures(sets)[0])
            grams = np.concatenate([np.zeros(0, np.uint64), *sets])
            sizes = np.array([len(s) for s in sets], np.int64)
            rows, levels = np.repeat(np.arange(len(sets)), sizes), shared.value.level(grams)
            ranked = np.lexsort((grams, levels, rows))
            place = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            early = place < prefix_length(sizes)[rows]
            keep = ranked[early]
            arrays = [pa.array(grams[keep].view(np.int64)), ids.take(pa.array(rows[keep])), pa.array(sizes[rows[keep]]), pa.array(place[early].astype(np.int32)), pa.array(levels[keep] > 0), tags.take(pa.array(rows[keep]))]
            yield pa.RecordBatch.from_arrays(arrays, ["gram", "doc_id", "n", "place", "common", "tag"])

    return docs.mapInArrow(run, "gram long, doc_id long, n long, place int, common boolean, tag int")


def _fits(n_a: Column, n_b: Column) -> Column:
    return 4 * F.least(n_a, n_b) >= 3 * F.greatest(n_a, n_b)


def _needed(n_a: Column, n_b: Column) -> Column:
    """Shared n-grams at the bound: 3/7 of both sizes."""
    return F.floor((3 * (n_a + n_b) + 6) / 7)


def _early(place: Column, n: Column, other: Column) -> Column:
    """Whether a place is among the first of which, for two sets of these sizes, FRONT at least are shared."""
    return place <= n - _needed(n, other) + FRONT - 1


def _possible(overlap: Column, n_a: Column, n_b: Column) -> Column:
    """The overlap so far and all that may follow behind the prefixes can reach the bound 3/7 (n_a + n_b)."""
    rest = F.greatest(n_a - _prefix_column(n_a), n_b - _prefix_column(n_b))
    return 7 * (overlap + rest) >= 3 * (n_a + n_b)


def _prefix_column(n: Column) -> Column:
    return F.least(n, n - F.floor((3 * n + 3) / 4) + FRONT)


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough. Only documents of the pairs are moved."""
    pairs = saved(pairs.select("a", "b").distinct())
    ids = saved(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    sets = saved(docs.join(ids, "doc_id").mapInArrow(_listed, "doc_id long, n long, grams array<long>"))
    one, two = (sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    return saved(both.where(7 * overlap >= 3 * (F.col("n_a") + F.col("n_b"))).select("a", "b"))


def similar_components(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Sets of N-word shingles (A to Z lowered) link where 100 * intersection >= 75 * union; a component is what links
    reach, named by its smallest doc_id. Every link between different sets is found or lies inside a component.

    1. Documents with equal sets (a signature of 128 bits) are one row of the incidence, that of the smallest doc_id.
    2. N-grams are ordered by how common they are; of each set the rarest quarter and a few more are kept: similar sets
       share FRONT there.
       These rows are dealt out by n-gram, so a task holds a block of columns.
    3. Each column is multiplied with its first document only: overlap counts of (document, first document) are added
       over all blocks, and pairs that cannot reach the bound of their sizes are discarded. Each document's best pair is
       compared exactly; components follow.
    4. Columns whose documents are in different components yet are multiplied in full, across components only, where the
       n-gram is early enough in both orders for the two sizes. What comes of it is counted over all kept n-grams, held
       to the same bound, and compared exactly. Near copies are together by then, and those that are not have n-grams of
       their own that come first, so a large group does not cost its square.

    Common n-grams are aggregated on the map side and met by broadcast (at most COMMON columns); all other columns have
    less than 1 / COMMON of the sample's rows.

    Defined cases: null and empty texts have no n-gram and link with nothing; a null doc_id links with nothing and has
    component_id null; rows that repeat a doc_id are one node with the links of all its texts; any length; other columns
    are not looked at; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", "text")
    known = texts.where("doc_id IS NOT NULL")
    measured = saved(texts.mapInArrow(_measured, "doc_id long, n long, sig1 long, sig2 long, tag int"))
    filled = measured.where("n > 0 AND doc_id IS NOT NULL")
    signature = ["n", "sig1", "sig2"]
    classes = filled.groupBy(*signature).agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("size")).where("keep < last")
    copies = met(filled, saved(classes), signature, "size", measured.count())
    copies = saved(copies.where("doc_id > keep").select("doc_id", "keep", "tag").distinct())

    rows = saved(_product_rows(_incidence(known, _order(known))))
    rows = saved(rows.join(copies.select("doc_id", "tag"), ["doc_id", "tag"], "left_anti").drop("tag"))
    first = F.min(F.struct("doc_id", "n")).alias("first")
    seldom = rows.where("NOT common").join(saved(rows.where("NOT common").groupBy("gram").agg(first)), "gram")
    often = rows.where("common").join(F.broadcast(rows.where("common").groupBy("gram").agg(first)), "gram")
    hubs = seldom.unionByName(often).where("doc_id <> first.doc_id")
    counted = _counted_pairs(hubs.select("doc_id", "n", F.col("first.doc_id").alias("b"), F.col("first.n").alias("n_b")))
    best = counted.groupBy("a").agg(F.max(F.struct("overlap", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    links = _verified(known, best)
    found = saved(components(links))

    labelled = rows.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    labelled = saved(labelled.select("gram", "doc_id", "n", "place", "component"))
    mixed_columns = labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("gram")
    left = saved(labelled.join(saved(mixed_columns), "gram"))
    other = left.select("gram", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("of_b"))
    n, n_b = F.col("n"), F.col("n_b")
    across = left.join(other, "gram").where("component < of_b").where(_fits(n, n_b) & _early(F.col("place"), n, n_b) & _early(F.col("place_b"), n_b, n))
    # similar sets share FRONT n-grams there, or all that they must share
    front = across.groupBy(F.col("doc_id").alias("a"), "b", "n", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    pairs = saved(front.where(F.col("shared") >= F.least(F.lit(FRONT), _needed(n, n_b))).drop("shared").join(best, ["a", "b"], "left_anti"))
    held = saved(left.groupBy("doc_id").agg(F.collect_list("gram").alias("grams")))
    one, two = (held.select(F.col("doc_id").alias(c), F.col("grams").alias(f"grams_{c}")) for c in "ab")
    overlap = F.size(F.array_intersect("grams_a", "grams_b"))
    more = _verified(known, pairs.join(one, "a").join(two, "b").where(_possible(overlap, n, n_b)))
    every = links.unionByName(more).unionByName(copies.select(F.col("doc_id").alias("a"), F.col("keep").alias("b")))
    final = components(every)
    named = measured.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _product_rows(incidence: DataFrame) -> DataFrame:
    """Rows of columns with two documents at least. The common ones are not moved for that."""
    column = Window.partitionBy("gram")
    seldom = incidence.where("NOT common").withColumn("low", F.min("doc_id").over(column)).withColumn("high", F.max("doc_id").over(column))
    seldom = seldom.where("low < high").drop("low", "high")
    return seldom.unionByName(incidence.where("common"))


def _counted_pairs(rows: DataFrame) -> DataFrame:
    """(a, b, overlap) of rows (doc_id, n, b, n_b), one per shared n-gram, within the bounds of the sizes."""
    rows = rows.where(_fits(F.col("n"), F.col("n_b")))
    counted = rows.groupBy(F.col("doc_id").alias("a"), "b").agg(F.count(F.lit(1)).alias("overlap"), F.max("n").alias("n"), F.max("n_b").alias("n_b"))
    return saved(counted.where(_possible(F.col("overlap"), F.col("n"), F.col("n_b"))).select("a", "b", "overlap"))
