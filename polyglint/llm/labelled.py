"""The bounded sample of labelled documents that the classifiers learn from."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents of the sample, and bytes of the longest text in it. A sample is at most their product.
SAMPLE_DOCUMENTS = 2500
SAMPLE_TEXT_BYTES = 20_000
#: Rows with this remainder are held out: nothing is learned from them.
FOLDS, HELD_OUT_FOLD = 4, 2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, *, documents: int = SAMPLE_DOCUMENTS, text_bytes: int = SAMPLE_TEXT_BYTES) -> pa.Table:
    """(text, label) of at most ``documents`` labelled rows that are not held out, without repeated texts.

    Ids are chosen by their hash from the labels alone; only the chosen ones are joined to the documents, by broadcast.
    Rows without a label, an id or a text are not used; of two labels for an id, the smaller one is.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(F.col("doc_id")), "doc_id").limit(documents)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toArrow()
    first: dict[str, int] = {}
    for doc_id, text, value in sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True)):
        first.setdefault(text, value)
    return pa.table({"text": pa.array(first.keys(), pa.string()), "label": pa.array(first.values(), pa.int64())})
