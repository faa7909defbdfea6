"""Applying a fitted model to whole tables: one pass, nothing moved, columns carried along."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from polyglint.llm.words import chunks


def scored(docs: DataFrame, model, score: Callable, added: str) -> DataFrame:
    """``docs`` with the columns that ``score(model, text column)`` returns for each row, named and typed by ``added``.

    A column of ``docs`` that has one of these names gives way to the new one. The model goes out as a broadcast; its
    size does not depend on the data.
    """
    new = _parse_datatype_string(added)
    names = {f.name.lower() for f in new.fields}
    carried = [f for f in docs.schema.fields if f.name.lower() not in names]
    schema = StructType([StructField(f.name, f.dataType, True) for f in carried] + list(new.fields))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            values = score(shared.value, batch.column("text"))
            arrays = [batch.column(f.name) for f in carried] + values
            yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    return docs.mapInArrow(run, schema)
