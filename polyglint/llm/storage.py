"""Tables that cut a plan: written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset (tests), below a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: later reads neither compute it again nor depend
    on the executors that made it."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Plans that give a row the same place every time have none of these.
_MOVES = re.compile(r"\b(?:Join|Aggregate|Window|Repartition\w*|Rebalance\w*|Sort|\w*Limit|Offset|Distinct|Sample|Intersect|Except|\w*In(?:Pandas|Arrow))\b")


def stable(df: DataFrame) -> DataFrame:
    """``df`` as a table whose rows can be numbered where they stand: as it is where its plan only reads files row by row,
    else written first, since rows that come from a shuffle may come in another order the next time."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return saved(df) if _MOVES.search(plan) else df
