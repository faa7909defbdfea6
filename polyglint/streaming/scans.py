"""Scans over a stream of source files. The scan is narrow, so it is the batch expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.operators import scan as S


def stream_files(spark: SparkSession, directory: str, project: str) -> DataFrame:
    """A directory of parquet files with (path, content) columns, read as they arrive."""
    return spark.readStream.schema("path string, content string").parquet(directory).withColumn("project", F.lit(project))


def stream_occurrences(files: DataFrame, roots: list[str]) -> DataFrame:
    """Template occurrences of a streaming (project, path, content)."""
    return S.scan_templates(files, roots)
