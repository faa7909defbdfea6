"""Source trees and catalog files as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.functions import paths as P


def glob_filter(files: DataFrame, only: list[str] | None = None, exclude: list[str] | None = None, path: str = "path") -> DataFrame:
    """Files the globs admit. A glob that excludes a directory, or a hidden directory, prunes all
    below it, so the path and each directory above it are tested; the asset list always applies."""
    banned = P.globs_regex((exclude or []) + P.ALWAYS_EXCLUDED)
    steps = P.path_ancestors(path)
    hidden = F.col(path).rlike(r"(?:\A|/)\.[^/]")
    kept = files.where(~hidden & ~F.exists(steps, lambda p: p.rlike(banned)))
    return kept.where(F.col(path).rlike(P.globs_regex(only))) if only else kept


def source_files(
    spark: SparkSession, root: str, paths: list[str], project: str, only: list[str] | None = None, exclude: list[str] | None = None
) -> DataFrame:
    """(project, path, content): whole text of every admitted file under the search paths.

    Search paths inside others are left out, so no file is read twice and contents are never shuffled. Bytes that are
    not UTF-8 become replacement characters.
    """
    base = root.rstrip("/")
    paths = [p for i, p in enumerate(paths) if not any(_covers(q, p) and (q.strip("./") != p.strip("./") or j < i) for j, q in enumerate(paths))]
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load([f"{base}/{p.strip('./')}" if p.strip("./") else base for p in paths])
    )
    rel = F.regexp_replace(F.col("path"), "(?s)\\A(?:file:/*)?/?\\Q" + base.lstrip("/") + "\\E/", "")
    named = raw.select(F.lit(project).alias("project"), rel.alias("path"), "content")
    return glob_filter(named, only, exclude).select("project", "path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def _covers(outer: str, inner: str) -> bool:
    """Whether one search path lies in another, or is it."""
    outer, inner = outer.strip("./"), inner.strip("./")
    return not outer or inner == outer or inner.startswith(outer + "/")


def catalog_files(files: DataFrame, read: DataFrame, locales: DataFrame) -> DataFrame:
    """(project, locale, path): the files each locale's read patterns list, each once.

    ``read``: project, pattern; a short list per project. ``locales``: project, locale.
    """
    wanted = read.join(locales.select("project", "locale"), "project").select(
        "project", "locale", P.file_pattern_regex("pattern", "locale").alias("regex")
    )
    per_project = wanted.groupBy("project").agg(F.collect_list(F.struct("locale", "regex")).alias("_wanted"))
    hits = F.array_distinct(
        F.transform(F.filter("_wanted", lambda w: F.rlike(F.col("path"), w["regex"])), lambda w: w["locale"])
    )
    return (
        files.join(per_project, "project").select("project", "path", F.explode(hits).alias("locale")).dropDuplicates(["project", "path", "locale"])
    )
