"""The usage relation: keys, key patterns and opaque calls found in source text.

``occurrence`` rows: project, path, pos, line_num, line_pos, key, raw_key, candidate_keys, kind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import patterns as M


def keys_of(occ: DataFrame) -> DataFrame:
    return occ.where(F.col("kind") == "key")


class UsageView:
    """What checks read of the usage, made from its rows whenever it is asked for."""

    def __init__(self, occ: DataFrame):
        self._occ = occ

    def used(self) -> DataFrame:
        """The distinct (project, key)."""
        return keys_of(self._occ).select("project", "key").distinct()

    def candidates(self) -> DataFrame:
        """The distinct (project, key, candidate): what a call may name."""
        named = F.when(F.size("candidate_keys") > 0, F.col("candidate_keys")).otherwise(F.array("key"))
        return keys_of(self._occ).select("project", "key", F.explode(named).alias("candidate")).distinct()

    def calls(self) -> DataFrame:
        """(project, key, candidate, at): each candidate of a key once, with its first place (path, pos, line)."""
        named = F.when(F.size("candidate_keys") > 0, F.col("candidate_keys")).otherwise(F.array("key"))
        rows = keys_of(self._occ).select("project", "key", F.explode(named).alias("candidate"), F.struct("path", "pos", F.col("line_num").alias("line")).alias("at"))
        return rows.groupBy("project", "key", "candidate").agg(F.min("at").alias("at"))

    def patterns(self) -> DataFrame:
        return pattern_set(self._occ)

    def narrowed(self, rows: Callable[[DataFrame], DataFrame]) -> UsageView:
        """The calls that ``rows``, a filter of project and key, lets through."""
        return UsageView(rows(keys_of(self._occ)))


def view(occ: DataFrame | UsageView) -> UsageView:
    return occ if isinstance(occ, UsageView) else UsageView(occ)


def used_keys(occ: DataFrame) -> DataFrame:
    """Per key: how often and where first. Occurrences stay rows (see ``occurrence_listing``):
    a key called everywhere is never gathered into one list."""
    return (
        keys_of(occ)
        .groupBy("project", "key")
        .agg(F.count("*").alias("n_occurrences"), F.min_by(F.struct("path", "line_num"), F.struct("path", "pos")).alias("first"))
        .select("project", "key", "n_occurrences", F.col("first.path").alias("first_path"), F.col("first.line_num").alias("first_line"))
    )


def occurrence_listing(occ: DataFrame) -> DataFrame:
    """Every occurrence under its key, by path and position."""
    return keys_of(occ).orderBy("project", "key", "path", "pos")


def pattern_set(occ: DataFrame) -> DataFrame:
    return occ.where(F.col("kind") == "pattern").select("project", F.col("key").alias("pattern")).distinct()


def opaque_calls(occ: DataFrame) -> DataFrame:
    """Calls whose key is unknown; they never mean that no key is used."""
    return occ.where(F.col("kind") == "opaque").orderBy("project", "path", "pos")


def used_by_ancestor(keys: DataFrame, occ: DataFrame, key: str = "key") -> DataFrame:
    """The distinct (project, key) that are used themselves or below a used key."""
    wanted = keys.select("project", F.col(key).alias("key")).distinct()
    used = keys_of(occ).select("project", "key").distinct()
    direct = wanted.join(used, ["project", "key"], "left_semi")
    rest = wanted.join(used, ["project", "key"], "left_anti")
    probes = rest.select("project", "key", F.explode(K.proper_ancestors("key")).alias("prefix")).withColumn("salt", _salt("key"))
    sections = _used_sections(used, section_nodes(wanted)).withColumnRenamed("section", "prefix")
    # no key is on both sides; only one with several used ancestors comes up again
    return direct.unionByName(probes.join(sections, ["project", "prefix", "salt"], "left_semi").select("project", "key").distinct())


def section_nodes(keys: DataFrame, key: str = "key") -> DataFrame:
    """The distinct (project, section): every proper ancestor of a key, walked from the distinct parents."""
    parents = keys.where(F.col(key).contains(".")).select("project", K.parent_key(key).alias("parent")).distinct()
    return parents.select("project", F.explode(K.ancestors("parent")).alias("section")).distinct()


def _salt(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(M.SALT)).cast("int")


def _used_sections(used: DataFrame, nodes: DataFrame) -> DataFrame:
    """(project, section, salt): used keys that are a section, ``SALT`` copies of each. The top levels of the key tree are
    few and hot, so each prefix test picks one of the copies; used keys with nothing below them are not copied."""
    sections = used.select("project", F.col("key").alias("section")).join(nodes, ["project", "section"], "left_semi")
    return sections.select("project", "section", F.explode(F.sequence(F.lit(0), F.lit(M.SALT - 1))).alias("salt"))


def without_used(leaves: DataFrame, occ: DataFrame | UsageView, key: str = "key", nodes: DataFrame | None = None) -> DataFrame:
    """Leaves, one per (project, locale, key), whose ``key`` column is neither used nor below a
    used key.

    The equi-join on the whole key goes first and leaves the prefix walk only the rest. The
    walk is one salted left join and one aggregate, so the rest is read once. ``nodes``: the
    sections of the leaves (``section_nodes``), if the caller has them cheaper; more do no harm.
    """
    used = view(occ).used()
    rest = K.join_on_hash(leaves, used.withColumnRenamed("key", key), ["project", key], "left_anti").select(*leaves.columns)
    columns = rest.columns
    probes = rest.withColumn("_prefix", F.explode_outer(K.proper_ancestors(key))).withColumn("_salt", _salt(key))
    sections = _used_sections(used, section_nodes(leaves, key) if nodes is None else nodes).select(
        F.col("project").alias("_p"), F.col("section").alias("_section"), F.col("salt").alias("_s")
    )
    on = (F.col("_p") == F.col("project")) & (F.col("_section") == F.col("_prefix")) & (F.col("_s") == F.col("_salt"))
    ids = ["project", "locale", "key"]
    # one by one: a struct of them would carry all through, whatever is asked for
    others = [c for c in columns if c not in ids]
    return (
        probes.join(sections, on, "left")
        .groupBy(*ids)
        .agg(*[F.any_value(c).alias(c) for c in others], F.count("_section").alias("_hits"))
        .where("_hits = 0")
        .select(*columns)
    )


def used_by_pattern(keys: DataFrame, occ: DataFrame, key: str = "key") -> DataFrame:
    return M.matched(keys, pattern_set(occ), key)


def without_used_by_pattern(keys: DataFrame, occ: DataFrame | UsageView, key: str = "key") -> DataFrame:
    return M.unmatched(keys, view(occ).patterns(), key)


def scan_counts(files: DataFrame) -> DataFrame:
    """Files scanned and files skipped by the prefilter; unreadable ones count as neither."""
    return files.groupBy("project").agg(
        F.count_if(F.col("verdict") == "scanned").alias("files_scanned"),
        F.count_if(F.col("verdict") == "prefiltered").alias("files_prefiltered"),
    )


def usage_dump(occ: DataFrame) -> DataFrame:
    """Everything found, as sorted rows: keys with occurrences, each distinct pattern once,
    opaque calls with their place."""
    place = ["path", F.col("line_num").alias("line"), F.col("line_pos").alias("column")]
    keys = keys_of(occ).select("project", F.lit("key").alias("section"), "key", *place, "raw_key", F.array_join("candidate_keys", " ").alias("candidates"), "pos")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("path", "string"), ("line", "int"), ("column", "int"), ("raw_key", "string"), ("candidates", "string"), ("pos", "int"))]
    patterns = pattern_set(occ).select("project", F.lit("pattern").alias("section"), F.col("pattern").alias("key"), *nothing)
    opaque = occ.where(F.col("kind") == "opaque").select(
        "project", F.lit("opaque").alias("section"), F.lit(None).cast("string").alias("key"), *place, "raw_key", F.lit("").alias("candidates"), "pos"
    )
    return keys.unionByName(patterns).unionByName(opaque).orderBy("project", "section", "key", "path", "pos")


def merge_scans(*scans: DataFrame) -> DataFrame:
    """Results of several scans as one relation; order is always an explicit sort."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out
