"""The key pattern language as Java regular expressions, and joins on patterns.

``*`` is any run of characters, ``*:`` part of one segment, ``:`` one whole segment,
``{a,b}`` a capture group; everything else is literal and the whole key must match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.functions.keys import _col, last_segment, regex_group

_TOKEN = r"(?s)(\{[^}]*\}|\*:|\*|:|\{|[^*:{]+)"
_ALTERNATIVE_TOKEN = r"(?s)(\*:|\*|:|[^*:]+)"
# Room for \1..\9: a pattern with fewer groups answers the empty string for the others.
_SPARE_GROUPS = "()" * 9
# Only literals and plain stars: each middle literal can be taken at its first hit.
_PLAIN_GLOB = r"\A[^:{]*\*[^:{]*\*[^:{]*\z"

#: Copies of the patterns: a project's or segment's keys spread over so many tasks. Raise it with the cluster; each copy
#: is as long as the configuration.
SALT = 16


def _quoted(text: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(text, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _wildcard(token: Column) -> Column:
    return (
        F.when(token == "*:", F.lit(r"[^.]+?"))
        .when(token == "*", F.lit(".*"))
        .when(token == ":", F.lit(r"(?<=\A|\.)[^.]++(?=\.|\z)"))
        .otherwise(_quoted(token))
    )


def _group(token: Column) -> Column:
    body = F.trim(F.substring(token, F.lit(2), F.length(token) - 2))
    alternatives = F.transform(
        F.split(body, ","),
        lambda a: F.array_join(
            F.transform(F.regexp_extract_all(F.trim(a), F.lit(_ALTERNATIVE_TOKEN), F.lit(1)), _wildcard), ""
        ),
    )
    return F.concat(F.lit("("), F.array_join(alternatives, "|"), F.lit(")"))


def pattern_regex(pattern) -> Column:
    """Anchored regex with one group per ``{...}``; the form to read captures from."""
    tokens = F.regexp_extract_all(_col(pattern), F.lit(_TOKEN), F.lit(1))
    body = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike(r"(?s)\A\{.*\}\z"), _group(t)).otherwise(_wildcard(t))), "")
    return F.concat(F.lit(r"(?s)\A"), body, F.lit(_SPARE_GROUPS + r"\z"))


def glob_regex(pattern) -> Column:
    """Match-only regex of a pattern made of literals and ``*``: linear, no backtracking."""
    parts = F.split(_col(pattern), r"\*+")
    middle = F.filter(F.slice(parts, F.lit(2), F.size(parts) - 2), lambda p: p != "")
    return F.concat(
        F.lit(r"(?s)\A"),
        _quoted(F.element_at(parts, 1)),
        F.array_join(F.transform(middle, lambda p: F.concat(F.lit("(?>.*?"), _quoted(p), F.lit(")"))), ""),
        F.lit(".*"),
        _quoted(F.element_at(parts, -1)),
        F.lit(r"\z"),
    )


def match_regex(pattern) -> Column:
    """The cheapest regex that answers whether a whole key matches."""
    pattern = _col(pattern)
    return F.when(pattern.rlike(_PLAIN_GLOB), glob_regex(pattern)).otherwise(pattern_regex(pattern))


def pattern_match(key, pattern) -> Column:
    return F.rlike(_col(key), match_regex(pattern))


def pattern_group(key, pattern, index: int) -> Column:
    """Capture ``index`` (1 to 9) of the pattern in the key, empty when there is none."""
    return regex_group(key, pattern_regex(pattern), index)


# --- joins on patterns ---------------------------------------------------------------
#
# A pattern is filed under something it fixes in every key it can match, so the test
# becomes an equi-join with the regex as residual:
#   head   literal first segment        -> the key's first segment
#   tail   literal last segment         -> the key's last segment
#   open   neither                      -> the project
# All carry a salt: the key picks one of SALT copies of the patterns, so a namespace or
# project that holds most keys spreads over SALT tasks. No broadcast is asked for; the
# optimizer broadcasts when the pattern side is under its size limit.


def file_patterns(patterns: DataFrame, pattern: str = "pattern") -> DataFrame:
    """Add ``p_kind``, ``p_anchor`` and ``p_regex``; one row per anchor."""
    p = F.col(pattern)
    head = F.regexp_extract(p, r"\A([^*:{}.]+)(?:\.|\z)", 1)
    heads = F.regexp_extract(p, r"\A\{([^{}*:.]+)\}\.", 1)
    tail = F.regexp_extract(p, r"\.([^*:{}.]+)\z", 1)
    kind = F.when((head != "") | (heads != ""), "head").when(tail != "", "tail").otherwise("open")
    anchors = (
        F.when(head != "", F.array(head))
        .when(heads != "", F.array_distinct(F.transform(F.split(F.trim(heads), ","), lambda a: F.trim(a))))
        .when(tail != "", F.array(tail))
        .otherwise(F.array(F.lit("")))
    )
    return (
        patterns.withColumn("p_kind", kind)
        .withColumn("p_regex", match_regex(p))
        .withColumn("p_anchor", F.explode(anchors))
    )


def _sides(filed: DataFrame, key: str, kind: str):
    """The pattern side of one anchored join, salted, and the join condition."""
    side = filed.where(F.col("p_kind") == kind).withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    anchor = {"head": F.substring_index(F.col(key), ".", 1), "tail": last_segment(key), "open": F.lit("")}[kind]
    on = (
        (F.col("p_project") == F.col("project"))
        & (F.col("p_anchor") == anchor)
        & (F.col("p_salt") == F.pmod(F.xxhash64(F.col(key)), F.lit(SALT)).cast("int"))
        & F.rlike(F.col(key), F.col("p_regex"))
    )
    return side, on


def _locale_condition(locale: str | None) -> Column:
    group = F.col("p_group")
    if locale is None:
        return group.isNull() | (group == "all")
    return group.isNull() | (group == "all") | (group == F.col(locale))


def _prepare(patterns: DataFrame) -> DataFrame:
    cols = [F.col("project").alias("p_project"), F.col("pattern").alias("p_pattern")]
    cols.append((F.col("locale_group") if "locale_group" in patterns.columns else F.lit(None).cast("string")).alias("p_group"))
    return file_patterns(patterns.select(*cols), "p_pattern")


KINDS = ("head", "tail", "open")


def unmatched(df: DataFrame, patterns: DataFrame, key: str = "key", locale: str | None = None) -> DataFrame:
    """Rows of ``df`` whose key no pattern of the project matches."""
    filed = _prepare(patterns)
    for kind in KINDS:
        side, on = _sides(filed, key, kind)
        df = df.join(side, on & _locale_condition(locale), "left_anti")
    return df


def any_of(patterns: list[tuple], key="key", locale: str | None = None) -> Column:
    """Whether one of a short list of ``patterns`` (project, regex, locale group) matches the key, as literal expressions:
    a project's regexes of one group are one alternation, and projects with the same list share it."""
    lists: dict[str, dict] = {}
    for project, regex, group in sorted(patterns, key=lambda p: (p[0], p[1], p[2] or "")):
        group = None if group == "all" else group
        if group is None or locale is not None:
            lists.setdefault(project, {}).setdefault(group, set()).add(regex)
    projects: dict[tuple, list[str]] = {}
    for project, groups in lists.items():
        own = tuple((g, tuple(sorted(groups[g]))) for g in sorted(groups, key=lambda g: (g is not None, g)))
        projects.setdefault(own, []).append(project)
    found = F.when(F.lit(False), F.lit(False))
    for own, names in projects.items():
        hit = F.lit(False)
        for group, regexes in own:
            one = _col(key).rlike("|".join(f"(?:{r})" for r in regexes))
            hit = hit | (one if group is None else (F.col(locale) == group) & one)
        found = found.when(F.col("project").isin(names), hit)
    return F.coalesce(found, F.lit(False))


def _anchored(df: DataFrame, filed: DataFrame, key: str):
    """Both sides of one join that looks a key up under each of its three anchors."""
    k = F.col(key)
    anchors = F.array(
        F.struct(F.lit("head").alias("kind"), F.substring_index(k, ".", 1).alias("anchor")),
        F.struct(F.lit("tail").alias("kind"), last_segment(key).alias("anchor")),
        F.struct(F.lit("open").alias("kind"), F.lit("").alias("anchor")),
    )
    on = (
        (F.col("p_project") == F.col("project"))
        & (F.col("p_kind") == F.col("_at.kind"))
        & (F.col("p_anchor") == F.col("_at.anchor"))
        & (F.col("p_salt") == F.pmod(F.xxhash64(k), F.lit(SALT)).cast("int"))
        & F.rlike(k, F.col("p_regex"))
    )
    salted = filed.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return df.withColumn("_at", F.explode(anchors)), salted, on


def matched(df: DataFrame, patterns: DataFrame, key: str = "key", locale: str | None = None) -> DataFrame:
    """The distinct rows of ``df`` whose key some pattern of the project matches."""
    probes, filed, on = _anchored(df, _prepare(patterns), key)
    return probes.join(filed, on & _locale_condition(locale), "left_semi").drop("_at").distinct()


def matching_pairs(df: DataFrame, patterns: DataFrame, key: str = "key", locale: str | None = None) -> DataFrame:
    """Each row with each pattern that matches its key, for results that are aggregated next.

    ``patterns``: p_project, p_pattern, p_group and whatever else should come along. Without a
    ``locale`` column groups are not tested; the caller does it.
    """
    probes, filed, on = _anchored(df, file_patterns(patterns, "p_pattern"), key)
    return probes.join(filed, on if locale is None else on & _locale_condition(locale)).drop("_at", "p_salt")
