"""Ignore rules: from configuration to rows, and the joins that apply them.

``rule`` rows: project, rule_id, setting, pattern, locale_group (null for a plain list).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from polyglint.functions import patterns as M

# Rule settings and the finding kind each one applies to.
KIND_OF_SETTING = {
    "ignore_missing": "missing",
    "ignore_unused": "unused",
    "ignore_eq_base": "eq_base",
    "ignore_inconsistent_interpolations": "interpolations",
}
KINDS = list(KIND_OF_SETTING.values())


#: Rules up to this number become literal expressions of the plan; more are a table that keys are joined with.
LITERAL_RULES = 500


class ListedRules(NamedTuple):
    """A short configuration, read once: rows of project, setting, locale_group, regex."""

    rows: list[Row]

    def of_kind(self, kind: str) -> list[tuple]:
        return [(r["project"], r["regex"], r["locale_group"]) for r in self.rows if r["setting"] in _settings(kind)]


def listed(rules: DataFrame | ListedRules | None) -> DataFrame | ListedRules | None:
    """``rules`` as a list if they are few: one small action. Functions that take rules take either form, so a caller of
    several of them lists the rules once."""
    if not isinstance(rules, DataFrame):
        return rules
    prepared = rules.where("project IS NOT NULL AND pattern IS NOT NULL").select("project", "setting", "locale_group", M.match_regex("pattern").alias("regex"))
    rows = prepared.limit(LITERAL_RULES + 1).collect()
    return ListedRules(rows) if len(rows) <= LITERAL_RULES else rules


def _settings(kind: str) -> list[str]:
    return ["ignore"] + [s for s, k in KIND_OF_SETTING.items() if k == kind]


def rule_rows(config: DataFrame) -> DataFrame:
    """Split locale groups such as ``fr, es`` into one row per locale; plain lists keep null.

    A group that names no locale applies to nothing.
    """
    names = F.filter(F.transform(F.split("group_text", ","), lambda g: F.trim(g)), lambda g: g != "")
    groups = F.when(F.col("group_text").isNull(), F.array(F.lit(None).cast("string"))).otherwise(names)
    return config.withColumn("locale_group", F.explode(groups)).drop("group_text").distinct()


def merge_rules(rules: DataFrame) -> DataFrame:
    """Add ``kind``; a rule of the global list counts for every kind."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    own = F.coalesce(*[F.when(F.col("setting") == s, F.array(F.lit(k))) for s, k in KIND_OF_SETTING.items()])
    return rules.withColumn("kind", F.explode(F.when(F.col("setting") == "ignore", kinds).otherwise(own)))


def _of_kind(rules: DataFrame, kind: str) -> DataFrame:
    return rules.where(F.col("setting").isin(_settings(kind))).select("project", "pattern", "locale_group")


def without_ignored(df: DataFrame, rules: DataFrame | ListedRules | None, kind: str, key: str = "key", locale: str | None = None) -> DataFrame:
    """Drop rows an ignore pattern of the kind matches. With no locale only plain lists and
    ``all`` groups apply."""
    rules = listed(rules)
    if rules is None:
        return df
    if isinstance(rules, ListedRules):
        return df.where(~M.any_of(rules.of_kind(kind), key, locale))
    return M.unmatched(df, _of_kind(rules, kind), key, locale)


def may_match(rules: ListedRules, kind: str, key="key") -> Column:
    """Whether a rule of the kind matches the key, in whatever locale."""
    return M.any_of([(project, regex, None) for project, regex, _ in rules.of_kind(kind)], key)


def ignored_in(keys: DataFrame, rules: DataFrame | ListedRules, kind: str, locales: DataFrame, key: str = "key") -> DataFrame:
    """(columns of ``keys``, locale) for every locale whose rules of the kind match. The regexes run
    once per key, not once per key and locale."""
    rules = listed(rules)
    if isinstance(rules, ListedRules):
        own = [(p, r, None if g == "all" else g) for p, r, g in rules.of_kind(kind)]
        groups = sorted({g for _, _, g in own}, key=lambda g: g or "")
        hit = [F.when(M.any_of([(p, r, None) for p, r, g in own if g == group], key), F.lit(group or "all")) for group in groups]
        found = F.filter(F.array(*hit), lambda g: g.isNotNull()) if hit else F.array().cast("array<string>")
        hits = keys.select("*", F.explode(found).alias("p_group"))
    else:
        named = _of_kind(rules, kind).select(F.col("project").alias("p_project"), F.col("pattern").alias("p_pattern"), F.col("locale_group").alias("p_group"))
        hits = M.matching_pairs(keys, named, key).select(*keys.columns, "p_group").distinct()
    wide = F.col("p_group").isNull() | (F.col("p_group") == "all")
    return hits.join(locales.select("project", "locale"), "project").where(wide | (F.col("p_group") == F.col("locale"))).select(*keys.columns, "locale").distinct()


def stale_rules(rules: DataFrame, findings: DataFrame) -> DataFrame:
    """Rules that suppress no finding of their kind. ``findings`` are made with no rules at
    all and carry project, kind, locale, key; here a locale group is tested on the row. Those
    that no rule can match may be left out (``checks.suppressible``).

    Up to ``LITERAL_RULES`` rules are tested on each finding as literals of the plan, so that
    findings, which may be most of the catalog, do not move; only the rules hit do.
    """
    probes = findings.select("project", "kind", "locale", "key")
    by_kind = merge_rules(rules)
    rows = by_kind.where("project IS NOT NULL AND pattern IS NOT NULL").select(
        "project", "rule_id", "kind", "locale_group", M.match_regex("pattern").alias("regex")
    ).limit(len(KINDS) * LITERAL_RULES + 1).collect()
    if len(rows) <= len(KINDS) * LITERAL_RULES:
        live = _literal_hits(probes, rows, dict(rules.dtypes)["rule_id"])
    else:
        named = by_kind.select(
            F.col("project").alias("p_project"), "rule_id", F.col("kind").alias("p_kind_of_rule"), F.col("pattern").alias("p_pattern"), F.col("locale_group").alias("p_group")
        )
        hits = M.matching_pairs(probes.distinct(), named, "key", "locale").where(F.col("kind") == F.col("p_kind_of_rule"))
        live = hits.select(F.col("p_project").alias("project"), "rule_id").distinct()
    return rules.join(live, ["project", "rule_id"], "left_anti").select("project", "rule_id", "setting", "pattern").distinct()


def _literal_hits(probes: DataFrame, rows: list[Row], id_type: str) -> DataFrame:
    """The distinct (project, rule_id) of ``rows`` (project, rule_id, kind, locale_group, regex) that match a probe."""
    lists: dict[tuple, list[Row]] = {}
    for r in rows:
        lists.setdefault((r["project"], r["kind"]), []).append(r)

    def hit(r: Row):
        test = F.col("key").rlike(r["regex"])
        own = test if r["locale_group"] in (None, "all") else (F.col("locale") == r["locale_group"]) & test
        return F.when(own, F.lit(r["rule_id"]).cast(id_type))

    found = F.when(F.lit(False), F.array().cast(f"array<{id_type}>"))
    for (project, kind), own in lists.items():
        found = found.when((F.col("project") == project) & (F.col("kind") == kind), F.array_compact(F.array(*[hit(r) for r in own])))
    return probes.select("project", F.explode(found).alias("rule_id")).distinct()


def config_digest(rules: DataFrame) -> DataFrame:
    """A fingerprint of each project's settings, independent of row order.

    Rule hashes are combined by sums, which merge before the shuffle.
    """
    text = F.concat_ws("\u0001", "setting", "pattern", F.coalesce("locale_group", F.lit("")))
    halves = [F.conv(F.substring(F.sha2(text, 256), s, 12), 16, 10).cast("decimal(20,0)") for s in (1, 13, 25, 37)]
    sums = [F.sum(h).alias(f"_h{i}") for i, h in enumerate(halves)]
    return (
        rules.select("project", "setting", "pattern", "locale_group")
        .distinct()
        .groupBy("project")
        .agg(F.count("*").alias("n_rules"), *sums)
        .select("project", "n_rules", F.sha2(F.concat_ws(",", *[F.col(f"_h{i}").cast("string") for i in range(4)]), 256).alias("digest"))
    )
