"""The audits: missing, unused, equal to base, placeholder checks.

Every finding row has the same columns, reasons flattened to nullable ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import values as V
from polyglint.operators import catalog as C
from polyglint.operators import rules as R
from polyglint.operators import usage as U

FINDING = [
    ("project", "string"),
    ("check", "string"),
    ("locale", "string"),
    ("key", "string"),
    ("value", "string"),
    ("reason_type", "string"),
    ("path", "string"),
    ("line", "int"),
    ("present_in", "string"),
    ("categories", "string"),
    ("variables", "string"),
    ("base_variables", "string"),
    ("names", "string"),
]
MISSING_TYPES = ["used", "diff", "plural"]


def as_findings(df: DataFrame, check: str, reason: str | None) -> DataFrame:
    given = df.withColumn("check", F.lit(check)).withColumn("reason_type", F.lit(reason))
    return given.select(*[(F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in FINDING])


# --- locales -------------------------------------------------------------------------


def select_locales(locales: DataFrame, requested: list[str] | None = None) -> DataFrame:
    """The requested locales per project in report order, ``problem`` set on bad names.

    Nothing or ``all`` takes every locale; ``base`` stands for the base locale, which swaps
    places with whatever stands first; repeats drop out.
    """
    if not requested or requested == ["all"]:
        return locales.withColumn("problem", F.lit(None).cast("string"))
    known = locales.groupBy("project").agg(
        F.max_by("locale", "is_base").alias("_base"), F.collect_set("locale").alias("_known")
    )
    asked = F.transform(F.array(*[F.lit(r) for r in requested]), lambda r: F.when(r == "base", F.col("_base")).otherwise(r))
    at = F.array_position(asked, F.col("_base"))
    swapped = F.transform(
        asked,
        lambda name, i: F.when((at > 1) & (i == 0), F.col("_base")).when((at > 1) & (i == at - 1), F.element_at(asked, 1)).otherwise(name),
    )
    return known.select("project", "_base", "_known", F.posexplode(F.array_distinct(swapped)).alias("locale_rank", "locale")).select(
        "project",
        "locale",
        "locale_rank",
        (F.col("locale") == F.col("_base")).alias("is_base"),
        F.when(~K.valid_locale("locale"), "invalid").when(~F.array_contains("_known", F.col("locale")), "unknown").alias("problem"),
    )


def require_known(selected: DataFrame) -> DataFrame:
    """Raise when a requested locale is malformed or not configured."""
    bad = selected.where("problem is not null").first()
    if bad:
        raise ValueError(f"{bad['problem']} locale `{bad['locale']}` in project {bad['project']}")
    return selected.drop("problem")


def _base(locales: DataFrame) -> DataFrame:
    return locales.where("is_base").select("project", "locale")


def _others(locales: DataFrame) -> DataFrame:
    return locales.where(~F.col("is_base")).select("project", "locale", "locale_rank")


# --- presence ------------------------------------------------------------------------


def present(keys: DataFrame, tr: DataFrame) -> DataFrame:
    """Rows whose key is a leaf or an interior node of the locale or of the external catalog."""
    return K.join_on_hash(keys, C.view(tr).present(), ["project", "locale", "key"], "left_semi")


# --- missing -------------------------------------------------------------------------


def missing_used(occ: DataFrame, tr: DataFrame, rules: DataFrame | None, locales: DataFrame) -> DataFrame:
    """Used keys with no value in a locale.

    A key is reported when no candidate of any of its occurrences is present or ignored, so
    occurrences reduce to distinct candidates before locales come in.
    """
    # a key is one row here, with the locales in which a candidate of it is present or ignored: locales come in
    # when only what is missing is left
    pairs = U.view(occ).calls().where("key IS NOT NULL")
    held = _with_held(pairs, tr, "candidate").select("project", "key", "at", "locales")
    if rules is not None:
        ignored = R.ignored_in(pairs.select("project", "key", "candidate"), rules, "missing", locales, "candidate")
        held = held.unionByName(ignored.select("project", "key", F.lit(None).cast(dict(held.dtypes)["at"]).alias("at"), F.array("locale").alias("locales")))
    known = held.groupBy("project", "key").agg(F.flatten(F.collect_list("locales")).alias("known"), F.min("at").alias("first"))
    asked = locales.groupBy("project").agg(F.collect_set("locale").alias("asked"))
    rows = known.join(asked, "project").select("project", F.explode(F.array_except("asked", "known")).alias("locale"), "key", "first")
    return as_findings(rows.select("project", "locale", "key", "first.path", "first.line"), "missing", "used")


def _with_held(rows: DataFrame, tr: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``locales``, those that hold ``key`` as a leaf or a section; empty for none."""
    held = C.view(tr).held().select("_hash", F.col("project").alias("_p"), F.col("key").alias("_k"), "locales")
    hashed = rows.withColumn("_h", K.key_hash("project", key))
    on = (F.col("_h") == F.col("_hash")) & (F.col("project") == F.col("_p")) & (F.col(key) == F.col("_k"))
    none = F.array().cast("array<string>")
    return hashed.join(held, on, "left").select(*rows.columns, F.coalesce("locales", none).alias("locales"))


def _source_leaves(tr: DataFrame) -> DataFrame:
    return C.view(tr).folded().withColumnRenamed("locale", "present_in")


def diff_leaves(tr: DataFrame, rules: DataFrame | None, locales: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Every leaf another locale holds and this one lacks, plural forms kept apart."""
    asked = locales if selected is None else selected
    ranks = locales.select("project", F.col("locale").alias("present_in"), F.col("locale_rank").alias("_rank"), "is_base")
    # base leaves are looked for in every other selected locale, those of other locales in base when it is selected
    targets = asked.groupBy("project").agg(F.collect_set(F.when(~F.col("is_base"), F.col("locale"))).alias("_others"), F.collect_set(F.when(F.col("is_base"), F.col("locale"))).alias("_base"))
    leaves = _source_leaves(tr)
    rules = R.listed(rules)
    if isinstance(rules, R.ListedRules):  # what is ignored in every locale need not move
        leaves = R.without_ignored(leaves, rules, "missing", "dep_key")
    wanted = F.when(F.col("is_base"), F.col("_others")).otherwise(F.col("_base"))
    lacking = (
        _with_held(leaves, tr, "dep_key").join(ranks, ["project", "present_in"]).join(targets, "project")
        .withColumn("locale", F.explode(F.array_except(wanted, "locales")))
    )
    rows = lacking.withColumn("rank", F.when(F.col("is_base"), 0).otherwise(F.col("_rank"))).drop("locales", "_rank", "is_base", "_others", "_base")
    return R.without_ignored(rows, rules, "missing", "dep_key", "locale")


def first_per_key(rows: DataFrame) -> DataFrame:
    """One row per (locale, dep_key): the first by compared locale, then by leaf key."""
    shown = F.struct("present_in", V.display_value("value_type", "value").alias("value"))
    return (
        rows.groupBy("project", "locale", "dep_key")
        .agg(F.min_by(shown, F.struct("rank", "key")).alias("first"))
        .select("project", "locale", F.col("dep_key").alias("key"), "first.*")
    )


def missing_diff(tr: DataFrame, rules: DataFrame | None, locales: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Base leaves absent elsewhere; and, when base is selected, leaves of every other locale
    absent in base. Presence and rules depend on the folded key alone, so the forms and locales
    that fold into one row do so among the few rows that are left."""
    return as_findings(first_per_key(diff_leaves(tr, rules, locales, selected)), "missing", "diff")


def missing_plural(tr: DataFrame, dim: DataFrame, rules: DataFrame | None, locales: DataFrame) -> DataFrame:
    """Plural nodes short of a category their locale needs."""
    nodes = C.view(tr).plurals().select("project", "locale", "key", "forms")
    short = (
        nodes.join(C.required_categories(locales, dim), ["project", "locale"])
        .withColumn("missing", category_difference("categories", "forms"))
        .where(F.size("missing") > 0)
        .select("project", "locale", "key", F.array_join("missing", ", ").alias("categories"))
    )
    return as_findings(R.without_ignored(short, rules, "missing", "key", "locale"), "missing", "plural")


def category_difference(required, given):
    return F.array_except(required, given)


def missing(occ, tr, dim, rules, locales, types: list[str] | None = None, selected: DataFrame | None = None) -> DataFrame:
    """The requested kinds of missing keys, in the requested order (``type_rank``).

    ``selected``: the rows of ``locales`` to report on, all by default. Base is compared with all locales either way.
    """
    asked = locales if selected is None else selected
    types = MISSING_TYPES if types is None else types
    unknown = [t for t in types if t not in MISSING_TYPES]
    if unknown:
        raise ValueError(f"unknown missing types {unknown}")
    make = {
        "used": lambda: missing_used(occ, tr, rules, asked),
        "diff": lambda: missing_diff(tr, rules, locales, asked),
        "plural": lambda: missing_plural(tr, dim, rules, asked),
    }
    parts = [make[t]().withColumn("type_rank", F.lit(i)) for i, t in enumerate(types)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- unused --------------------------------------------------------------------------


def unused_leaves(tr: DataFrame, occ: DataFrame, rules: DataFrame | None, locales: DataFrame) -> DataFrame:
    """Exact leaves that nothing uses: what a removal takes away. Carries ``plural_parent``.

    Ignore rules, usage patterns and the external catalog look at the raw key, usage at the
    depluralized one.
    """
    catalog = C.view(tr)
    leaves = catalog.folded().join(locales.select("project", "locale"), ["project", "locale"], "left_semi")
    rules = R.listed(rules)
    if isinstance(rules, R.ListedRules):  # literals, which need no move
        leaves, rules = R.without_ignored(leaves, rules, "unused"), None
    # used keys go first, by an equi-join that leaves little for the joins on patterns; the tests commute
    # a folded key has no ancestor that its leaf has not
    rest = U.without_used(leaves, occ, "dep_key", U.section_nodes(catalog.leaves()))
    rest = R.without_ignored(rest, rules, "unused")
    rest = U.without_used_by_pattern(rest, occ)
    return rest.join(catalog.external(), ["project", "locale", "key"], "left_anti")


def collapse_plurals(placed: DataFrame) -> DataFrame:
    """A plural node all of whose children are given becomes one row for the parent, placed
    where its first child was (``order_key``). Groups hold at most eight rows.

    ``placed``: leaves with ``plural_parent`` and ``n_children``.
    """
    # values stay columns, which a plan that does not ask for them leaves out
    group = Window.partitionBy("project", "locale", "_node", "_is_plural")
    counted = (
        placed.withColumn("_node", F.coalesce("plural_parent", "key"))
        .withColumn("_is_plural", F.col("plural_parent").isNotNull())
        .withColumn("_first", F.min("key").over(group))
        .withColumn("_whole", F.col("_is_plural") & (F.count("*").over(group) == F.max("n_children").over(group)))
    )
    whole = F.col("_whole")
    return counted.where(~whole | (F.col("key") == F.col("_first"))).select(
        "project", "locale", F.when(whole, F.col("_node")).otherwise(F.col("key")).alias("key"), F.when(~whole, F.col("value")).alias("value"), F.col("key").alias("order_key")
    )


def unused(tr: DataFrame, occ: DataFrame, rules: DataFrame | None, locales: DataFrame) -> DataFrame:
    return unused_of(unused_leaves(tr, occ, rules, locales))


def unused_of(leaves: DataFrame) -> DataFrame:
    """The findings of ``unused_leaves``."""
    hits = leaves.withColumn("value", V.display_value("value_type", "value"))
    return as_findings(collapse_plurals(hits), "unused", None)


def select_unused(findings: DataFrame, leaves: DataFrame, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Findings whose key or an ancestor matches, and the leaves those findings cover."""
    from polyglint.functions.patterns import match_regex

    regex = match_regex(F.lit(pattern))
    rows = findings.where(F.exists(K.ancestors("key"), lambda k: F.rlike(k, regex)))
    walks = leaves.select("project", "locale", "key", F.explode(K.ancestors("key")).alias("node"))
    covered = walks.join(rows.select("project", "locale", F.col("key").alias("node")), ["project", "locale", "node"], "left_semi")
    kept = leaves.join(covered.select("project", "locale", "key"), ["project", "locale", "key"], "left_semi")
    return rows, kept


# --- values --------------------------------------------------------------------------


def _comparable(value_type: str, value: str):
    """Sequences compare in order, mappings in any order: JSON text with sorted keys, where there are mappings and the
    text parses; else the text itself, numbers as written."""
    sorted_keys = F.coalesce(F.to_json(F.try_parse_json(F.col(value))), F.col(value))
    return F.when(F.col(value_type).isin("seq", "map") & F.col(value).contains("{"), sorted_keys).otherwise(F.col(value))


def _beside_base(tr: DataFrame, locales: DataFrame) -> DataFrame:
    """Each leaf of another locale next to the base leaf of the same key."""
    leaves = C.view(tr).leaves().select("project", "locale", "key", "value_type", "value")
    base = (
        leaves.join(_base(locales), ["project", "locale"], "left_semi")
        .select("project", "key", F.col("value_type").alias("base_type"), F.col("value").alias("base_value"))
    )
    others = leaves.join(_others(locales).select("project", "locale"), ["project", "locale"], "left_semi")
    return K.join_on_hash(others, base, ["project", "key"], "inner")


def eq_base(tr: DataFrame, rules: DataFrame | None, locales: DataFrame) -> DataFrame:
    same = (F.col("value_type") == F.col("base_type")) & _comparable("value_type", "value").eqNullSafe(_comparable("base_type", "base_value"))
    rows = _beside_base(tr, locales).where(same).select("project", "locale", "key", V.display_value("value_type", "value").alias("value"))
    return as_findings(R.without_ignored(rows, rules, "eq_base", "key", "locale"), "eq_base", None)


def inconsistent_placeholders(tr: DataFrame, rules: DataFrame | None, locales: DataFrame) -> DataFrame:
    rows = (
        _beside_base(tr, locales)
        .where((F.col("value_type") == "str") & (F.col("base_type") == "str"))
        .withColumn("own", V.placeholder_set("value"))
        .withColumn("base", V.placeholder_set("base_value"))
        .where(~placeholder_set_equal("own", "base"))
        .select("project", "locale", "key", "value", F.array_join("own", ", ").alias("variables"), F.array_join("base", ", ").alias("base_variables"))
    )
    return as_findings(R.without_ignored(rows, rules, "interpolations"), "consistent_interpolations", "interpolations")


def placeholder_set_equal(a, b):
    """Both sides sorted and distinct, so equal sets are equal arrays."""
    return F.col(a) == F.col(b)


def reserved_placeholders(tr: DataFrame, locales: DataFrame) -> DataFrame:
    rows = (
        C.view(tr).leaves()
        .where(F.col("value_type") == "str")
        .where(F.col("value").contains("%{"))
        .join(locales.select("project", "locale"), ["project", "locale"], "left_semi")
        .withColumn("hits", V.reserved_names("value"))
        .where(F.size("hits") > 0)
        .select("project", "locale", "key", "value", F.array_join("hits", ", ").alias("names"))
    )
    return as_findings(rows, "reserved_interpolations", "reserved")


# --- findings that rules may suppress -----------------------------------------------


class _Concerned(C.CatalogView):
    """A catalog down to the keys that a rule of the kind matches: a test of presence or use for another key decides on
    nothing that a rule may suppress."""

    def __init__(self, tr: DataFrame, rules: R.ListedRules, kind: str):
        super().__init__(tr)
        self._rules, self._kind = rules, kind

    def _hit(self, key):
        return R.may_match(self._rules, self._kind, key)

    def folded(self) -> DataFrame:
        """The forms of a plural node stay together if a rule matches the node or any of them: they may become one finding."""
        node = F.col("plural_parent")
        named = F.array(node, *[F.concat(node, F.lit(f".{s}")) for s in K.PLURAL_SUFFIXES])
        return super().folded().where(F.when(node.isNull(), self._hit("key")).otherwise(F.exists(named, self._hit)))

    def present(self) -> DataFrame:
        return super().present().where(self._hit("key"))


def suppressible(occ, tr: DataFrame, dim: DataFrame, rules: DataFrame | R.ListedRules, locales: DataFrame) -> DataFrame:
    """(project, kind, locale, key): the findings made with no rules, less those that no rule of their kind matches.

    Keys meet the literal rules where they stand, before anything moves: few keys are concerned, and only these are looked
    up. With more rules than become literals all findings are made.
    """
    rules = R.listed(rules)
    few = isinstance(rules, R.ListedRules)

    def kept(df: DataFrame, kind: str) -> DataFrame:
        return df.where(R.may_match(rules, kind)) if few else df

    def catalog(kind: str):
        return _Concerned(tr, rules, kind) if few else tr

    leaves, usage = C.internal(tr), U.view(occ)
    calls = usage.narrowed(lambda df: kept(df, "missing"))
    parts = [
        ("missing", missing_used(calls, tr, None, locales)),
        ("missing", diff_leaves(catalog("missing"), None, locales).select("project", "locale", F.col("dep_key").alias("key"))),
        ("missing", missing_plural(tr, dim, None, locales)),
        ("unused", unused(catalog("unused"), usage, None, locales)),
        ("eq_base", eq_base(kept(tr, "eq_base"), None, locales)),
        ("interpolations", inconsistent_placeholders(kept(tr, "interpolations"), None, locales)),
    ]
    return U.merge_scans(*[kept(p.select("project", F.lit(kind).alias("kind"), "locale", "key"), kind) for kind, p in parts])


def preview(groups: DataFrame, item: str, n: int = 3) -> DataFrame:
    """Per project the first ``n`` items and how many more there are.

    Each group keeps only its smallest ``n`` while it aggregates, so nothing is gathered.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("project").orderBy(item)
    counts = groups.groupBy("project").agg(F.count("*").alias("n_items"))
    top = groups.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    shown = top.groupBy("project").agg(F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("shown"))
    return counts.join(shown, "project").select(
        "project",
        F.when(F.col("n_items") > n, F.concat("shown", F.lit(", and "), (F.col("n_items") - n).cast("string"), F.lit(" more"))).otherwise(F.col("shown")).alias("preview"),
    )
