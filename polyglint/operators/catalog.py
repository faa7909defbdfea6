"""The catalog relation: load order, conflicts, key ancestry and plural nodes.

``translation`` has one row per leaf: project, locale, key, segments, depth, value_type,
value, path, ordinal, external.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import paths as P
from polyglint.functions import values as V

# Locales, and the plural categories they need.
CATEGORIES_BY_LOCALES = [
    (
        [
            "bg", "bn", "ca", "da", "de", "de-AT", "de-CH", "de-DE", "el", "el-CY", "en", "en-AU", "en-CA",
            "en-CY", "en-GB", "en-IE", "en-IN", "en-NZ", "en-TT", "en-US", "en-ZA", "eo", "es", "es-419", "es-AR",
            "es-CL", "es-CO", "es-CR", "es-EC", "es-ES", "es-MX", "es-NI", "es-PA", "es-PE", "es-US", "es-VE",
            "et", "eu", "fi", "fy", "gl", "he", "hu", "is", "it", "it-CH", "ka", "kk", "mn", "nb", "ne", "nl",
            "nn", "oc", "pt", "pt-BR", "sc", "st", "sv", "sv-SE", "sw", "ta", "tr", "ur", "fr", "fr-CA", "fr-CH",
            "fr-FR", "hi", "hi-IN", "mg", "ml", "mr-IN", "or", "pa", "tl", "lv", "mk",
        ],
        ["one", "other"],
    ),
    (
        [
            "az", "fa", "id", "ja", "km", "kn", "ko", "lo", "ms", "pap-AW", "pap-CW", "th", "vi", "wo", "zh-CN",
            "zh-HK", "zh-TW", "zh-YUE",
        ],
        ["other"],
    ),
    (
        [
            "bs", "hr", "sr", "cs", "sk", "ro", "lt",
        ],
        ["one", "few", "other"],
    ),
    (
        [
            "be", "ru", "uk", "pl",
        ],
        ["one", "few", "many", "other"],
    ),
    (
        [
            "gd", "hsb", "sl",
        ],
        ["one", "two", "few", "other"],
    ),
    (
        [
            "ar",
        ],
        ["zero", "one", "two", "few", "many", "other"],
    ),
]


def plural_dim(spark) -> DataFrame:
    """(locale, categories): a constant of about 110 rows."""
    rows = [(locale, categories) for locales, categories in CATEGORIES_BY_LOCALES for locale in locales]
    return spark.createDataFrame(rows, "locale string, categories array<string>")


def required_categories(locales: DataFrame, dim: DataFrame) -> DataFrame:
    """Each locale of the dimension with its categories; ``pt-br`` also answers to ``pt-BR``.

    A locale the table does not know drops out.
    """
    named = locales.select("project", "locale").withColumn(
        "spelling",
        F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("locale").alias("name")), F.struct(F.lit(1).alias("rank"), K.alternate_locale("locale").alias("name")))),
    )
    hits = named.join(dim.withColumnRenamed("locale", "name"), F.col("spelling.name") == F.col("name"))
    return hits.groupBy("project", "locale").agg(F.min_by("categories", "spelling.rank").alias("categories"))


# --- load order ----------------------------------------------------------------------


def _per_file(tr: DataFrame) -> DataFrame:
    """One row per key and file: the last value, at the first position."""
    rest = [c for c in tr.columns if c not in ("project", "locale", "key", "path", "ordinal")]
    return (
        tr.groupBy("project", "locale", "key", "path")
        .agg(F.max_by(F.struct(*rest), "ordinal").alias("last"), F.min("ordinal").alias("ordinal"))
        .select("project", "locale", "key", "path", "ordinal", "last.*")
    )


def last_write_wins(tr: DataFrame) -> DataFrame:
    """The key's row in the last file by path. Plain aggregates, so a hot key combines map-side."""
    rest = [c for c in tr.columns if c not in ("project", "locale", "key")]
    return (
        _per_file(tr)
        .groupBy("project", "locale", "key")
        .agg(F.max_by(F.struct(*rest), "path").alias("last"))
        .select("project", "locale", "key", "last.*")
    )


def conflicts(tr: DataFrame) -> DataFrame:
    """Each replacement by a later file that changes the typed value."""
    files = _per_file(tr)
    order = Window.partitionBy("project", "locale", "key").orderBy("path")
    seen = F.struct("path", "value_type", "value")
    return (
        files.withColumn("old", F.lag(seen).over(order))
        .where(F.col("old").isNotNull())
        .where(~(F.struct("value_type", "value").eqNullSafe(F.struct("old.value_type", "old.value"))))
        .select("project", "locale", "key", F.col("old.path").alias("old_path"), F.col("path").alias("new_path"))
    )


def duplicate_keys(rows: DataFrame) -> DataFrame:
    """Earlier duplicates of a key in one document, each with the one that replaces it next."""
    order = Window.partitionBy("project", "locale", "path", "key").orderBy("ordinal")
    return (
        rows.withColumn("by_ordinal", F.lead("ordinal").over(order))
        .where(F.col("by_ordinal").isNotNull())
        .select("project", "locale", "path", "key", "ordinal", "by_ordinal")
    )


def catalog_warnings(conflict: DataFrame, duplicate: DataFrame, null_key: DataFrame, locales: DataFrame) -> DataFrame:
    """All load warnings, each text once, ranked by the first locale that gives it."""
    texts = (
        conflict.select(
            "project",
            "locale",
            F.concat(F.lit("`"), "locale", F.lit("."), "key", F.lit("` has different values in "), "old_path", F.lit(" and "), "new_path").alias("warning"),
        )
        .unionByName(
            duplicate.select(
                "project",
                "locale",
                F.concat("path", F.lit(":"), F.col("ordinal").cast("string"), F.lit(": `"), "key", F.lit("` appears again at "), F.col("by_ordinal").cast("string")).alias("warning"),
            )
        )
        .unionByName(
            null_key.select("project", "locale", F.concat("path", F.lit(": skipping a null key under `"), "parent", F.lit("`")).alias("warning"))
        )
    )
    ranked = texts.join(locales.select("project", "locale", "locale_rank"), ["project", "locale"])
    return ranked.groupBy("project", "warning").agg(F.min("locale_rank").alias("locale_rank"))


def with_external(tr: DataFrame, external: DataFrame) -> DataFrame:
    """The catalog plus the external one, which only presence tests look at."""
    return tr.withColumn("external", F.lit(False)).unionByName(external.withColumn("external", F.lit(True)))


def internal(tr: DataFrame) -> DataFrame:
    return tr.where(~F.col("external"))


class CatalogView:
    """What checks read of a catalog, made from its rows whenever it is asked for."""

    def __init__(self, tr: DataFrame):
        self._tr = tr

    def leaves(self) -> DataFrame:
        """Internal leaves."""
        return internal(self._tr)

    def folded(self) -> DataFrame:
        """Internal leaves with ``dep_key``, ``plural_parent`` and ``n_children``."""
        return depluralized_leaves(self.leaves())

    def plurals(self) -> DataFrame:
        return plural_nodes(self.leaves())

    def present(self) -> DataFrame:
        """(project, locale, key) of leaves and sections, external ones included."""
        return present_keys(self._tr)

    def held(self) -> DataFrame:
        """(_hash, project, key, locales): each key of ``present`` once, with the locales that hold it, dealt out by key;
        ``_hash`` is ``K.key_hash``, so that joins on a key move this side once and sort numbers."""
        hashed = self.present().withColumn("_hash", K.key_hash("project", "key")).repartition("_hash", "project", "key")
        return hashed.groupBy("_hash", "project", "key").agg(F.collect_set("locale").alias("locales"))

    def external(self) -> DataFrame:
        return present_keys(self._tr.where("external"))


def view(tr: DataFrame | CatalogView) -> CatalogView:
    return tr if isinstance(tr, CatalogView) else CatalogView(tr)


# --- ancestry ------------------------------------------------------------------------


def interior_nodes(tr: DataFrame) -> DataFrame:
    """Every proper ancestor of a leaf. Paths are walked from the distinct parents, not from each leaf."""
    parents = tr.where(F.col("key").contains(".")).select("project", "locale", K.parent_key("key").alias("parent")).distinct()
    return parents.select("project", "locale", F.explode(K.ancestors("parent")).alias("key")).distinct()


def present_keys(tr: DataFrame) -> DataFrame:
    """Leaves and interior nodes, of the catalog and of the external one, for tests of membership: leaves are not moved
    to be distinct, so a key that two rows give, or that is a node too, comes again."""
    return tr.select("project", "locale", "key").unionByName(interior_nodes(tr))


def _child_links(tr: DataFrame) -> DataFrame:
    """(parent, child, is_leaf) for every step from a top-level key down to each leaf."""
    links = F.transform(
        K.proper_ancestors("key"),
        lambda node, i: F.struct(
            node.alias("parent"),
            F.substring_index(F.substring(F.col("key"), F.length(node) + 2, F.length("key")), ".", 1).alias("child"),
            (i == K._n_segments(F.col("key")) - 2).alias("is_leaf"),
        ),
    )
    return tr.select("project", "locale", F.explode(links).alias("link")).select("project", "locale", "link.*")


def children(tr: DataFrame) -> DataFrame:
    """Immediate child names per node."""
    return _child_links(tr).select("project", "locale", "parent", "child").distinct()


def plural_forms(tr: DataFrame) -> DataFrame:
    """Per parent: number of children, and those that are plural suffixes (eight at most)."""
    return children(tr).groupBy("project", "locale", "parent").agg(
        F.count("*").alias("n_children"),
        F.array_sort(F.collect_set(F.when(F.col("child").isin(K.PLURAL_SUFFIXES), F.col("child")))).alias("forms"),
    )


def plural_flags(tr: DataFrame) -> DataFrame:
    """Every parent with ``is_plural``: all children are leaves named as plural forms.

    Leaves are added up at their parents, then each parent counts for the nodes above it; a child
    that is also interior shows up as a link that is not a leaf. ``forms`` holds at most eight
    names, ``n_children`` counts links, one for each leaf below. The names are gathered as bits: a
    collected set would sort the links of every leaf before they combine.
    """

    def bit(child: Column) -> Column:
        return F.coalesce(*[F.when(child == s, F.lit(1 << i)) for i, s in enumerate(K.PLURAL_SUFFIXES)], F.lit(0))

    last = K.last_segment("key")
    direct = (
        tr.where(F.col("key").contains("."))
        .groupBy("project", "locale", K.parent_key("key").alias("parent"))
        .agg(F.bool_and(last.isin(K.PLURAL_SUFFIXES)).alias("is_plural"), F.bit_or(bit(last)).alias("_forms"), F.count("*").alias("n_children"))
    )
    own = F.struct("parent", "is_plural", "_forms", "n_children")
    above = F.transform(
        K.proper_ancestors("parent"),
        lambda node: F.struct(
            node.alias("parent"),
            F.lit(False).alias("is_plural"),
            bit(F.substring_index(F.substring(F.col("parent"), F.length(node) + 2, F.length("parent")), ".", 1)).alias("_forms"),
            F.col("n_children").alias("n_children"),
        ),
    )
    forms = F.array_compact(F.array(*[F.when(F.col("_forms").bitwiseAND(F.lit(1 << i)) != 0, F.lit(s)) for i, s in enumerate(K.PLURAL_SUFFIXES)]))
    links = direct.select("project", "locale", F.explode(F.concat(F.array(own), above)).alias("link")).select("project", "locale", "link.*")
    nodes = links.groupBy("project", "locale", "parent").agg(
        F.bool_and("is_plural").alias("is_plural"), F.bit_or("_forms").alias("_forms"), F.sum("n_children").alias("n_children")
    )
    return nodes.select("project", "locale", "parent", "is_plural", forms.alias("forms"), "n_children")


def plural_nodes(tr: DataFrame) -> DataFrame:
    return plural_flags(tr).where("is_plural").select("project", "locale", F.col("parent").alias("key"), "forms", "n_children")


def with_plural_parent(leaves: DataFrame, plurals: DataFrame | None = None) -> DataFrame:
    """Add ``plural_parent`` (null unless the leaf sits under a plural node) and ``n_children``.

    Leaves that are no form cannot match and do not move.
    """
    plurals = plural_nodes(leaves) if plurals is None else plurals
    nodes = plurals.select("project", "locale", F.col("key").alias("plural_parent"), "n_children")
    is_form = K.last_segment("key").isin(K.PLURAL_SUFFIXES) & F.col("key").contains(".")
    is_form = F.coalesce(is_form, F.lit(False))
    named = nodes.withColumnRenamed("project", "_p").withColumnRenamed("locale", "_l")
    forms = leaves.where(is_form).join(named, (F.col("_p") == F.col("project")) & (F.col("_l") == F.col("locale")) & (K.parent_key("key") == F.col("plural_parent")), "left")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("plural_parent", "string"), ("n_children", "bigint"))]
    return forms.drop("_p", "_l").unionByName(leaves.where(~is_form).select("*", *none))


def depluralized_leaves(leaves: DataFrame, plurals: DataFrame | None = None) -> DataFrame:
    """Add ``dep_key`` (and keep ``plural_parent``, ``n_children``). A leaf's parent always has
    children in its own locale, so that locale decides alone; ``0`` and ``1`` make a plural
    node but are not cut off."""
    cut = F.col("plural_parent").isNotNull() & K.is_plural_category("key")
    return with_plural_parent(leaves, plurals).withColumn("dep_key", F.when(cut, F.col("plural_parent")).otherwise(F.col("key")))


def depluralize(keys: DataFrame, tr: DataFrame, locales: DataFrame) -> DataFrame:
    """Add ``dep_key`` to any (project, locale, key): the locale decides when the parent has
    children there, else the base locale does.

    Parents that are plural nodes in some locale meet the keys once, with the word of every
    locale; keys that cannot be cut do not move. That side is the small one and has a parent
    once, so it is hashed and the keys are not sorted.
    """
    flags = plural_flags(tr).select("project", "locale", "parent", "is_plural")
    base = locales.where("is_base").select("project", F.col("locale").alias("_bl"))
    nodes = (
        flags.join(base, "project", "left")
        .groupBy(F.col("project").alias("_p"), F.col("parent").alias("_parent"))
        .agg(
            F.map_from_entries(F.collect_list(F.struct("locale", "is_plural"))).alias("_own"),
            F.bool_or(F.when(F.col("locale") == F.col("_bl"), F.col("is_plural"))).alias("_base"),
            F.bool_or("is_plural").alias("_any"),
        )
        .where("_any")
        .drop("_any")
    )
    can_cut = F.coalesce(K.is_plural_category("key") & F.col("key").contains("."), F.lit(False))
    parent = K.parent_key("key")
    plural = F.coalesce(F.try_element_at("_own", F.col("locale")), F.col("_base"), F.lit(False))
    cut = (
        keys.where(can_cut)
        .join(nodes.hint("shuffle_hash"), (F.col("_p") == F.col("project")) & (F.col("_parent") == parent), "left")
        .withColumn("dep_key", F.when(plural, parent).otherwise(F.col("key")))
        .drop("_p", "_parent", "_own", "_base")
    )
    return cut.unionByName(keys.where(~can_cut).withColumn("dep_key", F.col("key")))


# --- files and orders ----------------------------------------------------------------


def file_locales(entries: DataFrame) -> DataFrame:
    """Locales found at the top of each file."""
    return entries.groupBy("project", "path").agg(F.array_sort(F.collect_set("locale")).alias("locales"))


def load_check(tr: DataFrame) -> DataFrame:
    """What a set of read patterns reads: keys, files and locales per project."""
    return tr.groupBy("project").agg(
        F.count("*").alias("key_count"),
        F.count_distinct("path").alias("files_read"),
        F.array_sort(F.collect_set("locale")).alias("locales"),
    )


def locales_from_paths(files: DataFrame, read: DataFrame, base: DataFrame) -> DataFrame:
    """Locales the file paths name under the read patterns, base first and then sorted."""
    named = (
        files.join(read.where(F.col("pattern").contains("%{locale}")), "project")
        .select("project", P.locale_of_path("pattern", "path").alias("locale"))
        .where("locale is not null")
        .distinct()
    )
    return locale_order(named, base)


def locale_order(named: DataFrame, base: DataFrame) -> DataFrame:
    """``locale_dim``: the base locale always takes part and comes first, the rest by name."""
    bases = base.select("project", F.col("locale").alias("base_locale"))
    every = named.select("project", "locale").unionByName(base.select("project", "locale")).distinct()
    order = Window.partitionBy("project").orderBy(F.col("locale") != F.col("base_locale"), "locale")
    return every.join(bases, "project").select(
        "project", "locale", (F.row_number().over(order) - 1).alias("locale_rank"), (F.col("locale") == F.col("base_locale")).alias("is_base")
    )


def sorted_keys(tr: DataFrame) -> DataFrame:
    """Leaves by dotted key."""
    return tr.orderBy("project", "locale", "key")


def canonical_order(tr: DataFrame) -> DataFrame:
    """Leaves level by level, as documents are written."""
    return tr.orderBy("project", "locale", "segments")


def keep_order(routed: DataFrame) -> DataFrame:
    """Source order within a destination; the file's own keys before keys routed in."""
    return routed.orderBy("project", "path", F.col("origin_path") != F.col("path"), "origin_path", "ordinal")


def statistics(tr: DataFrame, locales: DataFrame) -> DataFrame:
    """Per project: counts, integer means, and the mean depth to one decimal."""
    counts = locales.groupBy("project").agg(
        F.count("*").alias("locale_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("locale_rank", "locale"))), lambda x: x["locale"]), ", ").alias("locales"),
    )
    leaves = (
        tr.join(locales.select("project", "locale"), ["project", "locale"], "left_semi")
        .groupBy("project")
        .agg(F.count("*").alias("key_count"), F.sum("depth").alias("_segments"), F.sum(F.length(V.display_value("value_type", "value"))).alias("_chars"))
    )
    n = F.coalesce("key_count", F.lit(0))
    per_key = F.nullif(n, F.lit(0))
    return counts.join(leaves, "project", "left").select(
        "project",
        "locales",
        n.alias("key_count"),
        "locale_count",
        F.call_function("div", n, "locale_count").alias("per_locale_avg"),
        F.coalesce(F.format_number(F.col("_segments") / per_key, 1), F.lit("0.0")).alias("key_segments_avg"),
        F.coalesce(F.call_function("div", F.col("_chars"), per_key), F.lit(0)).alias("value_chars_avg"),
    )


def null_key_rows(entries: DataFrame) -> DataFrame:
    """Map entries whose unquoted key reads as null; they are skipped with a warning.

    ``entries``: project, locale, path, parent, name, quoted.
    """
    return entries.where(~F.col("quoted") & (V.typed_scalar("name") == "null"))
