"""What a project looks like: layout, locales, base locale, source and relative-key roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyglint.functions import paths as P

# Where catalogs, sources and generated code are looked for, in order.
CATALOG_DIRS = ["config/locales", "locales", "app/locales"]
SOURCE_DIRS = ["app/", "lib/"]
GENERATED_DIRS = [
    "app/assets/builds",
    "app/assets/build",
    "app/webpack",
    "app/javascript/node_modules",
    "lib/assets",
    "lib/node_modules",
]
SOURCE_EXTENSIONS = ["rb", "rake", "erb", "haml", "slim", "js", "jsx", "mjs", "es6", "ts", "tsx", "vue"]
DEFAULT_RELATIVE_ROOTS = ["app/controllers", "app/helpers", "app/mailers", "app/presenters", "app/views"]
SKIPPED_DIRS = ["node_modules", "tmp", "coverage", ".git", ".yardoc"]
# The read pattern of each layout.
LAYOUT_PATTERNS = {
    "flat": "%{locale}",
    "namespaced": "*.%{locale}",
    "locale_dir": "%{locale}/*",
    "locale_dir_deep": "%{locale}/**/*",
    "subdir_flat": "**/%{locale}",
    "subdir_namespaced": "**/*.%{locale}",
}


def _catalog_files(files: DataFrame) -> DataFrame:
    """(project, path, dir, rank): catalog files under each candidate directory."""
    skipped = "(?:^|/)(?:" + "|".join(d.replace(".", r"\.") for d in SKIPPED_DIRS) + ")/"
    dirs = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(d).alias("dir")) for i, d in enumerate(CATALOG_DIRS)])
    return (
        files.where(F.col("path").rlike(r"\.ya?ml\z") & ~F.col("path").rlike(skipped))
        .select("project", "path", F.explode(dirs).alias("d"))
        .where(F.col("path").startswith(F.concat(F.col("d.dir"), F.lit("/"))))
        .select("project", "path", "d.rank", "d.dir")
    )


def catalog_root(files: DataFrame) -> DataFrame:
    """The first candidate directory that holds catalog files, per project."""
    return _catalog_files(files).groupBy("project").agg(F.min_by("dir", "rank").alias("catalog_dir"), F.min("rank").alias("_r")).drop("_r")


def layout_profile(files: DataFrame) -> DataFrame:
    """Files by layout and extension under the catalog root, with each read pattern."""
    rooted = _catalog_files(files).join(catalog_root(files), "project").where(F.col("dir") == F.col("catalog_dir"))
    shape = P.layout_shape(F.substring(F.col("path"), F.length("dir") + 2, F.length("path")))
    patterns = F.create_map(*[x for k, v in LAYOUT_PATTERNS.items() for x in (F.lit(k), F.lit(v))])
    return (
        rooted.select("project", "dir", shape.alias("shape"), F.substring_index("path", ".", -1).alias("ext"))
        .groupBy("project", "dir", "shape", "ext")
        .agg(F.count("*").alias("n_files"))
        .withColumn("pattern", F.concat("dir", F.lit("/"), F.try_element_at(patterns, F.coalesce("shape", F.lit(""))), F.lit("."), "ext"))
    )


def majority_extension(profile: DataFrame) -> DataFrame:
    """The most common extension; the last by name among equals."""
    counts = profile.groupBy("project", "ext").agg(F.sum("n_files").alias("n"))
    return counts.groupBy("project").agg(F.max_by("ext", F.struct("n", "ext")).alias("ext"))


def write_target(read: DataFrame, base: DataFrame) -> DataFrame:
    """The first of three candidate targets that the read patterns read back as base.

    ``base``: project, locale, dir, ext. Null when none fits.
    """
    dir_, ext = F.col("dir"), F.col("ext")
    spelled = [
        F.concat(dir_, F.lit("/%{locale}."), ext),
        F.concat(dir_, F.lit("/common.%{locale}."), ext),
        F.concat(dir_, F.lit("/%{locale}/common."), ext),
    ]
    candidates = base.select("project", "locale", F.posexplode(F.array(*spelled)).alias("rank", "target"))
    tried = candidates.join(read.select("project", "pattern"), "project", "left")
    fits = P.locale_of_path("pattern", P.interpolate_locale("target", "locale")) == F.col("locale")
    return tried.groupBy("project").agg(F.min_by(F.when(fits, F.col("target")), F.when(fits, F.col("rank"))).alias("target"))


def search_roots(files: DataFrame) -> DataFrame:
    """Candidate source directories and generated-code directories that hold files."""
    names = [("source", d.rstrip("/"), i) for i, d in enumerate(SOURCE_DIRS)] + [("generated", d, i) for i, d in enumerate(GENERATED_DIRS)]
    wanted = F.array(*[F.struct(F.lit(k).alias("role"), F.lit(d).alias("dir"), F.lit(i).alias("rank")) for k, d, i in names])
    hits = F.filter(wanted, lambda w: F.startswith(F.col("path"), F.concat(w["dir"], F.lit("/"))))
    return files.select("project", F.explode(hits).alias("w")).select("project", "w.*").distinct()


# The identifier boundary is the point: format(".2f") ends in t(". as well.
_RELATIVE_CALL = r"""(?<![A-Za-z0-9_])t(?:ranslate)?!? *\(? *["']\."""


def uses_relative_key(content) -> Column:
    return F.col(content).rlike(_RELATIVE_CALL)


def relative_key_roots(files: DataFrame) -> DataFrame:
    """Directories of source files that call with a leading-dot literal, plus the usual ones
    that exist (``detected`` tells them apart)."""
    ext = F.substring_index("path", ".", -1)
    sources = files.where(ext.isin(SOURCE_EXTENSIONS))
    found = sources.where(uses_relative_key("content")).select("project", P.enclosing_root("path").alias("root")).where("root is not null").distinct()
    usual = F.filter(
        F.array(*[F.lit(d) for d in DEFAULT_RELATIVE_ROOTS]), lambda d: F.startswith(F.col("path"), F.concat(d, F.lit("/")))
    )
    standard = files.select("project", F.explode(usual).alias("root")).distinct()
    both = found.withColumn("standard", F.lit(False)).unionByName(standard.withColumn("standard", F.lit(True)))
    return both.groupBy("project", "root").agg((~F.bool_or("standard")).alias("detected"))


_DEFAULT_LOCALE = r"""\A[^#]*?\.default_locale\s*=\s*(?::([A-Za-z0-9_-]+)|"([A-Za-z0-9_-]+)"|'([A-Za-z0-9_-]+)')"""


def default_locale_in(line) -> Column:
    """The literal a line assigns to ``default_locale``; null otherwise."""
    code = F.regexp_replace(F.col(line), r"(?s)#.*", "")
    groups = [F.nullif(F.regexp_extract(code, _DEFAULT_LOCALE, i), F.lit("")) for i in (1, 2, 3)]
    return F.coalesce(*groups)


def base_locale(files: DataFrame, locales: DataFrame) -> DataFrame:
    """Per project: the first assigned default locale by file order; else the only locale of
    the files, else ``en``, else the first by name."""
    rank = F.when(F.col("path") == "config/application.rb", 0).when(F.col("path").rlike(r"\Aconfig/environments/[^/]+\.rb\z"), 1).when(
        F.col("path").rlike(r"\Aconfig/initializers/[^/]+\.rb\z"), 2
    )
    lines = (
        files.withColumn("rank", rank)
        .where(F.col("rank").isNotNull() & F.col("content").contains(".default_locale"))
        .select("project", "path", "rank", F.posexplode(F.split("content", "\n")).alias("i", "line"))
        .withColumn("locale", default_locale_in("line"))
        .where("locale is not null")
    )
    assigned = lines.groupBy("project").agg(
        F.min_by("locale", F.struct("rank", "path", "i")).alias("assigned"),
        F.min_by(F.concat("path", F.lit(":"), (F.col("i") + 1).cast("string")), F.struct("rank", "path", "i")).alias("assigned_at"),
    )
    known = locales.groupBy("project").agg(F.min("locale").alias("first"), F.count_distinct("locale").alias("n"), F.bool_or(F.col("locale") == "en").alias("has_en"))
    return assigned.join(known, "project", "full_outer").select(
        "project",
        F.coalesce("assigned", F.when(F.col("n") == 1, F.col("first")), F.when(F.col("has_en"), "en"), "first", F.lit("en")).alias("base_locale"),
        "assigned_at",
    )

