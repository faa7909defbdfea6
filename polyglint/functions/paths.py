"""Column functions over file paths: globs, locale parts, layouts, template paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyglint.functions.keys import _col, looks_like_locale, regex_group

# Files that are never searched, whatever the settings say.
ALWAYS_EXCLUDED = [
    "*.jpg", "*.jpeg", "*.png", "*.gif", "*.svg", "*.ico", "*.eot", "*.otf", "*.ttf", "*.woff", "*.woff2", "*.pdf",
    "*.css", "*.sass", "*.scss", "*.less", "*.yml", "*.json", "*.zip", "*.tar.gz", "*.swf", "*.flv", "*.mp3",
    "*.wav", "*.flac", "*.webm", "*.mp4", "*.ogg", "*.opus", "*.webp", "*.map", "*.xlsx",
]


def glob_to_regex(glob: str) -> str:
    """A shell glob on a whole path; ``*`` and ``?`` also cross ``/``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = glob[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = close
        elif c == "{" and "}" in glob[i:]:
            close = glob.index("}", i)
            out.append("(?:" + "|".join(glob_to_regex(a) for a in glob[i + 1 : close].split(",")) + ")")
            i = close
        else:
            out.append(re.escape(c))
        i += 1
    return re.sub(r"(\.\*)+", ".*", "".join(out))


def globs_regex(globs: list[str]) -> str:
    """One regex for a list; a glob without ``*`` also covers what lies below it."""
    forms = [g for glob in globs for g in ([glob] if "*" in glob else [glob.rstrip("/"), glob.rstrip("/") + "/*"])]
    return r"(?s)\A(?:" + "|".join(glob_to_regex(g) for g in forms) + r")\z"


def path_ancestors(path) -> Column:
    """The path and each directory above it."""
    parts = F.split(_col(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def interpolate_locale(template, locale) -> Column:
    """``%{locale}`` -> locale, ``%%`` -> ``%``."""
    locale = _col(locale)
    pieces = F.transform(F.split(_col(template), "%%"), lambda p: F.replace(p, F.lit("%{locale}"), locale))
    return F.array_join(pieces, "%")


def replace_locale(path, source, target) -> Column:
    """Every locale part of a path (after ``/ . -`` or the start, before ``/`` or ``.``)."""
    path, source = _col(path), _col(source)
    regex = F.concat(F.lit(r"(?<=\A|[/.-])\Q"), source, F.lit(r"\E(?=[/.])"))
    return F.when(source == "", path).otherwise(F.regexp_replace(path, regex, _col(target)))


# Stands in for the locale in a prepared target; never part of a path.
_LOCALE_SLOT = "\u0001"


def target_template(target) -> Column:
    r"""A write target as a regex replacement, made once per rule: ``\1``..``\9`` become groups,
    ``%{locale}`` a slot, ``%%`` a percent sign, and everything else is escaped."""
    slotted = F.array_join(
        F.transform(F.split(_col(target), "%%"), lambda p: F.replace(p, F.lit("%{locale}"), F.lit(_LOCALE_SLOT))), "%"
    )
    tokens = F.regexp_extract_all(slotted, F.lit(r"(?s)(\\[0-9]|\\|[^\\]+)"), F.lit(1))
    made = F.transform(
        tokens,
        lambda t: F.when(t == "\\0", "")
        .when(t.rlike(r"\A\\[1-9]\z"), F.replace(t, F.lit("\\"), F.lit("$")))
        .otherwise(F.regexp_replace(t, r"([\\$0-9])", r"\\$1")),
    )
    return F.array_join(made, "")


def with_locale(path, locale) -> Column:
    """A path made from a prepared target, with the locale in its place."""
    return F.replace(_col(path), F.lit(_LOCALE_SLOT), _col(locale))


def fill_template(template, locale, key, regex) -> Column:
    """The path a prepared target gives for a key its pattern (``pattern_regex``) matches."""
    return with_locale(F.regexp_replace(_col(key), _col(regex), _col(template)), locale)


_READ_TOKEN = r"(?s)(%\{locale\}|\*+|[./\\]|.)"


def read_pattern_regex(pattern) -> Column:
    """A read pattern as an anchored regex whose group 1 is the locale."""
    tokens = F.regexp_extract_all(_col(pattern), F.lit(_READ_TOKEN), F.lit(1))
    body = F.transform(
        tokens,
        lambda t: F.when(t == "%{locale}", F.lit("([^/.]+)"))
        .when(t == "**", F.lit(".*"))
        .when(t.startswith("*"), F.lit("[^/]*?"))
        .otherwise(F.concat(F.lit(r"\Q"), F.replace(t, F.lit("\\"), F.lit(r"\E\\\Q")), F.lit(r"\E"))),
    )
    return F.concat(F.lit(r"\A"), F.array_join(body, ""), F.lit(r"\z"))


def locale_of_path(pattern, path) -> Column:
    """The locale a path names under a read pattern; null when the pattern does not read it."""
    pattern, path = _col(pattern), _col(path)
    regex = F.when(pattern.contains("%{locale}"), read_pattern_regex(pattern)).otherwise(
        F.concat(read_pattern_regex(pattern), F.lit("()"))
    )
    return F.nullif(regex_group(path, regex, 1), F.lit(""))


def file_pattern_regex(pattern, locale) -> Column:
    """The files a read pattern lists for one locale: ``**`` spans directories, ``*`` does not."""
    text = interpolate_locale(pattern, locale)
    tokens = F.regexp_extract_all(text, F.lit(r"(?s)(\*\*/|\*|[^*]+)"), F.lit(1))
    body = F.transform(
        tokens,
        lambda t: F.when(t == "**/", F.lit("(?:[^/]+/)*")).when(t == "*", F.lit("[^/]*")).otherwise(
            F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))
        ),
    )
    return F.concat(F.lit(r"\A"), F.array_join(body, ""), F.lit(r"\z"))


def enclosing_root(path) -> Column:
    """The first two components of a path (one when there are only two); null at top level."""
    path = _col(path)
    return (
        F.when(~path.contains("/"), F.lit(None).cast("string"))
        .when(F.size(F.split(path, "/")) == 2, F.substring_index(path, "/", 1))
        .otherwise(F.substring_index(path, "/", 2))
    )


def template_path(path, root) -> Column:
    """Segments of a path below a root; the file loses its extensions and one leading ``_``."""
    path, root = _col(path), _col(root)
    marker = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    pieces = F.split(F.call_function("substring_index", path, marker, F.lit(-1)), "/")
    name = F.regexp_replace(F.substring_index(F.element_at(pieces, -1), ".", 1), r"\A_", "")
    parts = F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.array(name))
    return F.when(F.contains(path, marker), parts).otherwise(F.array().cast("array<string>"))


def matching_root(path, roots: list[str]) -> Column:
    """The longest configured root a file lies under; null when there is none."""
    path = _col(path)
    hits = F.array(
        *[F.when(path.contains(r.rstrip("/") + "/"), F.struct(F.lit(len(r)).alias("n"), F.lit(r).alias("root"))) for r in roots]
    )
    return F.array_max(F.array_compact(hits))["root"] if roots else F.lit(None).cast("string")


def inside_root(path, root) -> Column:
    """Component-wise containment after dropping ``.`` and folding ``x/..``."""

    def normal(p: Column) -> Column:
        return F.aggregate(
            F.filter(F.split(p, "/"), lambda s: (s != "") & (s != ".")),
            F.array().cast("array<string>"),
            lambda acc, s: F.when(
                (s == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."),
                F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
            ).otherwise(F.concat(acc, F.array(s))),
        )

    p, r = normal(_col(path)), normal(_col(root))
    return F.slice(p, F.lit(1), F.greatest(F.size(r), F.lit(0))) == r


def layout_shape(under_dir) -> Column:
    """How a catalog file, named relative to the catalog directory, spells its locale."""
    p = _col(under_dir)
    file = F.substring_index(p, "/", -1)
    stem = F.when(file.contains("."), F.regexp_extract(file, r"(?s)\A(.*)\.", 1)).otherwise(file)
    namespaced = stem.contains(".") & looks_like_locale(F.substring_index(stem, ".", -1))
    depth = F.size(F.split(p, "/")) - 1
    return (
        F.when((depth == 0) & looks_like_locale(stem), "flat")
        .when((depth == 0) & namespaced, "namespaced")
        .when((depth == 1) & looks_like_locale(F.substring_index(p, "/", 1)), "locale_dir")
        .when((depth > 1) & looks_like_locale(F.substring_index(p, "/", 1)), "locale_dir_deep")
        .when((depth > 0) & looks_like_locale(stem), "subdir_flat")
        .when((depth > 0) & namespaced, "subdir_namespaced")
    )
