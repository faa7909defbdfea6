"""Column functions over dotted translation keys and locale names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The six plural categories, and the suffixes a plural node may hold.
PLURAL_CATEGORIES = ["zero", "one", "two", "few", "many", "other"]
PLURAL_SUFFIXES = PLURAL_CATEGORIES + ["0", "1"]

_CLOSED = r"\{[^}]*\}|\[[^\]]*\]|\([^)]*\)|<[^>]*>"
# Text up to the first bracket that never closes.
_BALANCED_HEAD = r"(?s)\A((?:" + _CLOSED + r"|[^{\[(<]+)*+)"
_BALANCED_TOKEN = r"(?s)(" + _CLOSED + r"|[^{\[(<]+)"
# Stands in for a dot that must not split; never part of a key.
_SHIELD = "\u0001"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def regex_group(text, regex, index: int) -> Column:
    """``regexp_extract`` with the regex in a column."""
    return F.call_function("regexp_extract", _col(text), _col(regex), F.lit(index))


def join_on_hash(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """``left.join(right, on, how)`` for joins of two large sides on texts that begin alike, such as dotted keys: a hash
    goes first, so a sort compares numbers and looks at the texts of equal ones only."""
    hashed = [df.withColumn("_hash", F.xxhash64(*on)) for df in (left, right)]
    return hashed[0].join(hashed[1], ["_hash", *on], how).drop("_hash")


def key_hash(project, key) -> Column:
    """What large joins on a key sort by."""
    return F.xxhash64(project, key)


def segments_of(key) -> Column:
    """Every dot splits: the plain view of a dotted key."""
    return F.split(_col(key), r"\.")


def split_key(key, limit: int | None = None) -> Column:
    """Split on dots outside ``{} [] () <>``; a bracket left open splits after all.

    A trailing dot adds no part. With ``limit`` the last part keeps the unsplit rest.
    """
    key = _col(key)
    head = F.regexp_extract(key, _BALANCED_HEAD, 1)
    tail = F.substring(key, F.length(head) + 1, F.length(key))
    shielded = F.array_join(
        F.transform(
            F.regexp_extract_all(head, F.lit(_BALANCED_TOKEN), F.lit(1)),
            lambda t: F.when(t.rlike(r"\A[{\[(<]"), F.replace(t, F.lit("."), F.lit(_SHIELD))).otherwise(t),
        ),
        "",
    )

    def unshield(c: Column) -> Column:
        return F.replace(c, F.lit(_SHIELD), F.lit("."))

    pieces = F.split(F.concat(shielded, tail), r"\.")
    parts = F.transform(
        F.when((tail == "") & (F.element_at(pieces, -1) == ""), F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces),
        unshield,
    )
    if limit is None:
        return parts
    if limit == 1:
        return F.array(key)
    rest = unshield(F.array_join(F.slice(pieces, limit, F.greatest(F.size(pieces), F.lit(limit))), "."))
    limited = F.concat(
        F.slice(parts, 1, limit - 1),
        F.when(rest != "", F.array(rest)).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.size(F.split(shielded, r"\.")) >= limit, limited).otherwise(parts)


def last_key_part(key) -> Column:
    return F.coalesce(F.try_element_at(split_key(key), F.lit(-1)), F.lit(""))


def parent_key(key) -> Column:
    """Text before the last dot; null at the root."""
    key = _col(key)
    return F.when(key.contains("."), F.left(key, F.length(key) - F.length(F.substring_index(key, ".", -1)) - 1))


def last_segment(key) -> Column:
    """Text after the last dot."""
    return F.substring_index(_col(key), ".", -1)


def _n_segments(key: Column) -> Column:
    return F.length(key) - F.length(F.replace(key, F.lit("."), F.lit(""))) + 1


def _prefix(key: Column, n: Column) -> Column:
    return F.call_function("substring_index", key, F.lit("."), n)


def ancestors(key) -> Column:
    """The key and each of its dotted prefixes, shortest first."""
    key = _col(key)
    return F.transform(F.sequence(F.lit(1), _n_segments(key)), lambda n: _prefix(key, n))


def proper_ancestors(key) -> Column:
    """The dotted prefixes without the key itself."""
    chain = ancestors(key)
    return F.slice(chain, F.lit(1), F.size(chain) - 1)


def is_plural_category(key) -> Column:
    """The last part names one of the six categories (``0`` and ``1`` do not count here).

    The cheap test on the last segment rules nearly every key out before brackets matter, and
    without an opening bracket the last segment is the last part.
    """
    bracketed = _col(key).rlike(r"[{\[(<]")
    return last_segment(key).isin(PLURAL_CATEGORIES) & (~bracketed | last_key_part(key).isin(PLURAL_CATEGORIES))


def underscore(word) -> Column:
    """CamelCase constant path to snake path, with no acronyms registered."""
    word = _col(word)
    snake = F.regexp_replace(F.replace(word, F.lit("::"), F.lit("/")), r"([A-Z0-9]+)([A-Z][a-z])", "$1_$2")
    snake = F.regexp_replace(snake, r"([a-z0-9])([A-Z])", "$1_$2")
    return F.when(word.rlike("[A-Z-]|::"), F.lower(F.replace(snake, F.lit("-"), F.lit("_")))).otherwise(word)


def join_key(parts) -> Column:
    """Join the non-empty parts with dots, folding ``..`` once."""
    joined = F.array_join(F.filter(_col(parts), lambda p: p != ""), ".")
    return F.replace(joined, F.lit(".."), F.lit("."))


def alternate_locale(locale) -> Column:
    """``pt-br`` -> ``pt-BR``; empty when there is no region."""
    locale = _col(locale)
    region = F.regexp_extract(locale, r"(?s)\A[^-]*-(.*)\z", 1)
    return F.when(locale.contains("-"), F.concat(F.substring_index(locale, "-", 1), F.lit("-"), F.upper(region))).otherwise("")


def valid_locale(locale) -> Column:
    return _col(locale).rlike(r"\A\w[\w\-.]*\z")


def looks_like_locale(text) -> Column:
    """Narrow test used on file names: ``en``, ``pt-BR``, ``zh_Hans_CN``."""
    return _col(text).rlike(r"\A[a-z]{2,3}(?:[-_][A-Za-z0-9]{2,8})*\z")
