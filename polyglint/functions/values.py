"""Column functions over catalog values: placeholders, scalar typing, canonical text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from polyglint.functions.keys import _col

# Option names a placeholder must not take.
RESERVED_NAMES = [
    "cascade",
    "deep_interpolation",
    "skip_interpolation",
    "default",
    "exception_handler",
    "fallback",
    "fallback_in_progress",
    "fallback_original_locale",
    "format",
    "object",
    "raise",
    "resolve",
    "scope",
    "separator",
    "throw",
]


# --- placeholders --------------------------------------------------------------------


def placeholders(value) -> Column:
    """Every ``%{name}`` that no ``%`` precedes, in order, repeats kept."""
    return F.regexp_extract_all(_col(value), F.lit(r"((?<!%)%\{[^}]+\})"), F.lit(1))


def placeholder_name(match) -> Column:
    return F.regexp_replace(_col(match), r"\A%+\{*|\}+\z", "")


def placeholder_set(value) -> Column:
    return F.array_sort(F.array_distinct(placeholders(value)))


def is_reserved(name) -> Column:
    return _col(name).isin(RESERVED_NAMES)


def reserved_names(value) -> Column:
    """Reserved placeholder names of a value, in order, repeats kept."""
    names = F.transform(placeholders(value), placeholder_name)
    return F.filter(names, lambda n: F.array_contains(F.lit(RESERVED_NAMES), n))


# --- scalar typing -------------------------------------------------------------------

# Every form is tested on whole text in one expression: the catalog has a value per row.
_NUMBER = (
    r"[-+]?(?:\.(?i:inf|nan)"
    r"|(?=[^,]*,)(?:0b[01_,]+|0[0-7_,]+|[1-9](?:[0-9]|,[0-9]|_[0-9])*|0x[0-9a-fA-F_,]+|(?:[0-9][0-9_,]*)?\.[0-9]*(?:[eE][-+][0-9]+)?)"
    r"|0[xX]_*[0-9a-fA-F][0-9a-fA-F_]*|0[bB]_*[01][01_]*|0[oO]_*[0-7][0-7_]*"
    r"|_*[0-9.][0-9._]*(?::_*[0-9.][0-9._]*)+"
    r"|_*[-+]?_*(?:[0-9][0-9_]*(?:\.[0-9_]*)?|\._*[0-9][0-9_]*)(?:[eE]_*[-+]?_*[0-9][0-9_]*)?)"
)
_NULL = r"(?:~?|(?i:null))"
_BOOL = r"(?i:true|yes|on|false|no|off)"
_TIMESTAMP = r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9])"


def typed_scalar(text) -> Column:
    """What unquoted text is read as: ``null``, ``bool``, ``number``, ``timestamp`` or ``str``."""
    text = _col(text)
    return (
        F.when(text.rlike(rf"\A{_NULL}\z"), "null")
        .when(text.rlike(rf"\A{_BOOL}\z"), "bool")
        .when(text.rlike(rf"\A{_NUMBER}\z"), "number")
        .when(text.rlike(rf"\A{_TIMESTAMP}"), "timestamp")
        .otherwise("str")
    )


def bool_value(text) -> Column:
    return _col(text).rlike(r"\A(?i:true|yes|on)\z")


_NUM_SEXAGESIMAL = r"\A[-+]?[0-9][0-9_]*(?::[0-5]?[0-9]){1,2}(?:\.[0-9_]*)?\z"
_NUM_FLOAT = r"\A[-+]?(?:[0-9][0-9_,]*)?\.[0-9]*(?:[eE][-+][0-9]+)?\z"
_NUM_INTEGER = (
    r"\A[-+]?(?:0b[_,]*[01][01_,]*|0[_,]*[0-7][0-7_,]*|(?:0|[1-9](?:[0-9]|,[0-9]|_[0-9])*)"
    r"|0x[_,]*[0-9a-fA-F][0-9a-fA-F_,]*)\z"
)
_HEX = "0123456789abcdef"


def _float_text(number: Column) -> Column:
    """Shortest decimal text of a double; plain notation up to 1e16."""
    plain = F.regexp_replace(number.try_cast("decimal(38,20)").cast("string"), r"(\.[0-9]+?)0+\z", "$1")
    size = F.abs(number)
    return F.when((size == 0) | ((size >= 1e-5) & (size < 1e16)), plain).otherwise(
        F.lower(F.regexp_replace(number.cast("string"), r"\.0E", "E"))
    )


def number_value(text) -> Column:
    """JSON text of the number unquoted text holds; null when it holds none.

    Integers are exact within 64 bits (signed or unsigned) and floats beyond.
    """
    text = _col(text)
    parts = F.split(F.replace(text, F.lit("_"), F.lit("")), ":")
    # Three places from the left, whatever the number of parts.
    total = sum(
        F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("0")).try_cast("double") * F.lit(float(60 ** (3 - i)))
        for i in (1, 2, 3)
    )
    sexagesimal = F.when(text.contains("."), _float_text(total)).otherwise(total.try_cast("bigint").cast("string"))

    digits = F.translate(text, ",_", "")
    float_body = F.regexp_replace(F.regexp_replace(digits, r"\.([eE])", "$1"), r"\.\z", "")
    float_json = F.when(~text.rlike(r"\A[-+]?\.\z") & float_body.rlike("[0-9]") & float_body.rlike(r"\A[-+]?[0-9.]"), _float_text(float_body.try_cast("double")))

    negative = digits.startswith("-")
    magnitude = F.regexp_replace(digits, r"\A[-+]", "")
    radix = (
        F.when(magnitude.startswith("0x"), 16)
        .when(magnitude.startswith("0b"), 2)
        .when((F.length(magnitude) > 1) & magnitude.startswith("0"), 8)
        .otherwise(10)
    )
    body = F.lower(F.regexp_replace(magnitude, r"\A0[xb]|\A0(?=[0-9])", ""))
    digit_values = F.transform(F.split(body, "(?<=.)(?=.)"), lambda c: F.instr(F.lit(_HEX), c).cast("decimal(38,0)") - 1)
    in_radix = F.aggregate(
        digit_values,
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, d: (acc * radix + d).try_cast("decimal(38,0)"),
    )
    # In doubles beside it: numbers of any length, and the exact sum is made only where it cannot overflow.
    rounded = F.aggregate(digit_values, F.lit(0.0), lambda acc, d: acc * radix + d.cast("double"))
    exact = F.when(radix == 10, body.try_cast("decimal(38,0)")).when(rounded < 1e30, in_radix)
    signed = F.when(negative, -exact).otherwise(exact)
    fits = (signed >= F.lit("-9223372036854775808").cast("decimal(38,0)")) & (
        signed <= F.lit("18446744073709551615").cast("decimal(38,0)")
    )
    as_float = F.when(radix == 10, body.try_cast("double")).otherwise(rounded)
    integer_json = F.when(F.coalesce(fits, F.lit(False)), signed.cast("string")).otherwise(
        _float_text(F.when(negative, -as_float).otherwise(as_float))
    )
    return (
        F.when(text.rlike(_NUM_SEXAGESIMAL), sexagesimal)
        .when(text.rlike(_NUM_FLOAT), float_json)
        .when(text.rlike(_NUM_INTEGER), integer_json)
    )


def is_symbol_reference(text) -> Column:
    return _col(text).rlike(r"(?U)\A:[\p{IsAlphabetic}\p{N}_.]+\z")


# --- canonical text ------------------------------------------------------------------


def _double_quoted(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for raw, escaped in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    spelled = F.array_join(
        F.transform(
            F.split(out, "(?s)(?<=.)(?=.)"),
            lambda c: F.when(c.rlike(r"\p{Cc}"), F.concat(F.lit("\\x"), F.lpad(F.lower(F.hex(F.ascii(c))), 2, "0"))).otherwise(c),
        ),
        "",
    )
    return F.concat(F.lit('"'), F.when(out.rlike(r"\p{Cc}"), spelled).otherwise(out), F.lit('"'))


def _single_quoted(text: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


# Quotes are needed when plain text would read back as something else: empty, opened by an
# indicator, closed by a blank or colon, a mapping or comment inside, or typed as no string.
_NEEDS_QUOTES = (
    r"""(?s)\A(?:\z|[ \-?:,\[\]{}#&*!|>'"%@`]|.* \z|.*:(?: |\z)|.* #|(?:[yYnN]|<<|=)\z"""
    + rf"|(?:{_NULL}|{_BOOL}|{_NUMBER})\z|{_TIMESTAMP})"
)
_NON_WORD_START = r'(?s)\A[^\p{IsAlphabetic}\p{N}_"][^"]*\z'


def quote_scalar(text) -> Column:
    """One-line scalar: plain when nothing would be misread, else single or double quotes."""
    text = _col(text)
    return (
        F.when(text.rlike(r"\p{Cc}") | text.rlike(_NON_WORD_START), _double_quoted(text))
        .when(text.rlike(_NEEDS_QUOTES), _single_quoted(text))
        .otherwise(text)
    )


def _indent(depth: Column, text: Column) -> Column:
    return F.regexp_replace(text, F.lit(r"(?m)^(?=.)"), F.repeat(F.lit("  "), depth))


def is_block_safe(text) -> Column:
    """Multi-line text that a literal block holds unchanged."""
    text = _col(text)
    return (
        text.contains("\n")
        & text.rlike(r"\A[^ \n]")
        & ~text.rlike(r" (?:\n|\z)")
        & ~text.rlike(r"[\p{Cc}&&[^\n]]")
    )


def block_scalar(text, depth) -> Column:
    """Multi-line text under a key at ``depth`` levels of indent."""
    text = _col(text)
    header = F.when(~text.rlike(r"\n\z"), "|-").when(text.rlike(r"\n\n\z"), "|+").otherwise("|")
    body = F.regexp_replace(text, r"\n\z", "")
    return F.concat(header, F.lit("\n"), _indent(_col(depth) + 1, body))


def scalar_text(value_type, value, depth) -> Column:
    """Canonical text of a scalar leaf."""
    value_type, value = _col(value_type), _col(value)
    return (
        F.when(value_type == "nil", "")
        .when(value_type != "str", value)
        .when(is_block_safe(value), block_scalar(value, depth))
        .otherwise(quote_scalar(value))
    )


# --- values as shown and as JSON -----------------------------------------------------

_JSON_TOKEN = r'("(?:[^"\\]|\\.)*+"|[,:]|null|[^",:n]+|n)'


def inspect_json(json_text) -> Column:
    """A JSON sequence or mapping in inspect form: ``["a", 1, nil, {"k" => "v"}]``."""
    tokens = F.regexp_extract_all(_col(json_text), F.lit(_JSON_TOKEN), F.lit(1))
    return F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(t == ",", ", ").when(t == ":", " => ").when(t == "null", "nil").otherwise(t),
        ),
        "",
    )


def display_value(value_type, value) -> Column:
    """The text of a value that reports show and statistics count."""
    value_type, value = _col(value_type), _col(value)
    return (
        F.when(value_type == "nil", "").when(value_type.isin("seq", "map"), inspect_json(value)).otherwise(value)
    )


def json_string(text) -> Column:
    wrapped = F.to_json(F.struct(_col(text).alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def json_value(value_type, value) -> Column:
    """A value as JSON text: numbers as numbers, symbols as names, dates as text."""
    value_type, value = _col(value_type), _col(value)
    return (
        F.when(value_type == "nil", "null")
        .when(value_type.isin("bool", "seq", "map"), value)
        .when((value_type == "plain") & value.startswith(":"), json_string(F.substring(value, F.lit(2), F.length(value))))
        .when(value_type == "plain", F.coalesce(number_value(value), json_string(value)))
        .otherwise(json_string(value))
    )


def variable_list(names) -> Column:
    names = _col(names)
    return F.when(F.size(names) == 0, "no variables").otherwise(F.array_join(names, ", "))


def reason_text(base_locale) -> Column:
    """The prose of a finding, from its reason columns (lists held as ``, `` joined text)."""

    def listed(name: str) -> Column:
        return F.when(F.col(name) == "", "no variables").otherwise(F.col(name))

    return (
        F.when(F.col("reason_type") == "used", F.concat(F.lit("used: "), F.col("path"), F.lit(":"), F.col("line").cast("string")))
        .when(F.col("reason_type") == "diff", F.concat(F.lit("diff: present in "), F.col("present_in")))
        .when(F.col("reason_type") == "plural", F.concat(F.lit("plural: missing "), F.col("categories")))
        .when(
            F.col("reason_type") == "interpolations",
            F.concat(F.col("locale"), F.lit(" has "), listed("variables"), F.lit(", "), _col(base_locale), F.lit(" has "), listed("base_variables")),
        )
        .when(F.col("reason_type") == "reserved", F.col("names"))
        .otherwise("")
    )
