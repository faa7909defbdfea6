"""Translation calls in source text, as occurrence rows.

Everything down to the classified call is a narrow chain of built-in expressions over whole
file texts, so it runs on batch and streaming input alike; only Ruby lexical context and
comment coverage join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.functions import keys as K
from polyglint.functions import paths as P

# Fixed value: a comment naming keys carries this word.
MARKER = "i18n-tasks-use"
# A file with none of these, and without the marker, cannot hold a call.
NEEDLES = ["t(", "t ", "t!", "translate", "I18n."]

_STRING = r'''"[^"\\\n]*+(?:\\[\s\S][^"\\\n]*+)*+"|'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+\''''


def _ruby_string(depth: int) -> str:
    """A Ruby string; up to ``depth`` strings deep, an interpolation may hold strings of the same quotes."""
    single = r"'[^'\\\n]*+(?:\\[\s\S][^'\\\n]*+)*+'"
    body = rf"#\{{(?:[^{{}}\"']|{_ruby_string(depth - 1)}|\{{[^{{}}\"']*+\}})*+\}}|" if depth else ""
    return rf'"[^"\\\n#]*+(?:(?:\\[\s\S]|{body}#)[^"\\\n#]*+)*+"|{single}'


#: Strings that stand in the interpolations of others are read as one up to this depth.
_R_STRING = _ruby_string(3)
_SCOPE_WORD = r"\s*,\s*(?::scope\s*=>\s*|scope:\s*)"
_OPEN = r"(?:\x20\s*|\s*\(\s*(?:\\\s*)?)"
_PERCENT = r"%[iIwW](?:\[[^\n\]]*\]|\([^\n)]*\)|\{[^\n}]*\})"

_T_ARG = rf":?(?:{_STRING})|:\w+|[\w@.&|\s?!]+"
_T_SCOPE = rf"{_PERCENT}|\[[^\n)%#]*\]|[^\n)%#,]*"
_T_NAME = r"t(?:!|ranslate!?)?"
_T_CALL = rf"(?U)(?:I18n\.t|t(?<![\p{{IsAlphabetic}}_.'-]t)){_T_NAME[1:]}{_OPEN}(?:{_T_ARG})(?:{_SCOPE_WORD}(?:{_T_SCOPE}))?"
_T_PARTS = rf"(?U)\A(?:I18n\.)?{_T_NAME}{_OPEN}({_T_ARG})(?:({_SCOPE_WORD})({_T_SCOPE}))?"

# Ruby: adjacent literals join, expressions are opaque, `def t` is no call.
_R_LITERAL = rf":?(?:{_R_STRING})(?:\s*(?:\\\s*)?(?:{_R_STRING}))*+"
_R_EXPR = r"(?!(?:if|unless|do|and|or|while|until|then|end|rescue|in|not)\b)[\w@$:][\w@$:.?!&]*"
_R_ARG = rf"{_R_LITERAL}|:\w+[?!]?|{_R_EXPR}"
# What follows the argument: the rest of the statement, over line breaks that cannot end it.
_R_REST = r"\s*(?=,)(?:[,(\[{][ \t]*(?:#(?!\{)[^\n]*)?\n|\n(?=\s*[)\]},])|[^\n,(\[{]++|[,(\[{])*+"
# Most characters begin no call: that is asked first.
_R_NAME = rf"(?U)(?=[It])(?:(?<!\w::)I18n\.|(?<![\w.'-])(?<!def )(?<!def self\.)(?<![@$:]))(?:t|translate)!?{_OPEN}"
_R_OPTIONS = rf"(?U)({_R_NAME})({_R_ARG})(?=({_R_REST})|)"
# A call inside the argument of another: only its name is taken, so that the search goes on in its own argument.
_R_INNER = rf"{_R_NAME}(?=({_R_ARG})({_R_REST}|))"
_R_COMMENT_BLOCK = r"(?ms)^=begin\b.*?(?:^=end\b[^\n]*|\z)"
_R_SCOPE_WORD = r"(?<![\w:]):scope\s*=>\s*|(?<![\w:])scope:(?!:)\s*"
# Strings, comments, brackets and commas part a list of Ruby arguments; a comment goes up to the end of its line.
_R_COMMENT = r"#(?!\{)[^\n]*"
_R_TOKEN = rf"{_R_STRING}|{_R_COMMENT}|{_R_SCOPE_WORD}|[()\[\]{{}},]|(?:(?!:scope|scope:)[^\"'()\[\]{{}},#])++|[\s\S]"
_R_ITEM_TOKEN = rf"{_R_STRING}|{_R_COMMENT}|[()\[\]{{}},]|[^\"'()\[\]{{}},#]++|[\s\S]"


# --- files ---------------------------------------------------------------------------


def has_needle(content) -> Column:
    c = F.col(content)
    hit = c.contains(MARKER)
    for n in NEEDLES:
        hit = hit | c.contains(n)
    return hit


def needle_prefilter(files: DataFrame) -> DataFrame:
    """Add ``verdict``: ``scanned``, ``prefiltered``, or null when the content could not be read."""
    return files.withColumn("verdict", F.when(F.col("content").isNotNull(), F.when(has_needle("content"), "scanned").otherwise("prefiltered")))


def scanner_kind(path) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.when(_named(path, ".rb"), "ruby").when(_named(path, ".erb"), "erb").otherwise("template")


def _named(path: Column, end: str) -> Column:
    """Whether a path ends so behind a character that is no slash."""
    return path.endswith(end) & ~path.endswith("/" + end) & (path != end)


def extension(path) -> Column:
    path = F.col(path)
    name = F.substring_index(path, "/", -1)
    last = F.substring_index(name, ".", -1)
    return F.when(path.isNotNull(), F.when(F.length(name) - F.length(last) > 1, last).otherwise(""))


# --- template tags -------------------------------------------------------------------

_TAG = r"(?s)<%(?:={1,2}|-|#-?|%)?.*?[-=]?%>"
_TAG_PARTS = r"(?s)\A<%(={1,2}|-|#-?|%)?(.*?)([-=])?%>\z"
_MARKED_LINE = rf"\A[ \t#]*{MARKER}[ \t]"


def _blank(text: Column) -> Column:
    """Spaces for every character but newlines, as many as it has bytes; one pass where that is one each."""
    plain, given = F.regexp_replace(text, r"[^\n ]", " "), text
    for chars, n in ((r"[\x{10000}-\x{10FFFF}]", 4), (r"[\x{800}-\x{FFFF}]", 3), (r"[\x{80}-\x{7FF}]", 2), (r"[^\n ]", 1)):
        text = F.regexp_replace(text, chars, " " * n)
    return F.when(F.octet_length(given) == F.length(given), plain).otherwise(text)


def _tag_code(tag: Column, indicator: Column, code: Column) -> Column:
    """One tag with everything blanked but its code, or but the marked lines of a comment."""
    front = F.lit(2) + F.length(indicator)
    lead = _blank(F.substring(tag, F.lit(1), front))
    trail = _blank(F.substring(tag, front + F.length(code) + 1, F.length(tag)))
    marked = F.array_join(
        F.transform(F.split(code, "\n"), lambda line: F.when(line.rlike(_MARKED_LINE), line).otherwise(_blank(line))), "\n"
    )
    return (
        F.when(indicator.isin("", "=", "==", "-"), F.concat(lead, code, trail))
        .when(indicator.startswith("#"), F.concat(lead, marked, trail))
        .otherwise(_blank(tag))
    )


def template_code(content) -> Column:
    """The text of a tagged template with everything outside code tags blanked; offsets, lines
    and columns stay those of the file."""
    content = F.col(content) if isinstance(content, str) else content
    parted = F.transform(
        F.regexp_extract_all(content, F.lit(_TAG), F.lit(0)),
        lambda tag: F.struct(tag.alias("tag"), F.regexp_extract(tag, _TAG_PARTS, 1).alias("indicator"), F.regexp_extract(tag, _TAG_PARTS, 2).alias("code")),
    )
    tags = F.transform(parted, lambda t: _tag_code(t["tag"], t["indicator"], t["code"]))
    between = F.split(content, _TAG, -1)
    woven = F.zip_with(
        between, tags, lambda text, tag: F.concat(_blank(text), F.coalesce(tag, F.lit("")))
    )
    return F.array_join(woven, "")


def extract_template_tags(files: DataFrame) -> DataFrame:
    return files.where(scanner_kind("path") == "erb").withColumn("content", template_code("content"))


# --- calls and their places ----------------------------------------------------------


def _newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _located(pieces: Column, calls: Column) -> Column:
    """Calls with place: array of (pos, line_num, line_pos, line_head, call).

    ``pieces`` are the texts between calls. Offsets and columns count bytes, as files do;
    ``line_head`` is what stands before the call on its line.
    """
    measured = F.zip_with(
        F.slice(pieces, F.lit(1), F.size(calls)),
        calls,
        lambda p, c: F.struct(
            F.octet_length(p).alias("p_len"), _newlines(p).alias("p_nl"), F.substring_index(p, "\n", -1).alias("p_tail"),
            F.octet_length(c).alias("c_len"), _newlines(c).alias("c_nl"), F.substring_index(c, "\n", -1).alias("c_tail"), c.alias("call"),
        ),
    )
    place = "array<struct<pos:int,line_num:int,line_head:string,call:string>>"
    start = F.struct(F.lit(0).alias("pos"), F.lit(1).alias("line"), F.lit("").alias("head"), F.array().cast(place).alias("out"))

    def step(s: Column, m: Column) -> Column:
        head = F.when(m["p_nl"] > 0, m["p_tail"]).otherwise(F.concat(s["head"], m["p_tail"]))
        here = F.struct((s["pos"] + m["p_len"]).alias("pos"), (s["line"] + m["p_nl"]).alias("line_num"), head.alias("line_head"), m["call"].alias("call"))
        return F.struct(
            (s["pos"] + m["p_len"] + m["c_len"]).alias("pos"),
            (s["line"] + m["p_nl"] + m["c_nl"]).alias("line"),
            F.when(m["c_nl"] > 0, m["c_tail"]).otherwise(F.concat(head, m["c_tail"])).alias("head"),
            F.concat(s["out"], F.array(here)).alias("out"),
        )

    return F.aggregate(measured, start, step, lambda s: s["out"])


def _without_comment_blocks(content: Column) -> Column:
    """Ruby text with its ``=begin`` blocks blanked."""
    blocks = F.regexp_extract_all(content, F.lit(_R_COMMENT_BLOCK), F.lit(0))
    woven = F.zip_with(F.split(content, _R_COMMENT_BLOCK, -1), blocks, lambda text, block: F.concat(text, F.coalesce(_blank(block), F.lit(""))))
    return F.when(content.contains("=begin"), F.array_join(woven, "")).otherwise(content)


def option_scope(options: Column) -> Column:
    """The value of ``scope:`` (or ``:scope =>``) among the options of a call, wherever it stands; null without one.

    Brackets are counted, to any depth: options end at a bracket that they did not open, and a value ends at a comma
    outside brackets. An option of the same name inside another value or a comment does not count.
    """
    state = "struct<depth:int,mode:int,value:string>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("mode"), F.lit(None).cast("string").alias("value")).cast(state)

    def step(s: Column, token: Column) -> Column:
        opens, closes = token.isin("(", "[", "{"), token.isin(")", "]", "}")
        top = s["depth"] == 0
        over = (s["mode"] == 2) | (top & closes) | ((s["mode"] == 1) & top & (token == ","))
        begins = (s["mode"] == 0) & top & token.rlike(rf"\A(?:{_R_SCOPE_WORD})\z")
        return F.struct(
            (s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).cast("int").alias("depth"),
            F.when(over, 2).when(begins, 1).otherwise(s["mode"]).cast("int").alias("mode"),
            F.when(~over & begins, "").when(~over & (s["mode"] == 1) & ~token.startswith("#"), F.concat(s["value"], token)).otherwise(s["value"]).alias("value"),
        )

    tokens = F.regexp_extract_all(options, F.lit(_R_TOKEN), F.lit(0))
    value = F.aggregate(tokens, start, step, lambda s: s["value"])
    return F.when(options.contains("scope"), F.trim(F.regexp_replace(value, r"\s+(?:do|if|unless|and|or)\b[\s\S]*\z", "")))


def interpolated_code(text: Column) -> Column:
    """``text`` with everything blanked but what stands in ``#{...}``, braces counted to any depth; as many bytes."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, token: Column) -> Column:
        inside = (s["depth"] > 0) & ~((s["depth"] == 1) & (token == "}"))
        depth = s["depth"] + F.when((token == "#{") | ((token == "{") & (s["depth"] > 0)), 1).when((token == "}") & (s["depth"] > 0), -1).otherwise(0)
        return F.struct(depth.cast("int").alias("depth"), F.concat(s["out"], F.when(inside, token).otherwise(_blank(token))).alias("out"))

    tokens = F.regexp_extract_all(text, F.lit(r"#\{|[{}]|[^#{}]++|#"), F.lit(0))
    return F.aggregate(tokens, start, step, lambda s: s["out"])


_CALLS = "array<struct<pos:int,line_num:int,line_head:string,name:string,arg:string,options:string>>"


def _inner_calls(call: Column) -> Column:
    """The calls in the interpolations of a call's argument, at any depth, with places that count from the call."""
    code = interpolated_code(call)
    names, args, rests = (F.regexp_extract_all(code, F.lit(_R_INNER), F.lit(i)) for i in (0, 1, 2))
    at = _located(F.split(code, _R_INNER, -1), names)
    found = F.transform(
        F.arrays_zip(at.alias("at"), args.alias("arg"), rests.alias("rest")),
        lambda c: F.struct(c["at"]["pos"].alias("pos"), c["at"]["line_num"].alias("line_num"), c["at"]["line_head"].alias("line_head"), c["at"]["call"].alias("name"), c["arg"].alias("arg"), c["rest"].alias("options")),
    )
    return F.when(call.contains("#{") & code.rlike(_R_INNER), found.cast(_CALLS)).otherwise(F.array().cast(_CALLS))


def _with_inner(call: Column) -> Column:
    """A Ruby call and those in its interpolations: a key inside another's key is used as well."""
    inner = F.transform(
        _inner_calls(F.concat(call["name"], call["arg"])),
        lambda c: F.struct(
            (call["pos"] + c["pos"]).alias("pos"), (call["line_num"] + c["line_num"] - 1).alias("line_num"),
            F.when(c["line_num"] == 1, F.concat(call["line_head"], c["line_head"])).otherwise(c["line_head"]).alias("line_head"), c["name"].alias("name"), c["arg"].alias("arg"), c["options"].alias("options"),
        ).cast(_CALLS[6:-1]),
    )
    return F.concat(F.array(call), inner)


#: Stand around calls, before their argument and before what follows them, while a text is cut up; a text that has them
#: gets blanks in their place.
_MARKS = "\u0001\u0002\u0003"


def extract_calls(files: DataFrame, *carried: str) -> DataFrame:
    """One row per translation call of any file: project, path, scanner, pos, line_num, line_pos,
    line_head, receiver, arg, scope (null when the call has none), and the ``carried`` columns of its file.

    A bare ``t`` must not follow a letter, ``_``, ``'``, ``-`` or ``.``; the guard is inside the
    expression, so the search goes on one character after a rejected start. In Ruby, calls in the interpolations of a
    call's argument are calls of their own. A file whose content is null gives none.
    """
    file = ["project", "path", "scanner", *carried]
    kind, content = F.col("scanner"), F.col("content")
    template = kind == "template"
    text = F.when(kind == "erb", template_code("content")).when(kind == "ruby", _without_comment_blocks(content)).otherwise(content)
    coded = files.withColumn("scanner", scanner_kind("path")).select(*file, text.alias("content"))
    # one pass finds the calls, their arguments and what follows each, and puts marks between; the text is cut at them
    around, before, behind = _MARKS
    odd = content.contains(around) | content.contains(before) | content.contains(behind)
    coded = coded.withColumn("content", F.when(odd, F.translate(content, _MARKS, "   ")).otherwise(content))
    marked = F.when(template, F.regexp_replace("content", _T_CALL, f"{around}$0{before}{behind}{around}")).otherwise(
        F.regexp_replace("content", _R_OPTIONS, f"{around}$1{before}$2{behind}$3{around}")
    )
    coded = coded.select(*file, F.split(marked, around, -1).alias("parts"))
    hits = F.transform(
        F.filter("parts", lambda x, i: i % 2 == 1),
        lambda h: F.struct(
            F.substring_index(h, before, 1).alias("name"), F.substring_index(F.substring_index(h, behind, 1), before, -1).alias("arg"), F.substring_index(h, behind, -1).alias("options")
        ),
    )
    coded = coded.select(*file, F.filter("parts", lambda x, i: i % 2 == 0).alias("pieces"), hits.alias("hits"))
    at = _located(F.col("pieces"), F.transform("hits", lambda h: F.concat(h["name"], h["arg"])))
    found = F.zip_with(
        at, F.col("hits"),
        lambda a, h: F.struct(a["pos"].alias("pos"), a["line_num"].alias("line_num"), a["line_head"].alias("line_head"), h["name"].alias("name"), h["arg"].alias("arg"), h["options"].alias("options")),
    ).cast(_CALLS)
    # few files hold a call inside another's argument, where its name shows as a "t"
    nested = ~template & F.exists("found", lambda c: c["arg"].contains("#{") & c["arg"].contains("t"))
    every = F.when(nested, F.flatten(F.transform("found", _with_inner))).otherwise(F.col("found"))
    rows = coded.select(*file, found.alias("found")).select(*file, F.explode(every).alias("c")).select(*file, "c.*")
    part = lambda i: F.regexp_extract("name", _T_PARTS, i)
    receiver = F.col("name").startswith("I18n.")
    skip = F.when(receiver, 5).otherwise(0)
    return rows.select(
        *file, (F.col("pos") + skip).alias("pos"), "line_num", (F.octet_length("line_head") + skip).alias("line_pos"), "line_head", receiver.alias("receiver"),
        F.when(template, part(1)).otherwise(F.col("arg")).alias("arg"),
        F.when(template, F.when(part(2) != "", part(3))).otherwise(option_scope(F.col("options"))).alias("scope"),
    )


# Comment openers per extension of files read by the plain scanner.
COMMENT_OPENERS = {"coffee": "#", "opal": "#", "es6": "//", "js": "//", "haml": r"-\s*#", "slim": "-#|/"}


def line_kind(ext: Column, scanner: Column, head: Column) -> Column:
    """``code``, ``comment`` or ``magic`` (a comment with the marker) for the line a call is on."""
    kind = F.lit("code")
    for e, opener in COMMENT_OPENERS.items():
        opened = (scanner == "template") & (ext == e) & head.rlike(rf"(?U)\A\s*(?:{opener})")
        kind = F.when(opened, F.when(head.rlike(rf"(?U)\A\s*(?:{opener})\s{MARKER}"), "magic").otherwise("comment")).otherwise(kind)
    ruby = scanner != "template"
    outside_strings = F.regexp_replace(head, r'''"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+\'''', "")
    # cheap tests first: few lines hold a comment, and optimized plans may evaluate this twice
    kind = F.when(~ruby & head.rlike(r"(?U)\A\s*[-#/]"), kind).otherwise("code")
    return (
        F.when(ruby & head.contains(MARKER) & head.rlike(rf"\A[\s#]*{MARKER}[ \t]"), "magic")
        .when(ruby & head.contains("#") & outside_strings.rlike(r"#(?!\{)"), F.when(head.rlike(rf"#[ \t]*{MARKER}[ \t]"), "magic").otherwise("comment"))
        .otherwise(kind)
    )


# --- keys ----------------------------------------------------------------------------


def strip_literal(arg: Column) -> Column:
    """Quotes and the symbol colon removed; an expression becomes ``#{expr}``."""
    bare = F.regexp_replace(arg, r"\A:", "")
    quoted = bare.rlike(r'''(?s)\A(?:".*"|'.*')\z''') & (F.length(bare) >= 2)
    return F.when(arg.rlike(r"\A[A-Za-z0-9_@]"), F.concat(F.lit("#{"), arg, F.lit("}"))).otherwise(
        F.when(quoted, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare)
    )


def interpolation_to_pattern(key: Column, *, bare_braces: bool = False) -> Column:
    """``#{...}`` -> ``*:``, braces counted to any depth. A brace outside of that hides what it holds, unless
    ``bare_braces`` keeps such braces as text."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, token: Column) -> Column:
        top = s["depth"] == 0
        opens = (token == "#{") | ((token == "{") & (~top if bare_braces else F.lit(True)))
        closes = (token == "}") & ~top
        shown = F.when(top & (token == "#{"), "*:").when(top & (F.lit(bare_braces) | ~token.isin("{", "}")), token).otherwise("")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(depth.cast("int").alias("depth"), F.concat(s["out"], shown).alias("out"))

    tokens = F.regexp_extract_all(key, F.lit(r"#\{|[{}]|[^#{}]++|#"), F.lit(0))
    return F.when(key.rlike("[{}]"), F.aggregate(tokens, start, step, lambda s: s["out"])).otherwise(key)


def valid_key(key: Column) -> Column:
    """Key characters only; blanks only between letters or digits."""
    word = r"\p{IsAlphabetic}\p{N}"
    plain = key.rlike(r"\A[A-Za-z0-9_.?!:;\\/#{}@\[\]-]++\z")
    return plain | key.rlike(rf"(?U)\A(?:[{word}_.?!:;\\/#{{}}@\[\]\u00C0-\u017E-]|(?<=[{word}])\s(?=[{word}]))+\z")


def all_wildcard(text: Column) -> Column:
    return text.rlike(r"\A[.*:]*\z")


_KEY_CHAR = r"\p{IsAlphabetic}\p{N}_.?!:;\\/\u00C0-\u017E'\"@-"


def resolve_scope(calls: DataFrame) -> DataFrame:
    """Add ``prefix``, the scope of a template call as dotted text: literals as they are, a variable
    part as ``*``, ``nil`` and ``[]`` dropped (empty text); null when it cannot be read."""
    scope, flat, body, parts = (F.col(c) for c in ("scope", "_flat", "_body", "_parts"))
    percent_body = F.substring(scope, F.lit(4), F.greatest(F.length(scope) - 4, F.lit(0)))
    words = F.array_join(F.filter(F.split(percent_body, r"(?U)\s+"), lambda w: w != ""), ".")
    percent = F.when(~(scope.rlike(r"\A%[IW]") & percent_body.contains("#{")), words)
    array = flat.startswith("[")
    first = F.when(array, F.regexp_extract(flat, r"\A\[([^\[\]]*)\]", 1)).otherwise(F.regexp_extract(flat, r"\A([^,\]]*)", 1))
    readable = body.rlike(rf"(?U)\A[,{_KEY_CHAR}]*\z") & F.when(array, flat.rlike(r"\A\[[^\[\]]*\]")).otherwise(True)
    part = F.transform(
        F.split(F.regexp_replace(body, r",\z", ""), ","),
        lambda a: F.when(a == "nil", "")
        .when(a.rlike(r"\A[A-Za-z0-9_@]"), "*")
        .when(a.rlike(rf"(?U):?(?:{_STRING})|:\w+"), strip_literal(a)),
    )
    unread = F.lit(None).cast("string")
    joined = F.when(~F.array_contains(F.transform(parts, lambda p: p.isNull()), True), F.array_join(F.filter(parts, lambda p: p != ""), "."))
    prefix = (
        F.when(scope.isNull(), "")
        .when(F.trim(scope) == "", unread)
        .when(scope.startswith("%"), percent)
        .when(~readable, unread)
        .when(body == "", "")
        .otherwise(joined)
    )
    return (
        calls.withColumn("_flat", F.replace(scope, F.lit(" "), F.lit("")))
        .withColumn("_body", first)
        .withColumn("_parts", part)
        .withColumn("prefix", prefix)
        .drop("_flat", "_body", "_parts")
    )


def _ruby_text(literal: Column) -> Column:
    """One or several adjacent Ruby literals as text, interpolation as ``*:``; single quotes do not interpolate."""
    joined = F.regexp_replace(strip_literal(literal), r'''(?<!\\)["']\s*(?:\\\s*)?["']''', "")
    text = F.regexp_replace(joined, r'\\(["\'])', "$1")
    return F.when(literal.rlike(r"\A:?'"), text).otherwise(interpolation_to_pattern(text, bare_braces=True))


_LITERAL_START = r'''\A:?["']|\A:\w'''


_PLAIN_SYMBOL = r"\A:\w+\z"
_PLAIN_LITERAL = r"""\A:?(?:'[^'"\\#{}]*'|"[^'"\\#{}]*")\z"""


def list_items(text: Column) -> Column:
    """The items of a Ruby list, or the one value that is no list, with nested array literals flattened to any depth.

    Commas part items outside strings, comments and the brackets of other expressions. A square bracket that begins an
    item opens an array literal; one behind something, as in ``names[:a]``, belongs to the item.
    """
    state = "struct<depth:int,arrays:int,item:string,items:array<string>>"
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("arrays"), F.lit("").alias("item"), F.array().cast("array<string>").alias("items")).cast(state)

    def step(s: Column, token: Column) -> Column:
        top = s["depth"] == 0
        literal = top & (token == "[") & ~s["item"].rlike(r"\S")
        ends = top & (token == "]") & (s["arrays"] > 0)
        parts = top & (token == ",")
        kept = ~(literal | ends | parts | token.startswith("#"))
        depth = s["depth"] + F.when(~literal & token.isin("(", "[", "{"), 1).when(~ends & token.isin(")", "]", "}"), -1).otherwise(0)
        return F.struct(
            depth.cast("int").alias("depth"),
            (s["arrays"] + F.when(literal, 1).when(ends, -1).otherwise(0)).cast("int").alias("arrays"),
            F.when(kept, F.concat(s["item"], token)).when(parts, "").otherwise(s["item"]).alias("item"),
            F.when(parts, F.concat(s["items"], F.array(s["item"]))).otherwise(s["items"]).alias("items"),
        )

    tokens = F.regexp_extract_all(text, F.lit(_R_ITEM_TOKEN), F.lit(0))
    found = F.aggregate(tokens, start, step, lambda s: F.concat(s["items"], F.array(s["item"])))
    return F.transform(found, lambda i: F.regexp_replace(i, r"\A\s+|\s+\z", ""))


def keyword_scope(scope: Column) -> Column:
    """Ruby scope as a dotted prefix: nested arrays flattened, interpolation ``*:``, any other
    expression ``*``, ``nil`` dropped; null for numbers, hashes, or nothing static."""
    percent_body = F.substring(scope, F.lit(4), F.greatest(F.length(scope) - 4, F.lit(0)))
    words = F.filter(F.split(percent_body, r"\s+"), lambda w: w != "")
    items = F.filter(list_items(scope), lambda i: (i != "") & (i != "nil"))

    def joined(items: Column) -> Column:
        unusable = F.exists(items, lambda i: i.rlike(r"\A(?:[0-9{]|\w+: )"))
        parts = F.transform(items, lambda i: F.when(i.rlike(_LITERAL_START), _ruby_text(i)).otherwise("*"))
        return F.when(~unusable, F.when(scope.startswith("%"), F.array_join(words, ".")).otherwise(F.array_join(parts, ".")))

    # one pass over the list: the text is made once, and looked at afterwards
    text = F.transform(F.transform(F.array(items), joined), lambda t: F.when((t == "") | ~all_wildcard(t), t))
    return F.when(F.trim(scope) != "", F.element_at(text, 1))


def argument_kind(arg: Column, text: Column) -> Column:
    """``key``, ``pattern`` or ``opaque`` for a Ruby argument; null for a number."""
    return F.when(arg.rlike(_LITERAL_START), F.when(text.contains("*:"), "pattern").otherwise("key")).when(~arg.rlike(r"\A[0-9]"), "opaque")


def reduce_argument(calls: DataFrame) -> DataFrame:
    """Add ``arg_text`` (adjacent literals joined, interpolation ``*:``) and ``arg_kind``.

    Two plain columns: as fields of one struct each use would evaluate the text again.
    """
    arg = F.col("arg")
    body = F.when(arg.startswith(":"), F.substring(arg, F.lit(2), F.length(arg))).otherwise(arg)
    # most literals hold nothing to resolve
    plain = F.when(arg.rlike(_PLAIN_SYMBOL), body).when(arg.rlike(_PLAIN_LITERAL), F.substring(body, F.lit(2), F.length(body) - 2))
    text = F.coalesce(plain, F.when(arg.rlike(_LITERAL_START), _ruby_text(arg)).otherwise(arg))
    return calls.withColumn("arg_text", text).withColumn("arg_kind", argument_kind(arg, F.col("arg_text")))


def relative_key(rows: DataFrame, roots: list[str]) -> DataFrame:
    """Add ``absolute``: a leading-dot key resolved below the longest matching root of its path;
    null when there is no root."""
    below = F.concat(P.template_path("path", "_root"), F.array(F.substring("key", F.lit(2), F.length("key"))))
    return (
        rows.withColumn("_root", P.matching_root("path", roots))
        .withColumn("absolute", F.when(~F.col("key").startswith("."), F.col("key")).when(F.col("_root").isNotNull(), K.join_key(below)))
        .drop("_root")
    )


def _result(kind, key) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key"))


_RESULTS = "array<struct<kind:string,key:string>>"


def classify_key(calls: DataFrame, roots: list[str]) -> DataFrame:
    """One row per thing a template call contributes, with ``kind``, ``key``, ``raw_key``.

    A trailing dot gives the key ``a.:`` and the pattern ``a.*:``; an all-wildcard pattern is
    an opaque call; a marked comment (``magic``) keeps static keys only. Takes arg, scope,
    path, magic.
    """
    none = F.array().cast(_RESULTS)
    arg, magic, raw, key, prefix, final = (F.col(c) for c in ("arg", "magic", "raw_key", "absolute", "prefix", "_final"))
    full = F.when(prefix == "", key).otherwise(F.concat(prefix, F.lit("."), key))
    # The pattern form: of the key alone when the scope already holds a wildcard.
    derived = F.when(prefix.contains("*"), F.concat(prefix, F.lit("."), interpolation_to_pattern(key))).otherwise(interpolation_to_pattern(final))
    dotted = F.when(prefix.contains("*") & F.col("_derived").endswith("."), F.concat("_derived", F.lit("*:"))).otherwise(F.col("_derived"))
    pattern = F.array(F.when(all_wildcard(F.col("_pattern")), _result("opaque", raw)).otherwise(_result("pattern", F.col("_pattern"))))
    keyed = F.when(final.endswith(".:"), F.array(_result("key", final), _result("pattern", F.regexp_replace(final, r":\z", "*:")))).otherwise(
        F.array(_result("key", final))
    )
    results = (
        F.when(key.isNull(), none)
        .when(prefix.isNull() | ((prefix != "") & all_wildcard(prefix)), F.when(magic, none).otherwise(F.array(_result("opaque", raw))))
        .when((prefix == "") & arg.rlike(r"\A[A-Za-z0-9_]"), none)
        .when(prefix.contains("*"), F.when(magic | ~valid_key(key), none).otherwise(pattern))
        .when(~valid_key(final) | (magic & final.contains("#{")), none)
        .when(final.contains("#{"), pattern)
        .otherwise(keyed)
    )
    staged = resolve_scope(relative_key(calls.withColumn("raw_key", strip_literal(arg)).withColumn("key", raw), roots))
    return (
        staged.withColumn("_full", full)
        .withColumn("_final", F.when(F.col("_full").endswith("."), F.concat("_full", F.lit(":"))).otherwise(F.col("_full")))
        .withColumn("_derived", derived)
        .withColumn("_pattern", dotted)
        .withColumn("r", F.explode(results))
        .withColumn("kind", F.col("r.kind"))
        .withColumn("key", F.when(F.col("kind") != "opaque", F.col("r.key")))
        .withColumn("candidate_keys", F.when(F.col("kind") == "opaque", F.array().cast("array<string>")).otherwise(F.array("key")))
    )


# --- scans ---------------------------------------------------------------------------

OCCURRENCE = ["project", "path", "pos", "line_num", "line_pos", "key", "raw_key", "candidate_keys", "kind"]


def _needled(files: DataFrame) -> DataFrame:
    """Files without a needle lose their content. A filter would make every text again where the rows are read."""
    return files.withColumn("content", F.when(has_needle("content"), F.col("content")))


def _classified_lines(files: DataFrame, *carried: str) -> DataFrame:
    calls = extract_calls(_needled(files), *carried)
    return calls.withColumn("line_kind", line_kind(extension("path"), F.col("scanner"), F.col("line_head"))).where(F.col("line_kind") != "comment")


def scan_templates(files: DataFrame, roots: list[str]) -> DataFrame:
    """Occurrences of files read by the plain scanner. No shuffle."""
    calls = _classified_lines(files.where(scanner_kind("path") == "template"))
    return classify_key(calls.withColumn("magic", F.col("line_kind") == "magic"), roots).select(*OCCURRENCE)


def _ruby_calls(files: DataFrame, *carried: str) -> DataFrame:
    """Calls of Ruby files and code tags with argument and scope reduced; no context yet."""
    # numbers go before the argument's text is made, which a test of ``arg_kind`` would make twice
    static = F.col("arg").rlike(_LITERAL_START) | ~F.col("arg").rlike(r"\A[0-9]")
    calls = reduce_argument(_classified_lines(files.where(scanner_kind("path") != "template"), *carried).where(static))
    magic = F.col("line_kind") == "magic"
    comment_at = F.instr("line_head", "#") - 1
    return (
        calls.withColumn("prefix", F.when(F.col("scope").isNull(), "").otherwise(keyword_scope(F.col("scope"))))
        .withColumn("magic", magic)
        .withColumn("pos", F.when(magic & (comment_at >= 0), F.col("pos") - F.col("line_pos") + comment_at).otherwise(F.col("pos")))
        .withColumn("line_pos", F.when(magic & (comment_at >= 0), comment_at).otherwise(F.col("line_pos")))
        .withColumn("relative", F.col("arg_text").startswith(".") & ~F.col("receiver") & (F.col("arg_kind") != "opaque"))
    )


def full_key(prefix: Column, text: Column, relative: Column, context: Column, candidate: Column) -> Column:
    """All keys a Ruby call may name, most specific first. Absolute and plain relative keys give
    one; a controller action gives one per enclosing level, never the bare key."""
    rest = F.when(text.startswith("."), F.substring(text, F.lit(2), F.length(text))).otherwise(text)
    levels = F.when(F.size(context) > 0, F.sequence(F.size(context), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    stepped = F.transform(levels, lambda n: K.join_key(F.concat(F.array(prefix), F.slice(context, F.lit(1), n), F.array(rest))))
    below = F.when(relative, context).otherwise(F.array().cast("array<string>"))
    return F.when(relative & candidate, stepped).otherwise(F.array(K.join_key(F.concat(F.array(prefix), below, F.array(rest)))))


def _ruby_results(calls: DataFrame) -> DataFrame:
    """Occurrences from reduced calls that carry ``context`` (null: no relative keys here) and
    ``candidate``."""
    empty = F.array().cast("array<string>")
    candidates = full_key(F.col("prefix"), F.col("arg_text"), F.col("relative"), F.coalesce("context", empty), F.coalesce("candidate", F.lit(False)))
    first = F.col("_first")
    dynamic = F.col("prefix").contains("*") | (F.col("arg_kind") == "pattern")
    dotted = F.col("_dotted")
    none = F.array().cast(_RESULTS)
    opaque = F.when(F.col("magic"), none).otherwise(F.array(_result("opaque", F.col("arg"))))
    pattern = F.when(F.col("magic"), none).otherwise(F.array(F.when(all_wildcard(dotted), _result("opaque", F.col("arg"))).otherwise(_result("pattern", dotted))))
    keyed = F.when(
        first.endswith(".") & ~F.col("magic") & ~all_wildcard(dotted), F.array(_result("key", first), _result("pattern", dotted))
    ).otherwise(F.array(_result("key", first)))
    results = (
        F.when(F.col("relative") & F.col("context").isNull(), none)
        .when((F.col("arg_kind") == "opaque") | F.col("prefix").isNull(), opaque)
        .when(F.size("candidates") == 0, none)
        .when(dynamic, pattern)
        .otherwise(keyed)
    )
    return (
        calls.withColumn("candidates", candidates)
        .withColumn("_first", F.get("candidates", F.lit(0)))
        .withColumn("_dotted", F.when(first.endswith("."), F.concat(first, F.lit("*:"))).otherwise(first))
        .withColumn("r", F.explode(results))
        .withColumn("kind", F.col("r.kind"))
        .withColumn("key", F.when(F.col("kind") != "opaque", F.col("r.key")))
        .withColumn("raw_key", F.when(F.col("kind") == "opaque", F.col("arg")).otherwise(F.col("arg_text")))
        .withColumn("candidate_keys", F.when(F.col("kind") == "opaque", empty).otherwise(F.col("candidates")))
    )


def comment_covers_next(occ: DataFrame) -> DataFrame:
    """Drop opaque calls on the line after a marked comment that named a key. One window per
    file, so the scan above is not read twice."""
    line_before = Window.partitionBy("project", "path").orderBy("line_num").rangeBetween(-1, -1)
    named = F.max(F.col("magic") & (F.col("kind") == "key")).over(line_before)
    return occ.withColumn("_covered", F.coalesce(named, F.lit(False))).where(~((F.col("kind") == "opaque") & F.col("_covered"))).drop("_covered")


def scan_code_tags(files: DataFrame, roots: list[str]) -> DataFrame:
    """Occurrences of tagged templates: relative keys resolve against the template's own path."""
    calls = _ruby_calls(files.where(scanner_kind("path") == "erb"))
    context = F.when(F.col("_root").isNotNull(), P.template_path("path", "_root"))
    rooted = calls.withColumn("_root", P.matching_root("path", roots)).withColumn("context", context)
    out = _ruby_results(rooted.withColumn("candidate", F.lit(False)))
    return comment_covers_next(out).select(*OCCURRENCE)


# --- Ruby context --------------------------------------------------------------------

_DEFINITION = r"\A([ \t]*)(class|module|def)[ \t]+(?:self\.)?([\w:]+[?!=]?)"
_ONE_LINE = r"\A[ \t]*(?:def[ \t][^=;]*?\)?[ \t]*=[^=~>]|def[ \t]+[\w.?!]+[ \t]*=[ \t]|.*;[ \t]*end[ \t]*\z)"


def source_lines(files: DataFrame) -> DataFrame:
    """(project, path, line_num, line), lines numbered from 1."""
    return files.select("project", "path", F.posexplode(F.split("content", "\n")).alias("i", "line")).select(
        "project", "path", (F.col("i") + 1).alias("line_num"), "line"
    )


def _definition_lines(lines: DataFrame) -> DataFrame:
    """Lines that open a definition, say ``private`` or ``end``, with the line that closes each."""
    marked = (
        lines.withColumn("what", F.regexp_extract("line", _DEFINITION, 2))
        .withColumn("name", F.regexp_extract("line", _DEFINITION, 3))
        .withColumn("is_end", F.col("line").rlike(r"\A[ \t]*end\b"))
        .withColumn("what", F.when(F.col("line").rlike(r"\A[ \t]*private\b"), "private").otherwise(F.col("what")))
        .where((F.col("what") != "") | F.col("is_end"))
        .withColumn("indent", F.length(F.regexp_extract("line", r"\A([ \t]*)", 1)))
    )
    later = Window.partitionBy("project", "path", "indent").orderBy("line_num").rowsBetween(1, Window.unboundedFollowing)
    closes = F.first(F.when(F.col("is_end"), F.col("line_num")), ignorenulls=True).over(later)
    end = F.when(F.col("line").rlike(_ONE_LINE), F.col("line_num")).otherwise(F.col("closes"))
    return (
        marked.withColumn("closes", closes)
        .where(F.col("what") != "")
        .select("project", "path", F.col("line_num").alias("start_line"), end.alias("end_line"), "what", "name")
    )


def definition_ranges(lines: DataFrame) -> DataFrame:
    """Class, module and method ranges by indentation: (project, path, start_line, end_line, what,
    name). A definition ends at the first later ``end`` of its own indent; ``end_line`` is null
    when there is none, and such files are not fit for automatic removal."""
    return _definition_lines(lines).where(F.col("what") != "private")


def innermost_scope(points: DataFrame, ranges: DataFrame, at: str = "line_num") -> DataFrame:
    """Each point with the smallest range that holds it; points outside every range keep nulls.

    ``ranges`` columns besides project, path, start_line, end_line come along.
    """
    extra = [c for c in ranges.columns if c not in ("project", "path")]
    r = ranges.select(F.col("project").alias("r_project"), F.col("path").alias("r_path"), F.struct(*extra).alias("_range"))
    inside = (
        (F.col("r_project") == F.col("project"))
        & (F.col("r_path") == F.col("path"))
        & (F.col("_range.start_line") <= F.col(at))
        & (F.col(at) <= F.col("_range.end_line"))
    )
    joined = points.join(r, inside, "left").drop("r_project", "r_path")
    best = F.min_by("_range", F.struct(F.col("_range.end_line") - F.col("_range.start_line"), -F.col("_range.start_line")))
    return joined.groupBy(*points.columns).agg(best.alias("_best")).select(*points.columns, *[F.col(f"_best.{c}").alias(c) for c in extra])


#: A line that defines nothing and ends nothing; one pass empties them all.
_OTHER_LINE = r"(?md)^(?![ \t]*(?:(?:class|module|def)[ \t]|(?:private|end)\b))[^\n]++"


def _file_definitions(files: DataFrame) -> DataFrame:
    """Add ``all``: what ``_definition_lines`` says of each file, as an array of (start, end, what, name), by start."""
    lines = F.transform(F.split(F.regexp_replace("content", _OTHER_LINE, ""), "\n", -1), lambda line, i: F.struct((i + 1).alias("n"), line.alias("line")))
    read = F.transform(
        F.filter(lines, lambda r: r["line"] != ""),
        lambda r: F.struct(
            r["n"].alias("n"), (F.length(r["line"]) - F.length(F.ltrim(r["line"], F.lit(" \t")))).alias("indent"),
            F.ltrim(r["line"], F.lit(" \t")).startswith("end").alias("is_end"), r["line"].alias("line"),
        ),
    )
    closes = lambda d: F.array_min(F.transform(F.filter("_ends", lambda e: (e["indent"] == d["indent"]) & (e["n"] > d["n"])), lambda e: e["n"]))
    what = lambda line: F.when(F.ltrim(line, F.lit(" \t")).startswith("private"), "private").otherwise(F.regexp_extract(line, _DEFINITION, 2))
    made = F.transform(
        F.filter("_read", lambda r: ~r["is_end"]),
        lambda d: F.struct(
            d["n"].alias("start"), F.when(d["line"].rlike(_ONE_LINE), d["n"]).otherwise(closes(d)).alias("end"), what(d["line"]).alias("what"), F.regexp_extract(d["line"], _DEFINITION, 3).alias("name")
        ),
    )
    return (
        files.withColumn("_read", read)
        .withColumn("_ends", F.filter("_read", lambda r: r["is_end"]))
        .withColumn("all", F.filter(made, lambda d: d["what"] != ""))
        .drop("_read", "_ends")
    )


def method_contexts(files: DataFrame, roots: list[str], exclude_method_name: list[str] | None = None) -> DataFrame:
    """Add ``methods`` to Ruby files (project, path, content): structs of span, back (minus the start), start, end, context,
    candidate. Everything happens in the file's own row.

    A method attaches to the classes and modules around it. Its context, the key path of a
    relative key, is null where none resolves: in a module, in a class of no supporting kind,
    or after a bare ``private``. The list is bounded by the file, which is one value itself.
    """
    columns = files.columns

    def home_path(h: Column) -> Column:
        snake = F.transform(F.split(h["name"], "::"), K.underscore)
        cut = F.transform(snake, lambda part, i: F.when(i == F.size(snake) - 1, F.regexp_replace(part, r"_controller\z", "")).otherwise(part))
        return F.when((h["what"] == "class") & h["name"].endswith("Controller"), cut).otherwise(snake)

    per_file = _file_definitions(files)
    skipped = [r.rstrip("/") for r in (exclude_method_name or [])]
    staged = (
        per_file.withColumn("homes", F.transform(
            F.filter("all", lambda d: d["what"].isin("class", "module")),
            lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), h["what"].alias("what"), h["name"].alias("name"), home_path(h).alias("keys")),
        ))
        .withColumn("_root", P.matching_root("path", roots))
        .withColumn("_component", F.col("path").contains("app/components/"))
        .withColumn("_no_name", F.col("_component") | F.coalesce(F.rtrim(F.col("_root"), F.lit("/")).isin(skipped), F.lit(False)))
        .withColumn("_any_class", F.col("_component") | F.col("_root").isNotNull())
    )
    # Where each bare `private` stands: the start of the innermost class around it.
    private = F.transform(
        F.filter("all", lambda d: d["what"] == "private"),
        lambda p: F.struct(
            p["start"].alias("at"),
            F.array_max(F.transform(F.filter("homes", lambda h: (h["what"] == "class") & (h["start"] < p["start"]) & (p["start"] < h["end"])), lambda h: h["start"])).alias("of"),
        ),
    )
    methods = F.transform(
        F.filter("all", lambda d: d["what"] == "def"),
        lambda d: F.struct(
            d["start"].alias("start"), d["end"].alias("end"), d["name"].alias("name"),
            F.filter("homes", lambda h: (h["start"] < d["start"]) & (d["start"] < h["end"])).alias("homes"),
        ),
    )
    owned = F.transform(
        "methods",
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["name"].alias("name"), m["homes"].alias("homes"), F.try_element_at(m["homes"], F.lit(-1)).alias("owner")),
    )

    def context(m: Column) -> Column:
        owner = m["owner"]
        supports = (owner["what"] == "class") & (F.col("_any_class") | owner["name"].endswith("Controller") | owner["name"].endswith("Mailer"))
        hidden = F.exists("private", lambda p: (p["of"] == owner["start"]) & (p["at"] < m["start"]))
        path = F.flatten(F.transform(m["homes"], lambda h: h["keys"]))
        named = F.concat(path, F.when(F.col("_no_name"), F.array().cast("array<string>")).otherwise(F.array(m["name"])))
        return F.when(F.coalesce(supports, F.lit(False)) & ~F.coalesce(hidden, F.lit(False)), named)

    made = F.transform(
        "owned",
        lambda m: F.struct(
            (m["end"] - m["start"]).alias("span"), (-m["start"]).alias("back"), m["start"].alias("start"), m["end"].alias("end"), context(m).alias("context"),
            F.coalesce((m["owner"]["what"] == "class") & m["owner"]["name"].endswith("Controller"), F.lit(False)).alias("candidate"),
        ),
    )
    return (
        staged.withColumn("private", private).withColumn("methods", methods).withColumn("owned", owned).select(*columns, made.alias("methods"))
    )


def scan_ruby(files: DataFrame, roots: list[str], exclude_method_name: list[str] | None = None) -> DataFrame:
    """Occurrences of Ruby files; a relative key takes the context of the innermost method around it."""
    ruby = _needled(files.where(scanner_kind("path") == "ruby"))
    around = F.array_min(F.filter("methods", lambda m: (m["start"] <= F.col("line_num")) & (F.col("line_num") <= m["end"])))

    def found(some: DataFrame) -> DataFrame:
        calls = _ruby_calls(method_contexts(some, roots, exclude_method_name), "methods")
        placed = calls.withColumn("_method", F.when(F.col("relative"), around)).withColumn("context", F.col("_method.context"))
        return _ruby_results(placed.withColumn("candidate", F.col("_method.candidate")).drop("methods", "_method")).select(*OCCURRENCE, "magic")

    # only calls of a file with a marked comment meet in a window; the others stay where they are
    content, marked = F.col("content"), F.col("content").contains(MARKER)
    plain, commented = (ruby.withColumn("content", F.when(of, content)) for of in (~marked, marked))
    return found(plain).unionByName(comment_covers_next(found(commented))).select(*OCCURRENCE)


def magic_comments(files: DataFrame, roots: list[str]) -> DataFrame:
    """Keys named by marked comments of any file."""
    from polyglint.operators.usage import merge_scans

    marked = files.where(F.col("content").rlike(MARKER))
    ruby = _ruby_results(_ruby_calls(marked).where("magic").withColumn("context", F.lit(None).cast("array<string>")).withColumn("candidate", F.lit(False))).select(*OCCURRENCE)
    calls = _classified_lines(marked.where(scanner_kind("path") == "template")).where(F.col("line_kind") == "magic")
    template = classify_key(calls.withColumn("magic", F.lit(True)), roots).select(*OCCURRENCE)
    return merge_scans(ruby, template).where(F.col("kind") == "key")


def scan(files: DataFrame, roots: list[str], exclude_method_name: list[str] | None = None) -> DataFrame:
    """All occurrences of a source tree: project, path, content in, occurrence rows out."""
    from polyglint.operators.usage import merge_scans

    return merge_scans(scan_templates(files, roots), scan_code_tags(files, roots), scan_ruby(files, roots, exclude_method_name))


# --- positions -----------------------------------------------------------------------


def line_offsets(lines: DataFrame) -> DataFrame:
    """Byte offset at which each line starts: running sum of the lengths before it."""
    before = Window.partitionBy("project", "path").orderBy("line_num").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("start", F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)))


def locate(points: DataFrame, starts: DataFrame) -> DataFrame:
    """Add line_num and line_pos to (project, path, pos): the last line start not after it.

    Both sides go through one window per file, so nothing is paired.
    """
    marks = starts.select("project", "path", F.col("start").alias("at"), "line_num", "start", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("pos"))
    asked = points.select(
        "project", "path", F.col("pos").cast("bigint").alias("at"), F.lit(None).cast("int").alias("line_num"),
        F.lit(None).cast("bigint").alias("start"), F.lit(1).alias("side"), F.col("pos").cast("bigint").alias("pos"),
    )
    so_far = Window.partitionBy("project", "path").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asked)
    return (
        both.withColumn("line_num", F.last("line_num", ignorenulls=True).over(so_far))
        .withColumn("start", F.last("start", ignorenulls=True).over(so_far))
        .where(F.col("side") == 1)
        .select("project", "path", "pos", "line_num", (F.col("pos") - F.col("start")).alias("line_pos"))
    )
