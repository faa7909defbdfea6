"""Personal data: fixed patterns, and terms that the corpus shows to reveal what they found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyglint.llm.storage import saved, stable

#: Fixed patterns. Quantifiers are possessive and beginnings guarded where that changes no match, so that no text takes
#: more than linear time. ``\G`` lets a match begin where the one before ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = (*PATTERNS, "term")
#: Lines that can hold a match; none of the patterns crosses a line break.
_SOME = r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]++\.[A-Za-z0-9-]|[0-9]\.[0-9]++\.[0-9]++\.[0-9]|[0-9](?:[\x20-]?+[0-9]){13}|\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|(?<=0))"

#: A term reveals an entity, or a class of entities, if their pointwise mutual information is at least DISCLOSURE times
#: the information of the class. 1 would ask that the term never stands without it. The share of the term's documents
#: that hold the class is taken with SMOOTHING documents of the corpus's own share added, so that the fewer documents a
#: pair has, the rarer the class must be.
DISCLOSURE = 0.9
SMOOTHING = 0.5
#: Digits of a card or phone number that make its class.
_DIGITS = 6
#: Terms are words of three letters or more: shorter ones stand in most documents and in all languages.
_TERM = r"\p{L}{3,}+"
#: A filter of words or rows has 2^CELL_BITS cells of 64 bits. It bounds what is broadcast; when it fills up, more rows are
#: moved, and nothing else changes.
CELL_BITS = 18


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return (
        F.when(kind == "ip", match.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def _matches(lines: DataFrame, kind: str, pattern: str | Column) -> DataFrame:
    """Matches of one pattern, or of each line's own, in lines (row, doc_id, line_no, offset, line): row, doc_id, line_no, kind, match, start,
    end, in code points of the text. What stands between the matches gives their places."""
    between = F.transform(F.split("line", F.lit(pattern), -1), lambda x: F.char_length(x))
    found = F.regexp_extract_all(F.col("line"), F.lit(pattern), F.lit(0))
    each = lines.select("row", "doc_id", "line_no", "offset", F.posexplode(F.arrays_zip(found.alias("match"), between.alias("gap"))).alias("i", "x"))
    each = each.select("row", "doc_id", "line_no", "offset", "i", F.col("x.match").alias("match"), F.col("x.gap").alias("gap")).where("match IS NOT NULL")
    upto = Window.partitionBy("row", "line_no").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("offset") + F.sum(F.col("gap") + F.char_length("match")).over(upto)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("match"))
    return placed.select("row", "doc_id", "line_no", F.lit(kind).alias("kind"), "match", "start", "end")


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty) and a number for each row."""
    return stable(docs.select("doc_id", "text")).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))


def contexts(rows: DataFrame) -> DataFrame:
    """The lines of ``numbered`` rows that can hold a match, and where in their text they begin."""
    lines = rows.where(F.col("text").rlike(_SOME)).select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("row", "doc_id", "line_no", (F.char_length("line") + 1).alias("width"), F.when(F.col("line").rlike(_SOME), F.col("line")).alias("line"))
    before = Window.partitionBy("row").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("width").over(before), F.lit(0)).cast("long")
    return lines.withColumn("offset", offset).where("line IS NOT NULL").drop("width")


def base_spans(lines: DataFrame) -> DataFrame:
    """Valid matches of the fixed patterns in ``contexts``."""
    each = [_matches(lines, kind, pattern) for kind, pattern in PATTERNS.items()]
    found = reduce(DataFrame.unionByName, each)
    return found.where(_valid(F.col("kind"), F.col("match")))


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``key`` is in ``wanted`` (a table of one column of that name), and a few more: rows are held
    to a filter where they stand, so that few are moved by the join that follows."""
    code, columns = F.xxhash64(key), rows.columns
    cell, bit = F.shiftrightunsigned("_code", 64 - CELL_BITS).alias("_cell"), F.expr("shiftleft(1L, cast(_code & 63 AS int))").alias("_bit")
    cells = wanted.select(code.alias("_code")).select(cell, bit).groupBy("_cell").agg(F.bit_or("_bit").alias("_bits"))
    coded = rows.withColumn("_code", code).select(*columns, cell, bit)
    return coded.join(F.broadcast(cells), "_cell").where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(columns)


def document_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, form, term) for those distinct words of each row, as they are written, whose lower-case form is in ``terms``
    (term)."""
    forms = F.array_distinct(F.regexp_extract_all(F.col("text"), F.lit(_TERM), F.lit(0)))
    each = rows.select("row", F.explode(forms).alias("form")).withColumn("term", F.lower("form"))
    # an inner join: a semi-join would be moved below the filter
    return among(each, "term", terms).join(terms.distinct(), "term")


def document_frequencies(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, in_documents) of ``terms`` (term) over all rows."""
    forms = F.regexp_extract_all(F.col("text"), F.lit(_TERM), F.lit(0))
    own = F.array_distinct(F.transform(forms, lambda w: F.lower(w)))
    each = among(rows.select(F.explode(own).alias("term")), "term", terms)
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("in_documents"))


_CLASS = ["kind", "level", "class"]


def classes(entities: DataFrame) -> DataFrame:
    """(row, line_no, kind, level, class) of ``entities`` (row, line_no, kind, entity): each value, what it shares with
    others (mail domain, network, first digits), and its kind."""
    entity = F.col("entity")
    part = (
        F.when(F.col("kind") == "email", F.substring_index(entity, "@", -1))
        .when(F.col("kind") == "ip", F.substring_index(entity, ".", 3))
        .otherwise(F.substring(entity, 1, _DIGITS))
    )
    levels = [F.struct(F.lit(level).alias("level"), value.alias("class")) for level, value in (("value", entity), ("part", part), ("kind", F.lit("")))]
    each = entities.select("row", "line_no", "kind", F.explode(F.array(*levels)).alias("of"))
    return each.select("row", "line_no", "kind", "of.level", "of.class")


def _discloses(both: Column, disclosure: float) -> Column:
    """Whether so many common documents of class and term pass, given n, n_c and in_documents. With P(c) = n_c / n:
    log(P(c | term) / P(c)) >= disclosure * -log(P(c))."""
    share = F.col("n_c") / F.col("n")
    given = (both + SMOOTHING * share) / (F.col("in_documents") + SMOOTHING)
    return F.log(given) >= (1 - disclosure) * F.log(share)


def disclosing_terms(rows: DataFrame, terms: DataFrame, entities: DataFrame, *, disclosure: float) -> DataFrame:
    """The terms whose mutual information with a class of ``entities`` is at least ``disclosure`` times the information
    of the class, as (kind, level, class, term).

    Candidates stand on one line with the entity in some document; all counts are of documents: those with the class
    (n_c), with the term (in_documents), and with both, wherever they stand in it. Pairs that could not pass if every
    document of the rarer one held the other are discarded before common documents are counted.
    """
    of = saved(classes(entities).distinct())
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    holds = saved(of.drop("line_no").distinct())
    by_class = holds.groupBy(_CLASS).agg(F.count(F.lit(1)).alias("n_c"))
    near = saved(terms.select("row", "line_no", "term").distinct().join(of, ["row", "line_no"]).select(*_CLASS, "term").distinct())
    frequencies = saved(document_frequencies(rows, near.select("term").distinct()))
    counted = near.join(by_class, _CLASS).join(frequencies, "term").join(F.broadcast(total))
    possible = saved(counted.where(_discloses(F.least("n_c", "in_documents"), disclosure)))
    # rows without an entity go in the join on row; those that cannot have one are not looked at
    some = rows.where(F.col("text").rlike(_SOME))
    present = saved(document_terms(some, saved(possible.select("term").distinct())).select("row", "term").distinct())
    both = present.join(holds, "row").groupBy(*_CLASS, "term").agg(F.count(F.lit(1)).alias("n_ct"))
    return possible.join(both, [*_CLASS, "term"]).where(_discloses(F.col("n_ct"), disclosure)).select(*_CLASS, "term")


def occurrences(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Every occurrence of ``terms`` (term) in ``rows``, as spans of kind ``term``."""
    forms = document_terms(rows, terms)
    # the words are letters only, so they stand in a pattern as they are
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(F.sort_array(F.collect_list("form")), "|"), F.lit(r")(?!\p{L})"))
    held = saved(forms.groupBy("row").agg(pattern.alias("pattern")))
    lines = among(rows, "row", held.select("row")).join(held, "row").select("row", "doc_id", F.lit(0).alias("line_no"), F.lit(0).cast("long").alias("offset"), F.col("text").alias("line"), "pattern")
    return _matches(lines, "term", F.col("pattern"))


def _outside(base: DataFrame, told: DataFrame) -> DataFrame:
    """Spans of ``base``, and those of ``told`` that overlap none of them."""
    by_row = Window.partitionBy("row").orderBy("start")
    ends, starts = (F.when(F.col("kind") != "term", F.col(c)) for c in ("end", "start"))
    before = F.max(ends).over(by_row.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min(starts).over(by_row.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    every = base.unionByName(told).withColumn("before", before).withColumn("behind", behind)
    free = F.coalesce(F.col("before") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("behind") >= F.col("end"), F.lit(True))
    return every.where((F.col("kind") != "term") | free).drop("before", "behind")


def spans(rows: DataFrame, *, disclosure: float = DISCLOSURE) -> DataFrame:
    """All spans of ``numbered`` rows: row, doc_id, kind, start, end (code points, end exclusive), each once.

    Kinds: those of PATTERNS, and ``term`` for words that reveal an entity or a class of entities, wherever they stand in
    any document, outside the matches.
    """
    lines = saved(contexts(rows))
    base = saved(base_spans(lines))
    entity = F.when(F.col("kind").isin("card", "phone"), F.regexp_replace("match", "[^0-9]", "")).otherwise(F.lower("match"))
    entities = base.select("row", "line_no", "kind", entity.alias("entity"))
    words = _matches(lines.join(base.select("row", "line_no").distinct(), ["row", "line_no"]), "term", _TERM)
    terms = saved(_outside(base, words).where("kind = 'term'").withColumn("term", F.lower("match")))
    reveal = saved(disclosing_terms(rows, terms, entities, disclosure=disclosure).select("term").distinct())
    columns = ["row", "doc_id", "kind", "start", "end"]
    return _outside(base.select(columns), occurrences(rows, reveal).select(columns))


def personal_data(docs: DataFrame, *, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_term, and ``found``, the
    spans as structs (start, rank of the kind, kind, end) in order of start and kind.

    Defined cases: null and empty texts have no spans; any length; a null doc_id is an id like any other; repeated rows
    are documents of their own, also in the counts; other columns are not looked at; an empty table gives an empty
    result.
    """
    rows = numbered(docs)
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    one = F.struct("start", rank.alias("rank"), "kind", "end")
    by_row = spans(rows, disclosure=disclosure).groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    none = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")
    joined = rows.select("doc_id", "row").join(by_row, "row", "left").select("doc_id", F.coalesce("found", none).alias("found"))
    return joined.select("doc_id", *[_count(k).alias(f"n_{k}") for k in KINDS], "found")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(docs: DataFrame, *, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` (doc_id, text) with each stretch of spans put as the kind of its first one in brackets: values are
    generalised to their kind, revealing terms to ``[TERM]``. Cases as in ``personal_data``; a null text stays null."""
    docs = stable(docs.select("doc_id", "text"))
    rows = numbered(docs)
    by_row = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    found = spans(rows, disclosure=disclosure)
    found = found.withColumn("fresh", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")).withColumn("stretch", F.sum("fresh").over(by_row))
    stretches = found.groupBy("row", "stretch").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end")).alias("kind"))
    lists = stretches.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    joined = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")).join(lists, "row", "left")
    kept = F.zip_with(
        F.concat(F.array(F.lit(0).cast("long")), F.transform("cuts", lambda c: c["end"])),
        F.concat(F.transform("cuts", lambda c: c["start"]), F.array(F.char_length("text").cast("long"))),
        lambda a, b: F.substring(F.col("text"), (a + 1).cast("int"), (b - a).cast("int")),
    )
    marks = F.concat(F.transform("cuts", lambda c: F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]"))), F.array(F.lit("")))
    text = F.array_join(F.zip_with(kept, marks, lambda a, b: F.concat(a, b)), "")
    return joined.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(text).alias("text"))
