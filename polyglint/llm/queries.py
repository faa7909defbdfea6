"""The registered queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import decontamination, exact, jaccard, labelled, lineruns, mixing, phrases, pii, quality, sharding, substring, toxicity, trie, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the sources in turn, and how far a schedule leans to the beginning or the end of training.
WEIGHTS = (5, 2, 1)
LEAN = 0.5
SHARE_OF_ALL = 1.5
MOST_USES = 2


def curriculum_plan(docs: DataFrame) -> DataFrame:
    """Targets and schedules of the sources of ``docs`` (source, size): weights in turn; the first of two sources
    fades, the second grows, with the same integral."""
    sources = mixing.ranked_sources(docs.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    lean = F.when(F.col("rank") % 2 == 0, F.lit(LEAN)).otherwise(F.lit(-LEAN))
    plan = mixing.targets(sources.withColumn("weight", weight), SHARE_OF_ALL, MOST_USES)
    return plan.withColumn("w_start", F.col("weight") * (1 + lean)).withColumn("w_end", F.col("weight") * (1 - lean))


@query(
    r"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
               md5(doc_id::VARCHAR) AS key
        FROM documents
    ), sources AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank
        FROM docs GROUP BY source
    ), weighed AS (
        SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap,
               1.5::DOUBLE * sum(source_size) OVER () AS total
        FROM sources
    ), levels AS (
        SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                  / sum(weight) OVER (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
        FROM weighed
    ), chosen AS (
        SELECT arg_min(level, (cap::DOUBLE / weight, rank)) AS level FROM levels WHERE cap >= weight * level
    ), targets AS (
        SELECT source, source_size, least(cap::DOUBLE, coalesce(weight * chosen.level, cap::DOUBLE)) AS target
        FROM weighed CROSS JOIN chosen
    ), placed AS (
        SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS wanted,
               coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
        FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    )
    SELECT doc_id, size, source_size, target,
           (greatest(0, least(size, wanted - before)) + greatest(0, least(size, wanted - source_size - before)))::BIGINT AS taken
    FROM placed
    """
)
def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", mixing.words_in(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("row")
    )
    plan = curriculum_plan(docs)
    used = mixing.curriculum(docs, plan).select("row", "doc_id", "source", "size", "take")
    rows = used.unionByName(docs.withColumn("take", F.lit(0).cast("long")))
    taken = rows.groupBy("row", "doc_id", "source", "size").agg(F.sum("take").alias("taken"))
    known = plan.select(F.col("source").alias("_source"), "source_size", "target")
    return taken.join(F.broadcast(known), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "source_size", "target", "taken")


@query(
    r"""
    WITH texts AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
    ), groups AS (
        SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY body
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t.body) AS text_sha256
    FROM texts t JOIN groups g ON t.body = g.body
    """
)
def op4_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates: which row of each group stays."""
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query()
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _scores(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    return rows.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col(value).alias("score"), (F.col(value) >= threshold).cast("int").alias("predicted"))


@query()
def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return _scores(quality.line_quality(docs, quality.train(docs, labels)), "quality", quality.THRESHOLD)


@query()
def op6_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    return _scores(toxicity.toxic_spans(docs, toxicity.train(docs, labels)), "toxicity", toxicity.THRESHOLD)


@query(
    r"""
    WITH texts AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents
    ), passages AS (
        SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM texts WHERE len(words) >= 50)
    ), firsts AS (
        SELECT h, min(doc_id) AS a FROM passages GROUP BY h
    ), covered AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM passages JOIN firsts USING (h) WHERE doc_id > a
    ), cuts AS (
        SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id
    ), kept AS (
        SELECT t.doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
               [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(coalesce(gone, []), i)] AS left_words
        FROM texts t LEFT JOIN cuts c ON t.doc_id = c.doc_id
    )
    SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
           sha256(coalesce(array_to_string(left_words, ' '), '')) AS kept_sha256
    FROM kept
    """
)
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words that an earlier document has."""
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


@query()
def op7_revealing_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed patterns, and terms that reveal what they found."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda s: s["kind"] != "term")
    counts = [f"n_{k}" for k in pii.PATTERNS]
    return found.select("doc_id", *counts, F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("found")).alias("spans"), "n_term")


@query(
    """
    WITH texts AS (
        SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
    ), runs AS (
        SELECT doc_id, i, lines[i] AS one, lines[i + 1] AS two
        FROM (SELECT doc_id, lines, unnest(range(1, len(lines))) AS i FROM texts)
    ), ranked AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY one, two ORDER BY doc_id, i) AS n FROM runs
    ), covered AS (
        SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM ranked WHERE n > 1
    ), cuts AS (
        SELECT doc_id, list(i) AS gone FROM covered GROUP BY doc_id
    )
    SELECT t.doc_id, len(lines)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
           sha256(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(coalesce(gone, []), i)], chr(10))) AS kept_sha256
    FROM texts t LEFT JOIN cuts c ON t.doc_id = c.doc_id
    """
)
def op8_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the runs of two lines or more that stand earlier."""
    kept = lineruns.without_repeated_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", F.col("lines_before").alias("n_lines"), F.col("lines_removed").alias("n_removed"), sha.alias("kept_sha256"))


@query()
def op5_benchmark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the best window."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    r"""
    WITH RECURSIVE texts AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
        FROM documents
    ), sets AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
               ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
        FROM texts
    ), grams AS (
        SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
    ), pairs AS (
        SELECT a.doc_id AS a, b.doc_id AS b FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
    ), reach AS (
        SELECT a AS node, b AS other FROM pairs
        UNION
        SELECT reach.node, pairs.b FROM reach JOIN pairs ON reach.other = pairs.a
    ), least AS (
        SELECT node, min(other) AS low FROM reach GROUP BY node
    )
    SELECT s.doc_id, len(s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id
    FROM sets s LEFT JOIN least l ON s.doc_id = l.node
    """
)
def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with similar shingle sets."""
    return jaccard.similar_components(table(spark, sf_dir, "documents"))


@query(
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, doc_id, p, regexp_extract_all(ps[p], '[^\x20\x09]+') AS w
        FROM (SELECT lang, doc_id, ps, unnest(range(1, len(ps) + 1)) AS p
              FROM (SELECT lang, doc_id, string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents))
    ), totals AS (
        SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang
    ), grams AS (
        SELECT lang, w[i:i + d - 1] AS g
        FROM (SELECT lang, w, d, unnest(range(1, len(w) - d + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4, 5]) AS d FROM pieces))
    ), counts AS (
        SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g HAVING count(*) >= 100
    ), candidates AS (
        SELECT lang, g, f FROM counts WHERE len(g) > 1
    ), cuts AS (
        SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, n, (1000 * c.f * n) // (x.f * y.f) AS score
        FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
        JOIN counts x ON x.lang = c.lang AND x.g = c.g[1:k]
        JOIN counts y ON y.lang = c.lang AND y.g = c.g[k + 1:]
        JOIN totals t ON t.lang = c.lang
    ), least AS (
        SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM cuts
    ), inner_parts AS (
        SELECT lang, g[i:i + d - 1] AS g, max(f) AS longer
        FROM (SELECT lang, g, f, d, unnest(range(1, len(g) - d + 2)) AS i
              FROM (SELECT lang, g, f, unnest(range(2, len(g))) AS d FROM candidates))
        GROUP BY ALL
    ), left_over AS (
        SELECT s.*, array_to_string(s.g, ' ') AS phrase FROM least s LEFT JOIN inner_parts i ON i.lang = s.lang AND i.g = s.g
        WHERE place = 1 AND coalesce(100 * longer < 100 * a, true)
    ), ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM left_over
    )
    SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked WHERE rank <= 2000
    """
)
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query()
def op12_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose numbers of rows are at most one apart, equal texts together."""
    found = sharding.sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query(
    """
    WITH turns AS (
        SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), ids AS (
        SELECT DISTINCT conv_id FROM turns
    ), crc AS (
        SELECT conv_id, xor(4294967295, list_reduce(
            list_concat([4294967295::BIGINT], flatten([[ord(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1] FOR ch IN string_split(conv_id::VARCHAR, '')])),
            lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS c
        FROM ids
    ), convs AS (
        SELECT conv_id, c % 6 AS h, conv_id - conv_id % 100 AS base FROM crc
    ), parts AS (
        SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.base WHERE pos < h
        UNION ALL
        SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id WHERE pos >= h
    ), steps AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM parts
    ), paths AS (
        SELECT conv_id, depth, len(text) AS chars, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM steps
        UNION ALL
        SELECT conv_id, 0, 0, [] FROM convs
    ), nodes AS (
        SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM paths GROUP BY depth, path
    ), children AS (
        SELECT path[:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
    ), counted AS (
        SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.path = n.path
    ), sums AS (
        SELECT path[:d] AS path, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens
        FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted) GROUP BY 1
    ), ends AS (
        SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha
        FROM (SELECT conv_id, arg_max(path, depth) AS path FROM paths GROUP BY conv_id) GROUP BY path
    )
    SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, n.n_children::BIGINT AS n_children,
           s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
    FROM counted n JOIN sums s ON s.path = n.path LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[:n.depth - 1] LEFT JOIN ends e ON e.path = n.path
    """
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the beginnings of all conversations."""
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))
