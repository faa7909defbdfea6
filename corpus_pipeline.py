"""A training corpus from raw documents: each stage applies one operator of ``polyglint.llm`` to all rows that the
stages before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglint.llm import decontamination, jaccard, lineruns, mixing, toxicity
from polyglint.llm.queries import curriculum_plan, table
from polyglint.llm.storage import saved


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold."""
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.without_toxic(docs, model)


def without_line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines, and the single lines of LONE_WORDS words or more, that stand earlier; n_chars
    follows the text. No row goes."""
    kept = lineruns.without_repeated_runs(docs, lone_words=lineruns.LONE_WORDS)
    length = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.select(*[length.alias(c) if c == "n_chars" else c for c in docs.columns])


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents, the one with the smallest doc_id."""
    dropped = jaccard.similar_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(saved(dropped), "doc_id", "left_anti").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row per use of a document, range-sorted by position."""
    sized = docs.select("doc_id", "source", mixing.words_in(F.col("text")).alias("size"))
    return mixing.curriculum(sized, curriculum_plan(sized)).select("doc_id", "source", "size", "epoch", "take", "position")


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", without_line_runs),
    ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mixed),
]

#: CRF scoring and edit distances are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; every stage but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
