"""Where registered queries gather: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from workload import oracle
from workload import relations as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle_body: str | None = None):
    """Register a query function; its oracle body may use the derived relations."""

    def add(fn):
        QUERIES[name] = fn
        if oracle_body is not None:
            ORACLES[name] = oracle.sql(oracle_body)
        return fn

    return add


def _literal(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def vectors(name: str, expression, table: list[tuple[str, str | None]]):
    """Register a function over order-derived texts: every order takes one of the shapes and
    writes its own number into it (``{id}``), on both sides."""
    n = len(table)

    def run(spark, sf_dir):
        shapes = F.array(*[F.lit(shape) for shape, _ in table])
        o = W.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"),
            F.replace(F.element_at(shapes, (F.col("o_orderkey") % n + 1).cast("int")), F.lit("{id}"), F.col("o_orderkey").cast("string")).alias("text"),
        )
        return o.select("id", "text", expression(F.col("text")).cast("string").alias("result"))

    def pick(i: int) -> str:
        whens = " ".join(f"WHEN {j} THEN {_literal(row[i])}" for j, row in enumerate(table))
        return f"replace(CASE o_orderkey % {n} {whens} END, '{{id}}', o_orderkey::VARCHAR)"

    QUERIES[name] = run
    ORACLES[name] = f"SELECT o_orderkey AS id, {pick(0)} AS text, {pick(1)} AS result FROM orders"
