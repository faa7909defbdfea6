"""Registered queries on the smallest tables, against their SQL where they have one."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from polyglint.llm import queries


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, sql, name):
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    want = sql.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in columns:
        assert (got[c] == want[c]).all(), c


def test_all_are_registered():
    names = entry.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.schema.names == docs.schema.names
        after = after.cache()
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}, name
        assert len(ids) > 0.5 * before.count()
        before = after
    result = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in result} <= ids
    # by source, words come to the targets of what was kept, and positions go up
    assert all(0 <= r.position <= 1 and 0 < r.take <= r.size for r in result)
    assert [r.position for r in result] == sorted(r.position for r in result)
