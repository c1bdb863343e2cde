"""Registered queries against their SQL twins, and what the plans must not hold."""

import os

import duckdb
import pytest

from corpus_pipeline import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")
TABLES = "documents embeddings pages benchmark labels conversations".split()


def test_each_operator_has_one_query():
    assert sorted(n.split("_")[0] for n in QUERIES if n != "pipeline") == sorted(f"op{i}" for i in range(1, 14))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_twin(spark, name):
    run, sql = QUERIES[name]
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    twin = con.sql(sql)
    got = run(spark, SF_DIR)
    order = sorted(got.columns)
    assert order == sorted(twin.columns)
    at = [twin.columns.index(c) for c in order]
    assert sorted(repr([r[c] for c in order]) for r in got.collect()) == sorted(
        repr([r[i] for i in at]) for r in twin.fetchall())


@pytest.mark.parametrize("name", ["op3_chat_format", "op10_url_rules"])
def test_native_plans(spark, name):
    plan = QUERIES[name][0](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert unwanted not in plan
