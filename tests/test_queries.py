"""Every registered query against its DuckDB twin, and the shape of the plans."""

import datetime as dt
import math
import os
import re
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
# The training-text operators have their own tests, and need not be there.
OWN = re.compile(r"(?!op\d+_|pipeline$)")
QUERIES, ORACLE = ({name: q for name, q in found().items() if OWN.match(name)}
                   for found in (entry_points.queries, entry_points.oracle_sql))
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else repr(float(value))
    if isinstance(value, dt.datetime):
        return value.date().isoformat()
    return None if value is None else str(value)


def table(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE) and len(QUERIES) > 70


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    plan = physical(frame)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "InPandas", "ArrowEval"):
        assert unwanted not in plan
    twin = duck.sql(ORACLE[name])
    assert {c: TYPES[t] for c, t in frame.dtypes} == dict(zip(twin.columns, map(str, twin.types)))
    assert table(frame.columns, frame.collect()) == table(twin.columns, twin.fetchall())


@pytest.mark.parametrize("name", ["top3_products_per_category", "ablation_subsets"])
def test_rankings_are_cut_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in physical(QUERIES[name](spark, SF_DIR))


def test_scans_read_only_what_they_need(spark):
    plan = physical(QUERIES["repeat_customers_by_segment"](spark, SF_DIR))
    assert "ReadSchema: struct<o_orderkey" not in plan and "o_totalprice" not in plan
    plan = physical(QUERIES["quota_gap"](spark, SF_DIR))
    assert "text" not in plan.split("ReadSchema")[1]


def without_broadcast(spark, run):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return run()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["net_revenue_by_main_category", "contribution_margin_by_channel", "accuracy_all_axes",
                                  "sft_violations", "generation_records"])
def test_same_result_when_nothing_fits_a_broadcast(spark, duck, name):
    frame = QUERIES[name](spark, SF_DIR)
    data = without_broadcast(spark, frame.collect)
    twin = duck.sql(ORACLE[name])
    assert table(frame.columns, data) == table(twin.columns, twin.fetchall())


def test_aqe_splits_a_hot_order(spark):
    """A fact join whose key holds most rows is split by AQE and stays right."""
    from pyspark.sql import functions as F

    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    lines = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("order_id"), F.col("id").alias("v"))
    orders = spark.range(60000).select(F.col("id").alias("order_id"), (F.col("id") % 3).alias("g"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = lines.join(orders, "order_id").groupBy("g").agg(F.sum("v").alias("s"))
        got = {r.g: r.s for r in out.collect()}
        assert "skew=true" in physical(out)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = {}
    for i in range(60000):
        g = (7 if i % 2 == 0 else i) % 3
        want[g] = want.get(g, 0) + i
    assert got == want


@pytest.mark.parametrize("name, scans, reused", [
    ("sft_violations", 4, 1), ("leakage_hits", 3, 1), ("known_batch_duplicates", 6, 1), ("final_silver", 7, 0),
    ("dataset_version_diff", 5, 0), ("slots_to_regenerate", 4, 0)])
def test_inputs_are_read_no_more_often_than_needed(spark, name, scans, reused):
    frame = QUERIES[name](spark, SF_DIR)
    frame.collect()
    final = physical(frame).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") <= scans and final.count("ReusedExchange") >= reused
