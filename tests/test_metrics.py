import datetime as dt
from dataclasses import replace
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from querykiln.plans import calendar
from querykiln.plans import metrics as M
from querykiln.schemas import WAREHOUSE
from querykiln.sources.warehouse import Warehouse, open_bucketed, save_bucketed


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture
def wh(spark):
    make = lambda name, data: spark.createDataFrame(data, WAREHOUSE[name].replace(" not null", ""))
    line = lambda i, o, p, q, price, disc, tax: (i, o, p, q, D(price), D(disc), D(tax))
    return Warehouse(
        categories=make("categories", [(1, "Top", None), (2, "Leaf A", 1), (3, "Leaf B", 1), (4, "Lone", None)]),
        products=make("products", [(1, "S1", "Pen", 2, D("12"), D("5"), day("2024-01-01"), None),
                                   (2, "S2", "Cup", 3, D("9"), D("4"), day("2024-01-01"), day("2025-01-01"))]),
        customers=make("customers", [
            (1, "C1", day("2024-01-01"), "DE", None, "private", True, None),
            (2, "C2", day("2024-01-01"), "AT", None, "private", True, dt.datetime(2025, 1, 1)),
            (3, "C3", day("2024-01-01"), "CH", None, "business", False, None)]),
        channels=make("channels", [(1, "webshop", "direct", D("0")), (2, "marketplace_a", "partner", D("0.15"))]),
        orders=make("orders", [
            (1, 1, 1, day("2026-04-01"), None, "placed", D("5"), "card"),
            (2, 1, 2, day("2026-06-30"), None, "delivered", D("5"), "card"),
            (3, 2, 1, day("2026-06-01"), None, "delivered", D("5"), "card"),
            (4, 3, 1, day("2026-06-10"), None, "cancelled", D("5"), "card"),
            (5, 3, 1, day("2026-03-31"), None, "placed", D("5"), "card")]),
        order_items=make("order_items", [
            line(1, 1, 1, 2, "11.90", "0", "0.19"), line(2, 1, 2, 1, "10.70", "0", "0.07"),
            line(3, 2, 1, 1, "13.90", "2", "0.19"), line(4, 4, 1, 9, "99", "0", "0.19"), line(5, 5, 2, 3, "10.70", "0", "0.07")]),
        returns=make("returns", [
            (1, 1, day("2026-05-01"), 1, "defect", D("11.90")), (2, 1, day("2026-05-02"), 1, "no_reason", D("10")),
            (3, 5, day("2026-05-02"), 1, "defect", D("10.70"))]),
    )


def test_net_revenue(wh, rows):
    assert rows(M.net_revenue_by_month(wh)) == [
        ("2026-03", 30.0), ("2026-04", 30.0), ("2026-06", 10.0)]
    assert rows(M.net_revenue_by_main_category(wh)) == [("Top", 70.0)]
    assert rows(M.net_revenue_after_returns(wh)) == [
        ("2026-03", 30.0, 10.7, 19.3), ("2026-04", 30.0, 21.9, 8.1), ("2026-06", 10.0, 0.0, 10.0)]


def test_several_returns_do_not_multiply_lines(wh, rows):
    naive = wh.order_items.join(wh.returns, "order_item_id", "left").count()
    assert naive == wh.order_items.count() + 1
    assert rows(M.return_extent(wh)) == [("full", 1, 2), ("none", 3, 0), ("partial", 1, 1)]


def test_margin(wh, rows):
    assert rows(M.contribution_margin_by_channel(wh)) == [
        ("marketplace_a", 10.0, 5.0, 1.79, 3.22), ("webshop", 60.0, 26.0, 0.0, 34.0)]
    assert rows(M.contribution_margin_by_channel(wh, "list"))[0] == ("marketplace_a", 10.0, 5.0, 2.09, 2.92)


def test_customers(wh, rows):
    # Day 91 back (March 31) is outside, April 1 is the first day inside; C2 is deleted, C3 cancelled.
    assert rows(M.active_customers(wh).select("customer_number")) == [("C1",)]
    assert rows(M.active_customers_by_segment(wh, "2026-06-29")) == [("business", 1), ("private", 1)]
    assert rows(M.customers_total(wh)) == [("business", 1, 1, 0), ("private", 2, 1, 1)]
    assert rows(M.repeat_customers(M.sold_orders(wh))) == [(1,)]
    spring, summer = ("2026-03-01", "2026-04-30"), ("2026-05-01", "2026-06-30")
    assert rows(M.customers_both_periods(wh, spring, summer)) == [("C1",)]
    assert rows(M.customers_lost(wh, spring, summer)) == [("C3",)]
    assert rows(M.customers_either_period(wh, spring, summer)) == [("C1",), ("C2",), ("C3",)]
    assert rows(M.customers_without_orders(wh, "2026-06-01", "2026-06-30")) == []
    assert rows(M.customers_without_orders(wh, "2026-04-01", "2026-04-30")) == [("C2",), ("C3",)]


def test_orders_and_returns(wh, rows):
    assert rows(M.order_count_vs_quantity_sold(wh)) == [("marketplace_a", 1, 1, 1), ("webshop", 4, 3, 6)]
    assert rows(M.return_rate_by_reason(wh)) == [("defect", 2, 2, 22.6, 0.285714), ("no_reason", 1, 1, 10.0, 0.142857)]
    assert rows(M.refunds_by_segment(wh)) == [("business", 1, 10.7), ("private", 1, 21.9)]
    assert rows(M.orders_without_returns(wh)) == [("marketplace_a", 1), ("webshop", 1)]
    assert rows(M.null_state_counts(wh)) == [
        ("existing_account", 2, 3), ("main_category", 2, 4), ("product_in_assortment", 1, 2), ("unshipped_order", 5, 5)]
    assert rows(M.price_realisation(wh)) == [("Top", 80.5, 72.0, 1.118056)]


def test_rankings(wh, rows):
    assert [tuple(r) for r in M.top_products(wh, 1).collect()] == [("Cup", 2, 40.0)]
    assert rows(M.top_products_per_category(wh, 1)) == [("Leaf A", 1, "Pen", 1, 30.0), ("Leaf B", 1, "Cup", 2, 40.0)]
    assert rows(M.category_revenue_share(wh)) == [("Top", "Leaf A", 30.0, 0.428571), ("Top", "Leaf B", 40.0, 0.571429)]
    # Lone is childless, so it is a leaf of zero revenue: the benchmark is 70 / 3.
    assert rows(M.leaf_categories_above_average(wh)) == [("Leaf A", 30.0), ("Leaf B", 40.0)]


def test_windows(wh, rows):
    assert rows(M.running_revenue(wh).select("running_revenue")) == [(30.0,), (60.0,), (70.0,)]
    assert rows(M.revenue_month_over_month(wh).select("month", "change")) == [
        ("2026-03", None), ("2026-04", 0.0), ("2026-05", -30.0), ("2026-06", 10.0)]  # nothing was sold in May
    assert rows(M.revenue_moving_avg(wh, 2).select("month", "moving_avg")) == [
        ("2026-03", 30.0), ("2026-04", 30.0), ("2026-05", 15.0), ("2026-06", 5.0)]


def test_results_do_not_depend_on_partitioning(wh, rows):
    spread = Warehouse(**{k: v.repartition(5) for k, v in wh.__dict__.items() if v is not None})
    for metric in (M.net_revenue_by_month, M.contribution_margin_by_channel, M.refunds_by_segment):
        assert rows(metric(spread)) == rows(metric(wh))


def test_bucketed_fact_join_has_no_exchange(spark, wh, rows, tmp_path):
    save_bucketed(wh, str(tmp_path), 4)
    stored = open_bucketed(spark, wh)
    assert rows(M.net_revenue_by_month(stored)) == rows(M.net_revenue_by_month(wh))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = M.rate_sums(stored, {})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for name in ("orders", "order_items", "products"):
            spark.sql(f"DROP TABLE {name}")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1  # the aggregation's own


def test_filters_and_columns_reach_the_scan(spark, wh, tmp_path):
    wh.orders.write.parquet(str(tmp_path / "orders"))
    stored = replace(wh, orders=spark.read.parquet(str(tmp_path / "orders")))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    scan = [line for line in M.active_customers(stored)._jdf.queryExecution().executedPlan().toString().splitlines()
            if "FileScan" in line][0]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = scan.split("PushedFilters: ")[1]
    assert "Not(EqualTo(order_status" in pushed and "GreaterThanOrEqual(order_date" in pushed
    assert scan.split("ReadSchema: ")[1] == "struct<customer_id:bigint,order_date:date,order_status:string>"


def test_category_trees_of_any_depth(spark, wh, rows):
    two = M.main_categories(wh.categories)
    assert rows(M.category_roots(wh.categories).drop("problem")) == rows(two)
    deep = wh.categories.union(spark.createDataFrame([(9, "Deep", 2)], wh.categories.schema))
    roots = {r.category_name: r.main_category for r in M.category_roots(deep).collect()}
    assert roots["Deep"] == "Top"


def test_long_paths_cycles_and_orphans(spark, wh):
    chain = [(i, f"c{i}", i - 1 if i else None) for i in range(5000)]
    odd = [(6001, "x", 6002), (6002, "y", 6003), (6003, "z", 6004), (6004, "w", 6001), (6005, "below", 6003), (6006, "self", 6006),
           (7001, "lost", 7999), (7002, "below lost", 7001)]
    tree = spark.createDataFrame(chain + odd, "category_id bigint, category_name string, parent_category_id bigint")
    roots = M.category_roots(tree)
    found = {r.category_id: (r.main_category, r.problem) for r in roots.collect()}
    assert len(found) == len(chain + odd) and {found[i] for i in range(5000)} == {("c0", None)}
    assert {found[i] for i in (7001, 7002)} == {("lost", "orphan")}
    assert [found[i] for i in range(6001, 6007)] == [(n, "cycle") for n in ("x", "y", "z", "w", "below", "self")]
    products = spark.createDataFrame([(i, c) for i, c in enumerate([4999, 6001, 7002, 12345])], "product_id bigint, category_id bigint")
    shop = replace(wh, products=products.withColumn("discontinued_on", F.lit(None).cast("date")))
    counted = {r.main_category: r.products for r in M.products_per_main_category(shop, roots).collect()}
    assert counted == {"c0": 1, "x": 1, "lost": 1, None: 1}


def test_months_without_sales_are_there(spark):
    monthly = spark.createDataFrame([("a", day("2024-11-01"), 4.0), ("a", day("2025-02-01"), 2.0), ("b", day("2025-01-01"), 1.0)],
                                    "g string, month date, net_revenue double")
    got = [(r.g, r.month.isoformat()[:7], r.net_revenue) for r in M.every_month(monthly, ["g"]).orderBy("g", "month").collect()]
    assert got == [("a", "2024-11", 4.0), ("a", "2024-12", 0.0), ("a", "2025-01", 0.0), ("a", "2025-02", 2.0), ("b", "2025-01", 1.0)]
    assert M.every_month(monthly.where("g = 'none'"), []).count() == 0


def test_calendar(spark):
    span = spark.sql("SELECT DATE'2024-12-30' AS first_day, DATE'2026-12-31' AS last_day")
    days = {r.date_key: r for r in calendar.dim_date(span).collect()}
    assert len(days) == 732
    first = days[day("2024-12-30")]
    assert (first.iso_week, first.day_of_week, first.quarter, first.is_weekend) == (1, 1, 4, False)
    holidays = sorted(d.isoformat() for d, r in days.items() if r.is_public_holiday and d.year == 2026)
    assert holidays == ["2026-01-01", "2026-04-03", "2026-04-06", "2026-05-01", "2026-05-14", "2026-05-25",
                        "2026-10-03", "2026-12-25", "2026-12-26"]


def test_easter(spark):
    known = {1961: "04-02", 1995: "04-16", 2000: "04-23", 2008: "03-23", 2011: "04-24", 2038: "04-25", 2049: "04-18"}
    got = spark.createDataFrame([(y,) for y in known], "y int").select("y", calendar.easter_sunday(F.col("y")).alias("e"))
    assert {r.y: r.e.isoformat()[5:] for r in got.collect()} == known
