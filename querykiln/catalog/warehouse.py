"""Queries over the e-commerce warehouse, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.fixtures import views as V
from querykiln.fixtures.oracle_views import money8, net8, with_views
from querykiln.operators.validation import conformance
from querykiln.plans import metrics as M
from querykiln.schemas import WAREHOUSE_ENUMS

_YEAR = "DATE '2000-07-01' AND DATE '2001-06-30'"
_HALF1 = "DATE '2000-07-01' AND DATE '2000-12-31'"
_HALF2 = "DATE '2001-01-01' AND DATE '2001-06-30'"


def _wh(metric, *args, **kwargs):
    return lambda spark, sf_dir: metric(V.warehouse(spark, sf_dir), *args, **kwargs)


def _net_by(key: str, source: str, where: str = "NOT is_cancelled") -> str:
    """CTE text: exact net value in 1e-8 units per key."""
    return f"""
        SELECT {key}, SUM({net8('g', 'tax')}) AS n8
        FROM (SELECT {key}, tax, SUM(gross4) AS g FROM {source} WHERE {where} GROUP BY {key}, tax)
        GROUP BY {key}"""


_MONTHLY = f"monthly AS (SELECT strftime(month, '%Y-%m') AS month, {money8('n8')} AS net_revenue FROM ({_net_by('month', 'fx_lines')}))"
_CUSTOMER_MONTHS = f"""
    net AS ({_net_by('customer_id, month', 'fx_lines')}),
    span AS (SELECT customer_id, min(month) AS a, max(month) AS b FROM net GROUP BY customer_id),
    months AS (SELECT customer_id, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS month FROM span),
    dense AS (SELECT customer_id, month, coalesce({money8('n8')}, 0.0) AS net_revenue
              FROM months LEFT JOIN net USING (customer_id, month))"""
_CATEGORY = "sold AS (SELECT * FROM fx_lines JOIN fx_products USING (product_id))"
_PRODUCT = f"""net AS ({_net_by('product_id', 'fx_lines')}),
    named AS (SELECT * FROM net JOIN fx_products USING (product_id))"""

# Easter Sundays of the years of the test data, as an independent check of the rule in Spark.
_EASTER = """(VALUES (1995, DATE '1995-04-16'), (1996, DATE '1996-04-07'), (1997, DATE '1997-03-30'),
    (1998, DATE '1998-04-12'), (1999, DATE '1999-04-04'), (2000, DATE '2000-04-23'),
    (2001, DATE '2001-04-15')) e(y, easter)"""
_DAYS = f"""
    span AS (SELECT min(order_date) AS a, max(order_date) AS b FROM fx_orders),
    day AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date_key FROM span),
    dim AS (
        SELECT date_key, isodow(date_key) >= 6 AS is_weekend,
               strftime(date_key, '%m-%d') IN ('01-01', '05-01', '10-03', '12-25', '12-26')
               OR (date_key - easter) IN (-2, 1, 39, 50) AS is_public_holiday
        FROM day JOIN {_EASTER} ON year(date_key) = y)"""


def dim_date(spark, sf_dir: str) -> DataFrame:
    return V.warehouse(spark, sf_dir).dim_date


def products_per_main_category(spark, sf_dir: str) -> DataFrame:
    """The roll-up of a tree of any depth, over all products."""
    wh = V.warehouse(spark, sf_dir)
    return M.products_per_main_category(wh, M.category_roots(wh.categories))


def deep_category_roots(spark, sf_dir: str) -> DataFrame:
    """Main categories of a tree of long chains: each part below the one before it, some below none or a missing one."""
    chains = V.table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS category_id", "concat('C', p_partkey) AS category_name",
        "CASE WHEN p_size = 1 THEN NULL WHEN p_brand = 'Brand#11' THEN -p_partkey ELSE p_partkey - 1 END AS parent_category_id")
    return M.category_roots(chains)


def customer_months(metric):
    """Monthly windows per customer: most customers have months without an order."""
    return lambda spark, sf_dir: metric(V.warehouse(spark, sf_dir), dims={"customer_id": F.col("customer_id")})


def warehouse_conformance(spark, sf_dir: str) -> DataFrame:
    """NOT NULL and enumeration checks; the enumerations here are the reference ones, so the
    segments and channel names of the test data show up as outside."""
    wh = V.warehouse(spark, sf_dir)
    return (
        conformance(wh.orders, "orders", ["order_id", "customer_id", "order_date", "order_status"],
                    WAREHOUSE_ENUMS["orders"])
        .unionByName(conformance(wh.customers, "customers", ["customer_id", "segment", "deleted_at"],
                                 WAREHOUSE_ENUMS["customers"]))
        .unionByName(conformance(wh.order_items, "order_items", ["order_id", "product_id", "quantity"],
                                 WAREHOUSE_ENUMS["order_items"]))
        .unionByName(conformance(wh.returns, "returns", ["order_item_id", "quantity_returned"],
                                 WAREHOUSE_ENUMS["returns"]))
    )


QUERIES = {
    "net_revenue_by_main_category": (_wh(M.net_revenue_by_main_category), with_views(f"""
        WITH {_CATEGORY}, named AS (SELECT * FROM sold JOIN fx_tree USING (category_id))
        SELECT main_category, {money8('n8')} AS net_revenue FROM ({_net_by('main_category', 'named')})""",
        "fx_lines", "fx_products", "fx_tree")),
    "net_revenue_by_month": (_wh(M.net_revenue_by_month), with_views(
        f"WITH {_MONTHLY} SELECT month, net_revenue FROM monthly", "fx_lines")),
    "net_revenue_by_ship_month": (_wh(M.net_revenue_by_month, "ship_date"), with_views(f"""
        WITH shipped AS (
            SELECT l.* EXCLUDE (month), CAST(date_trunc('month', o.order_date + 3) AS DATE) AS month
            FROM fx_lines l JOIN fx_orders o ON o.order_id = l.order_id WHERE NOT o.unshipped)
        SELECT strftime(month, '%Y-%m') AS month, {money8('n8')} AS net_revenue FROM ({_net_by('month', 'shipped')})""",
        "fx_lines", "fx_orders")),
    "net_revenue_after_returns": (_wh(M.net_revenue_after_returns), with_views(f"""
        WITH net AS ({_net_by('month', 'fx_lines')}),
        refunds AS (
            SELECT month, SUM(CAST(coalesce(refund_cents, 0) AS HUGEINT)) * 1000000 AS r8
            FROM fx_lines LEFT JOIN fx_item_returns USING (item) WHERE NOT is_cancelled GROUP BY month)
        SELECT strftime(month, '%Y-%m') AS month, {money8('n8')} AS net_revenue, {money8('r8')} AS refunds,
               {money8('(n8 - r8)')} AS net_after_returns
        FROM net JOIN refunds USING (month)""", "fx_lines", "fx_item_returns")),
    "revenue_by_day_type": (_wh(M.revenue_by_day_type), with_views(f"""
        WITH {_DAYS},
        kinds AS (SELECT date_key AS order_date, CASE WHEN is_public_holiday THEN 'holiday'
                         WHEN is_weekend THEN 'weekend' ELSE 'workday' END AS day_type FROM dim),
        typed AS (SELECT * FROM fx_lines JOIN kinds USING (order_date)),
        counted AS (SELECT day_type, count(*) AS days FROM kinds GROUP BY day_type)
        SELECT day_type, days, {money8('n8')} AS net_revenue
        FROM ({_net_by('day_type', 'typed')}) JOIN counted USING (day_type)""", "fx_lines")),
    "contribution_margin_by_channel": (_wh(M.contribution_margin_by_channel), with_views(f"""
        WITH net AS ({_net_by('channel_id', 'fx_lines')}),
        costs AS (
            SELECT channel_id, SUM(CAST(quantity * list_cents AS HUGEINT)) * 600000 AS c8,
                   SUM(CAST(gross4 AS HUGEINT)) * 1500 AS m8
            FROM fx_lines JOIN fx_products USING (product_id) WHERE NOT is_cancelled GROUP BY channel_id),
        parts AS (SELECT channel_name, n8, c8, CASE WHEN partner THEN m8 ELSE 0 END AS m8
                  FROM net JOIN costs USING (channel_id) JOIN fx_channels USING (channel_id))
        SELECT channel_name, {money8('n8')} AS net_revenue, {money8('c8')} AS purchase_cost,
               {money8('m8')} AS commission, {money8('(n8 - c8 - m8)')} AS margin
        FROM parts""", "fx_lines", "fx_products", "fx_channels")),
    "contribution_margin_list_commission": (_wh(M.contribution_margin_by_channel, "list"), with_views(f"""
        WITH net AS ({_net_by('channel_id', 'fx_lines')}),
        costs AS (
            SELECT channel_id, SUM(CAST(quantity * list_cents AS HUGEINT)) * 600000 AS c8,
                   SUM(CAST(quantity * unit_cents AS HUGEINT)) * 150000 AS m8
            FROM fx_lines JOIN fx_products USING (product_id) WHERE NOT is_cancelled GROUP BY channel_id),
        parts AS (SELECT channel_name, n8, c8, CASE WHEN partner THEN m8 ELSE 0 END AS m8
                  FROM net JOIN costs USING (channel_id) JOIN fx_channels USING (channel_id))
        SELECT channel_name, {money8('n8')} AS net_revenue, {money8('c8')} AS purchase_cost,
               {money8('m8')} AS commission, {money8('(n8 - c8 - m8)')} AS margin
        FROM parts""", "fx_lines", "fx_products", "fx_channels")),
    "revenue_last_90_days": (_wh(M.revenue_last_days, V.SNAPSHOT), with_views(f"""
        WITH recent AS (SELECT * FROM fx_lines
            WHERE order_date BETWEEN DATE '2001-06-30' - INTERVAL 90 DAY AND DATE '2001-06-30')
        SELECT channel_name, {money8('n8')} AS net_revenue
        FROM ({_net_by('channel_id', 'recent')}) JOIN fx_channels USING (channel_id)""",
        "fx_lines", "fx_channels")),
    "revenue_period_compare": (_wh(M.revenue_period_compare, V.FIRST_HALF, V.SECOND_HALF), with_views(f"""
        WITH {_CATEGORY}, one AS (SELECT * FROM sold WHERE order_date BETWEEN {_HALF1}),
        two AS (SELECT * FROM sold WHERE order_date BETWEEN {_HALF2}),
        a AS ({_net_by('category_id', 'one')}), b AS ({_net_by('category_id', 'two')}),
        pairs AS (SELECT category_id, coalesce(a.n8, 0) AS x, coalesce(b.n8, 0) AS y
                  FROM a FULL JOIN b USING (category_id))
        SELECT category_name, {money8('x')} AS first_period, {money8('y')} AS second_period,
               {money8('(y - x)')} AS change
        FROM pairs JOIN fx_categories USING (category_id)""", "fx_lines", "fx_products", "fx_categories")),
    "active_customers_by_segment": (_wh(M.active_customers_by_segment, V.SNAPSHOT), with_views("""
        SELECT segment, count(*) AS active_customers FROM fx_customers c
        WHERE NOT is_deleted AND EXISTS (
            SELECT 1 FROM fx_orders o WHERE o.customer_id = c.customer_id AND NOT is_cancelled
            AND order_date BETWEEN DATE '2001-06-30' - INTERVAL 90 DAY AND DATE '2001-06-30')
        GROUP BY segment""", "fx_customers", "fx_orders")),
    "customers_total": (_wh(M.customers_total), with_views("""
        SELECT segment, count(*) AS customers, count(*) FILTER (NOT is_deleted) AS existing,
               count(*) FILTER (is_deleted) AS deleted
        FROM fx_customers GROUP BY segment""", "fx_customers")),
    "repeat_customers_by_segment": (_wh(M.repeat_customers_by_segment, *V.YEAR), with_views(f"""
        SELECT segment, count(*) AS repeat_customers
        FROM fx_customers JOIN (
            SELECT customer_id FROM fx_orders WHERE NOT is_cancelled AND order_date BETWEEN {_YEAR}
            GROUP BY customer_id HAVING count(DISTINCT month) >= 2) USING (customer_id)
        GROUP BY segment""", "fx_customers", "fx_orders")),
    "customers_bought_both_periods": (_wh(M.customers_both_periods, V.FIRST_HALF, V.SECOND_HALF), with_views(f"""
        SELECT customer_number FROM fx_customers WHERE customer_id IN (
            SELECT customer_id FROM fx_orders WHERE NOT is_cancelled AND order_date BETWEEN {_HALF1}
            INTERSECT
            SELECT customer_id FROM fx_orders WHERE NOT is_cancelled AND order_date BETWEEN {_HALF2})""",
        "fx_customers", "fx_orders")),
    "customers_bought_lost": (_wh(M.customers_lost, V.FIRST_HALF, V.SECOND_HALF), with_views(f"""
        SELECT customer_number FROM fx_customers WHERE customer_id IN (
            SELECT customer_id FROM fx_orders WHERE NOT is_cancelled AND order_date BETWEEN {_HALF1}
            EXCEPT
            SELECT customer_id FROM fx_orders WHERE NOT is_cancelled AND order_date BETWEEN {_HALF2})""",
        "fx_customers", "fx_orders")),
    "customers_bought_either_period": (_wh(M.customers_either_period, V.FIRST_HALF, V.SECOND_HALF), with_views(f"""
        SELECT customer_number FROM fx_customers WHERE customer_id IN (
            SELECT customer_id FROM fx_orders WHERE NOT is_cancelled
            AND (order_date BETWEEN {_HALF1} OR order_date BETWEEN {_HALF2}))""",
        "fx_customers", "fx_orders")),
    "customers_without_orders": (_wh(M.customers_without_orders, *V.SECOND_HALF), with_views(f"""
        SELECT customer_number FROM fx_customers WHERE customer_id NOT IN (
            SELECT customer_id FROM fx_orders WHERE order_date BETWEEN {_HALF2})""",
        "fx_customers", "fx_orders")),
    "order_count_vs_quantity_sold": (_wh(M.order_count_vs_quantity_sold), with_views("""
        WITH placed AS (SELECT channel_id, count(*) AS placed_orders,
                               count(*) FILTER (NOT is_cancelled) AS sold_orders
                        FROM fx_orders GROUP BY channel_id),
        sold AS (SELECT channel_id, CAST(sum(quantity) AS BIGINT) AS quantity_sold FROM fx_lines
                 WHERE NOT is_cancelled GROUP BY channel_id)
        SELECT channel_name, placed_orders, sold_orders, coalesce(quantity_sold, 0) AS quantity_sold
        FROM placed LEFT JOIN sold USING (channel_id) JOIN fx_channels USING (channel_id)""",
        "fx_lines", "fx_channels")),
    "return_rate_by_reason": (_wh(M.return_rate_by_reason), with_views(f"""
        WITH sold AS (SELECT sum(quantity) AS q FROM fx_lines WHERE NOT is_cancelled),
        back AS (SELECT ['defect', 'wrong_size', 'not_as_described', 'no_reason'][reason + 1] AS reason_code,
                        count(*) AS returns, CAST(sum(pieces) AS BIGINT) AS quantity_returned,
                        sum(refund_cents) AS cents
                 FROM fx_returns JOIN fx_orders USING (order_id) WHERE NOT is_cancelled GROUP BY 1)
        SELECT reason_code, returns, quantity_returned, CAST(cents AS DOUBLE) / 100 AS refund_amount,
               round(CAST(quantity_returned AS DOUBLE) / CAST(q AS DOUBLE), 6) AS return_rate
        FROM back, sold""", "fx_lines", "fx_returns")),
    "return_extent": (_wh(M.return_extent), with_views("""
        SELECT CASE WHEN r.pieces IS NULL THEN 'none' WHEN r.pieces < quantity THEN 'partial'
                    ELSE 'full' END AS extent,
               count(*) AS lines, CAST(sum(coalesce(r.pieces, 0)) AS BIGINT) AS quantity_returned
        FROM fx_items LEFT JOIN fx_item_returns r USING (item) GROUP BY 1""",
        "fx_items", "fx_item_returns")),
    "refunds_by_return_month": (_wh(M.refunds_by_return_month), with_views("""
        SELECT strftime(CAST(item.e AS DATE) + 14, '%Y-%m') AS month, count(*) AS returns,
               CAST(sum(pieces) AS BIGINT) AS quantity_returned, CAST(sum(refund_cents) AS DOUBLE) / 100 AS refunds
        FROM fx_returns JOIN fx_orders USING (order_id) WHERE NOT is_cancelled
        GROUP BY 1""", "fx_returns", "fx_orders")),
    "refunds_returned_first_half": (_wh(M.refunds_by_return_month, *V.FIRST_HALF), with_views(f"""
        SELECT strftime(CAST(item.e AS DATE) + 14, '%Y-%m') AS month, count(*) AS returns,
               CAST(sum(pieces) AS BIGINT) AS quantity_returned, CAST(sum(refund_cents) AS DOUBLE) / 100 AS refunds
        FROM fx_returns JOIN fx_orders USING (order_id) WHERE NOT is_cancelled
          AND CAST(item.e AS DATE) + 14 BETWEEN DATE '{V.FIRST_HALF[0]}' AND DATE '{V.FIRST_HALF[1]}'
        GROUP BY 1""", "fx_returns", "fx_orders")),
    "refunds_by_segment": (_wh(M.refunds_by_segment), with_views("""
        SELECT segment, count(*) AS returned_lines, CAST(sum(refund_cents) AS DOUBLE) / 100 AS refunds
        FROM fx_item_returns JOIN fx_items USING (item) JOIN fx_orders USING (order_id)
             JOIN fx_customers USING (customer_id)
        GROUP BY segment""", "fx_item_returns", "fx_orders", "fx_customers")),
    "null_state_counts": (_wh(M.null_state_counts), with_views("""
        SELECT 'unshipped_order' AS state, count(*) FILTER (unshipped) AS in_state, count(*) AS all_rows
        FROM fx_orders
        UNION ALL SELECT 'product_in_assortment', count(*) FILTER (NOT discontinued), count(*) FROM fx_products
        UNION ALL SELECT 'existing_account', count(*) FILTER (NOT is_deleted), count(*) FROM fx_customers
        UNION ALL SELECT 'main_category', count(*) FILTER (parent_category_id IS NULL), count(*)
        FROM fx_categories""", "fx_orders", "fx_products", "fx_customers", "fx_categories")),
    "price_realisation": (_wh(M.price_realisation), with_views("""
        WITH sums AS (
            SELECT main_category, sum(CAST(quantity * unit_cents AS HUGEINT)) AS charged,
                   sum(CAST(quantity * list_cents AS HUGEINT)) AS listed
            FROM fx_lines JOIN fx_products USING (product_id) JOIN fx_tree USING (category_id)
            WHERE NOT is_cancelled GROUP BY main_category)
        SELECT main_category, CAST(charged AS DOUBLE) / 100 AS charged_value,
               CAST(listed AS DOUBLE) / 100 AS list_value,
               round(CAST(charged AS DOUBLE) / CAST(listed AS DOUBLE), 6) AS realisation
        FROM sums""", "fx_lines", "fx_products", "fx_tree")),
    "orders_without_returns": (_wh(M.orders_without_returns), with_views("""
        SELECT channel_name, count(*) AS orders FROM fx_orders JOIN fx_channels USING (channel_id)
        WHERE NOT is_cancelled AND order_id NOT IN (SELECT order_id FROM fx_returns)
        GROUP BY channel_name""", "fx_orders", "fx_channels", "fx_returns")),
    "products_per_main_category": (products_per_main_category, with_views("""
        SELECT main_category, count(*) AS products, count(*) FILTER (NOT discontinued) AS in_assortment
        FROM fx_products JOIN fx_tree USING (category_id) GROUP BY main_category""", "fx_products", "fx_tree")),
    "top_products_by_revenue": (_wh(M.top_products), with_views(f"""
        WITH {_PRODUCT}
        SELECT product_name, product_id, {money8('n8')} AS net_revenue
        FROM (SELECT * FROM named ORDER BY n8 DESC, product_name, product_id LIMIT 10)""",
        "fx_lines", "fx_products")),
    "top3_products_per_category": (_wh(M.top_products_per_category), with_views(f"""
        WITH {_PRODUCT},
        ranked AS (SELECT *, row_number() OVER (PARTITION BY category_id
                          ORDER BY n8 DESC, product_name, product_id) AS rank FROM named)
        SELECT category_name, rank, product_name, product_id, {money8('n8')} AS net_revenue
        FROM ranked JOIN fx_categories USING (category_id) WHERE rank <= 3""",
        "fx_lines", "fx_products", "fx_categories")),
    "revenue_month_over_month": (_wh(M.revenue_month_over_month), with_views(f"""
        WITH {_MONTHLY},
        lagged AS (SELECT month, net_revenue, lag(net_revenue) OVER (ORDER BY month) AS previous FROM monthly)
        SELECT month, net_revenue, previous, round(net_revenue - previous, 2) AS change,
               round((net_revenue - previous) / previous, 6) AS change_rate
        FROM lagged""", "fx_lines")),
    "customer_month_over_month": (customer_months(M.revenue_month_over_month), with_views(f"""
        WITH {_CUSTOMER_MONTHS},
        lagged AS (SELECT *, lag(net_revenue) OVER (PARTITION BY customer_id ORDER BY month) AS previous FROM dense)
        SELECT customer_id, strftime(month, '%Y-%m') AS month, net_revenue, previous,
               round(net_revenue - previous, 2) AS change,
               round((net_revenue - previous) / nullif(previous, 0), 6) AS change_rate
        FROM lagged""", "fx_lines")),
    "customer_moving_avg": (customer_months(M.revenue_moving_avg), with_views(f"""
        WITH {_CUSTOMER_MONTHS}
        SELECT customer_id, strftime(month, '%Y-%m') AS month, net_revenue, round(avg(net_revenue) OVER (
            PARTITION BY customer_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg
        FROM dense""", "fx_lines")),
    "deep_category_roots": (deep_category_roots, """
        WITH tops AS (
            SELECT p_partkey AS id, p_size = 1 AS main, p_size <> 1 AND (p_brand = 'Brand#11' OR NOT EXISTS (
                       SELECT 1 FROM part q WHERE q.p_partkey = p.p_partkey - 1)) AS orphan FROM part p),
        named AS (
            SELECT id, max(CASE WHEN main OR orphan THEN id END) OVER (ORDER BY id) AS root FROM tops)
        SELECT n.id AS category_id, 'C' || n.id AS category_name, 'C' || n.root AS main_category,
               CASE WHEN t.orphan THEN 'orphan' END AS problem
        FROM named n JOIN tops t ON t.id = n.root"""),
    "running_revenue": (_wh(M.running_revenue), with_views(f"""
        WITH {_MONTHLY}
        SELECT month, net_revenue, round(sum(net_revenue) OVER (ORDER BY month), 2) AS running_revenue
        FROM monthly""", "fx_lines")),
    "revenue_moving_avg": (_wh(M.revenue_moving_avg), with_views(f"""
        WITH {_MONTHLY}
        SELECT month, net_revenue, round(avg(net_revenue) OVER (
            ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving_avg
        FROM monthly""", "fx_lines")),
    "category_revenue_share": (_wh(M.category_revenue_share), with_views(f"""
        WITH {_CATEGORY}, net AS ({_net_by('category_id', 'sold')})
        SELECT main_category, category_name, {money8('n8')} AS net_revenue,
               round(CAST(n8 AS DOUBLE) / CAST(sum(n8) OVER (PARTITION BY main_category) AS DOUBLE), 6) AS share
        FROM net JOIN fx_tree USING (category_id)""", "fx_lines", "fx_products", "fx_tree")),
    "leaf_categories_above_average": (_wh(M.leaf_categories_above_average), with_views(f"""
        WITH {_CATEGORY}, net AS ({_net_by('category_id', 'sold')}),
        leaves AS (SELECT category_name, coalesce(n8, 0) AS n8 FROM fx_categories c LEFT JOIN net USING (category_id)
                   WHERE c.category_id NOT IN (SELECT parent_category_id FROM fx_categories
                                               WHERE parent_category_id IS NOT NULL))
        SELECT category_name, {money8('n8')} AS net_revenue FROM leaves
        WHERE n8 > (SELECT avg(n8) FROM leaves)""", "fx_lines", "fx_products", "fx_categories")),
    "dim_date": (dim_date, with_views(f"""
        WITH {_DAYS}
        SELECT date_key, year(date_key) AS year, quarter(date_key) AS quarter, month(date_key) AS month,
               day(date_key) AS day_of_month, isodow(date_key) AS day_of_week, week(date_key) AS iso_week,
               is_weekend, is_public_holiday
        FROM dim""", "fx_orders")),
    "warehouse_conformance": (warehouse_conformance, with_views("""
        SELECT * FROM (VALUES ('orders', 'order_id', 'null', CAST(0 AS BIGINT)), ('orders', 'customer_id', 'null', 0),
            ('orders', 'order_date', 'null', 0), ('orders', 'order_status', 'null', 0),
            ('orders', 'order_status', 'enum', 0), ('orders', 'payment_method', 'enum', 0),
            ('customers', 'customer_id', 'null', 0), ('customers', 'segment', 'null', 0),
            ('customers', 'country_code', 'enum', 0), ('order_items', 'order_id', 'null', 0),
            ('order_items', 'product_id', 'null', 0), ('order_items', 'quantity', 'null', 0),
            ('returns', 'order_item_id', 'null', 0), ('returns', 'quantity_returned', 'null', 0),
            ('returns', 'reason_code', 'enum', 0)) t(table_name, column_name, "check", bad_rows)
        UNION ALL SELECT 'customers', 'deleted_at', 'null', count(*) FILTER (NOT is_deleted) FROM fx_customers
        UNION ALL SELECT 'customers', 'segment', 'enum', count(*) FROM fx_customers
        UNION ALL SELECT 'order_items', 'tax_rate', 'enum', count(*) FILTER (tax NOT IN (7, 19)) FROM fx_items""",
        "fx_customers", "fx_items")),
}
