"""The governed e-commerce metrics.

Amounts are exact decimals. Lines are summed per tax rate first and VAT is divided out of the
sums, so no result depends on row order, and every sum is combined on the map side before it
is shuffled. No join carries a broadcast hint: Catalyst and AQE broadcast a side when its
size allows it and otherwise use a sort-merge join whose skewed partitions AQE splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querykiln.functions.numeric import as_money, days_before, month_key, ratio
from querykiln.schemas import SNAPSHOT_DATE
from querykiln.session import kept
from querykiln.sources.warehouse import Warehouse

CANCELLED = "cancelled"


# A line's value is kept at four decimals, a quotient by VAT at eight.

def charged_value() -> Column:
    return F.col("quantity").cast("decimal(9,0)") * F.col("unit_price_gross")


def line_gross() -> Column:
    return charged_value() - F.col("discount_amount")


def net_of_tax(gross: Column, tax_rate: Column) -> Column:
    return (gross.cast("decimal(28,4)") / (tax_rate.cast("decimal(9,6)") + 1)).cast("decimal(38,8)")


def sold_orders(wh: Warehouse) -> DataFrame:
    """Orders that count for revenue, margin, activity, repeat purchase and quantity sold."""
    return wh.orders.filter(F.col("order_status") != CANCELLED)


def in_period(orders: DataFrame, first: str, last: str, date_col: str = "order_date") -> DataFrame:
    """Orders of a closed date range; `order_date` unless another date is asked for."""
    return orders.filter(
        F.col(date_col).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def rate_sums(wh: Warehouse, order_dims: dict[str, Column] | None = None,
              by_product: bool = False, orders: DataFrame | None = None) -> DataFrame:
    """Sold quantity and gross value per order dimension, tax rate and, if asked, product.

    The product table is joined only after this aggregation, so a product sold in very many
    lines reaches that join as a handful of rows.
    """
    dims = order_dims or {}
    chosen = (orders if orders is not None else sold_orders(wh)).select(
        "order_id", *[c.alias(n) for n, c in dims.items()])
    keys = [*dims, *(["product_id"] if by_product else []), "tax_rate"]
    return (
        wh.order_items.join(chosen, "order_id").groupBy(*keys)
        .agg(F.sum("quantity").alias("quantity"), F.sum(line_gross()).alias("gross"))
    )


def without_tax(sums: DataFrame, by: list[str]) -> DataFrame:
    """Exact net revenue `net` per dimension of sums that have one row per dimension and rate."""
    return sums.groupBy(*by).agg(F.sum(net_of_tax(F.col("gross"), F.col("tax_rate"))).alias("net"))


def net_revenue(sums: DataFrame, by: list[str]) -> DataFrame:
    """Net revenue of finer sums, brought to one row per dimension and rate first."""
    return without_tax(sums.groupBy(*by, "tax_rate").agg(F.sum("gross").alias("gross")), by)


# ---- categories ---------------------------------------------------------------------------

def main_categories(categories: DataFrame) -> DataFrame:
    """Leaf and main category names of a two-level tree; a top-level category is its own main."""
    parent = categories.select(
        F.col("category_id").alias("main_id"), F.col("category_name").alias("parent_name"))
    return categories.join(
        parent, F.col("parent_category_id") == F.col("main_id"), "left"
    ).select("category_id", "category_name",
             F.coalesce("parent_name", "category_name").alias("main_category"))


def category_roots(categories: DataFrame) -> DataFrame:
    """Main category of every category, in trees of any depth, and what is wrong with its path.

    Every category points to its parent, and each round to where that one points: a path of a million
    steps takes twenty joins. `problem` is `orphan` below a parent that does not exist (the
    topmost category there is counts as main), and `cycle` on or below a cycle, which has no main
    category: each such category is its own.
    """
    own = categories.select("category_id", "category_name", "parent_category_id")
    there = own.select(F.col("category_id").alias("parent_category_id"), F.lit(True).alias("there"))
    top = F.col("there").isNull()
    steps = kept(own.join(there, "parent_category_id", "left").select(
        "category_id", F.when(top, F.col("category_id")).otherwise(F.col("parent_category_id")).alias("up"),
        top.alias("done"), (top & F.col("parent_category_id").isNotNull()).alias("orphan")), "roots")
    for _ in range(steps.count().bit_length() + 1):
        if steps.where("not done").isEmpty():
            break
        above = steps.select(F.col("category_id").alias("up"), F.col("up").alias("next"), F.col("done").alias("next_done"),
                             F.col("orphan").alias("next_orphan"))
        moved = steps.where("not done").join(above, "up").select(
            "category_id", F.col("next").alias("up"), F.col("next_done").alias("done"), F.col("next_orphan").alias("orphan"))
        steps = kept(steps.where("done").union(moved), "roots")
    names = own.select("category_id", "category_name")
    root = names.select(F.col("category_id").alias("up"), F.col("category_name").alias("root_name"))
    problem = F.when(~F.col("done"), "cycle").when(F.col("orphan"), "orphan")
    return steps.join(names, "category_id").join(root, "up").select(
        "category_id", "category_name", F.when(F.col("done"), F.col("root_name")).otherwise(
            F.col("category_name")).alias("main_category"), problem.alias("problem"))


def leaf_categories(categories: DataFrame) -> DataFrame:
    parents = categories.filter("parent_category_id is not null").select(
        F.col("parent_category_id").alias("category_id")).distinct()
    return categories.join(parents, "category_id", "left_anti")


def category_sums(wh: Warehouse) -> DataFrame:
    """Gross sums per category and tax rate, small enough to meet the category tree."""
    per_product = rate_sums(wh, by_product=True).join(
        wh.products.select("product_id", "category_id"), "product_id")
    return per_product.groupBy("category_id", "tax_rate").agg(F.sum("gross").alias("gross"))


# ---- revenue ------------------------------------------------------------------------------

def net_revenue_by_main_category(wh: Warehouse) -> DataFrame:
    sums = category_sums(wh).join(main_categories(wh.categories), "category_id")
    return net_revenue(sums, ["main_category"]).select(
        "main_category", as_money(F.col("net")).alias("net_revenue"))


def monthly_net(wh: Warehouse, date_col: str = "order_date") -> DataFrame:
    """By month of an order's date; orders that do not have the date yet are in no month."""
    dated = sold_orders(wh).filter(F.col(date_col).isNotNull())
    return without_tax(rate_sums(wh, {"month": F.trunc(date_col, "month")}, orders=dated), ["month"])


def net_revenue_by_month(wh: Warehouse, date_col: str = "order_date") -> DataFrame:
    return monthly_net(wh, date_col).select(
        month_key(F.col("month")).alias("month"), as_money(F.col("net")).alias("net_revenue"))


def returns_per_item(returns: DataFrame) -> DataFrame:
    """One row per returned line: the only form in which returns may meet sales lines."""
    return returns.groupBy("order_item_id").agg(
        F.sum("quantity_returned").alias("quantity_returned"), F.sum("refund_amount").alias("refund"))


def net_revenue_after_returns(wh: Warehouse) -> DataFrame:
    """Net revenue, refunds as recorded, and their difference per month."""
    # Only returned lines go to their orders a second time; the two sums meet as one row per month.
    orders = sold_orders(wh).select("order_id", F.trunc("order_date", "month").alias("month"))
    returned = wh.order_items.select("order_item_id", "order_id").join(returns_per_item(wh.returns), "order_item_id")
    refunds = returned.groupBy("order_id").agg(F.sum("refund").alias("refund")).join(orders, "order_id").groupBy(
        "month").agg(F.sum("refund").cast("decimal(38,8)").alias("refund"))
    per_month = monthly_net(wh).join(refunds, "month", "left").withColumn(
        "refund", F.coalesce("refund", F.lit(0).cast("decimal(38,8)")))
    return per_month.select(
        month_key(F.col("month")).alias("month"), as_money(F.col("net")).alias("net_revenue"), as_money(F.col("refund")).alias("refunds"),
        as_money(F.col("net") - F.col("refund")).alias("net_after_returns"))


def revenue_by_day_type(wh: Warehouse) -> DataFrame:
    """Net revenue on workdays, weekends and public holidays."""
    kind = F.when(F.col("is_public_holiday"), "holiday").when(F.col("is_weekend"), "weekend").otherwise(
        "workday")
    days = wh.dim_date.select(F.col("date_key").alias("order_date"), kind.alias("day_type"))
    sums = rate_sums(wh, {"order_date": F.col("order_date")}).join(days, "order_date")
    calendar = days.groupBy("day_type").agg(F.count(F.lit(1)).alias("days"))
    return net_revenue(sums, ["day_type"]).join(calendar, "day_type").select(
        "day_type", "days", as_money(F.col("net")).alias("net_revenue"))


def contribution_margin_by_channel(wh: Warehouse, commission_base: str = "gross") -> DataFrame:
    """Net revenue minus purchase cost and, for partner channels, commission.

    `commission_base` is `gross` (line value after discount) or `list` (before discount).
    """
    channel = {"channel_id": F.col("channel_id")}
    if commission_base == "gross":
        sums = rate_sums(wh, channel, by_product=True).withColumn("base", F.col("gross"))
    else:
        chosen = sold_orders(wh).select("order_id", "channel_id")
        sums = wh.order_items.join(chosen, "order_id").groupBy(
            "channel_id", "product_id", "tax_rate",
        ).agg(F.sum("quantity").alias("quantity"), F.sum(line_gross()).alias("gross"),
              F.sum(charged_value()).alias("base"))
    cost = F.col("quantity").cast("decimal(18,0)") * F.col("purchase_price")
    per_rate = (
        sums.join(wh.products.select("product_id", "purchase_price"), "product_id")
        .groupBy("channel_id", "tax_rate")
        .agg(F.sum("gross").alias("gross"), F.sum("base").alias("base"), F.sum(cost).alias("cost"))
    )
    per_channel = per_rate.groupBy("channel_id").agg(
        F.sum(net_of_tax(F.col("gross"), F.col("tax_rate"))).alias("net"),
        F.sum("base").cast("decimal(28,4)").alias("base"),
        F.sum("cost").cast("decimal(28,4)").alias("cost"))
    commission = F.when(
        F.col("channel_type") == "partner", F.col("base") * F.col("commission_rate")
    ).otherwise(0).cast("decimal(38,8)")
    return (
        per_channel.join(wh.channels, "channel_id").withColumn("commission", commission)
        .select(
            "channel_name", as_money(F.col("net")).alias("net_revenue"),
            as_money(F.col("cost")).alias("purchase_cost"), as_money(F.col("commission")).alias("commission"),
            as_money(F.col("net") - F.col("cost") - F.col("commission")).alias("margin"))
    )


def revenue_last_days(wh: Warehouse, snapshot: str = SNAPSHOT_DATE, days: int = 90) -> DataFrame:
    """Net revenue per channel in the days up to and including the snapshot."""
    recent = sold_orders(wh).filter(
        F.col("order_date").between(days_before(snapshot, days), F.lit(snapshot).cast("date")))
    sums = rate_sums(wh, {"channel_id": F.col("channel_id")}, orders=recent)
    return without_tax(sums, ["channel_id"]).join(wh.channels, "channel_id").select(
        "channel_name", as_money(F.col("net")).alias("net_revenue"))


def revenue_period_compare(wh: Warehouse, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    """Net revenue of each category in two periods and its change; one pass over the lines."""
    inside = lambda p: F.col("order_date").between(F.lit(p[0]).cast("date"), F.lit(p[1]).cast("date"))
    period = F.when(inside(one), "one").when(inside(two), "two")
    orders = sold_orders(wh).filter(inside(one) | inside(two))
    per_product = rate_sums(wh, {"period": period}, by_product=True, orders=orders).join(
        wh.products.select("product_id", "category_id"), "product_id")
    net = net_revenue(per_product, ["category_id", "period"])
    of = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col("net"))), F.lit(0))
    both = net.groupBy("category_id").agg(of("one").alias("first"), of("two").alias("second"))
    return both.join(wh.categories.select("category_id", "category_name"), "category_id").select(
        "category_name", as_money(F.col("first")).alias("first_period"),
        as_money(F.col("second")).alias("second_period"),
        as_money(F.col("second") - F.col("first")).alias("change"))


# ---- customers ----------------------------------------------------------------------------

def active_customers(wh: Warehouse, snapshot: str = SNAPSHOT_DATE, days: int = 90) -> DataFrame:
    """Existing accounts with a non-cancelled order in the days up to the snapshot, both ends."""
    recent = sold_orders(wh).filter(
        F.col("order_date").between(days_before(snapshot, days), F.lit(snapshot).cast("date")))
    return wh.customers.filter("deleted_at is null").join(
        recent.select("customer_id").distinct(), "customer_id", "left_semi")


def active_customers_by_segment(wh: Warehouse, snapshot: str = SNAPSHOT_DATE) -> DataFrame:
    return active_customers(wh, snapshot).groupBy("segment").agg(
        F.count(F.lit(1)).alias("active_customers"))


def customers_total(wh: Warehouse) -> DataFrame:
    """All customers including deleted accounts, and the two parts."""
    return wh.customers.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"), F.count_if(F.col("deleted_at").isNull()).alias("existing"),
        F.count_if(F.col("deleted_at").isNotNull()).alias("deleted"))


def repeat_customers(orders: DataFrame) -> DataFrame:
    """Customers with orders in two calendar months: the first and last month differ."""
    month = F.trunc("order_date", "month")
    return orders.groupBy("customer_id").agg(
        F.min(month).alias("first_month"), F.max(month).alias("last_month"),
    ).filter(F.col("first_month") < F.col("last_month")).select("customer_id")


def repeat_customers_by_segment(wh: Warehouse, first: str, last: str) -> DataFrame:
    repeat = repeat_customers(in_period(sold_orders(wh), first, last))
    return wh.customers.join(repeat, "customer_id", "left_semi").groupBy("segment").agg(
        F.count(F.lit(1)).alias("repeat_customers"))


def buyers(wh: Warehouse, first: str, last: str) -> DataFrame:
    return in_period(sold_orders(wh), first, last).select("customer_id").distinct()


def named_customers(wh: Warehouse, ids: DataFrame) -> DataFrame:
    return wh.customers.join(ids, "customer_id", "left_semi").select("customer_number")


def customers_both_periods(wh: Warehouse, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    return named_customers(wh, buyers(wh, *one).intersect(buyers(wh, *two)))


def customers_lost(wh: Warehouse, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    return named_customers(wh, buyers(wh, *one).subtract(buyers(wh, *two)))


def customers_either_period(wh: Warehouse, one: tuple[str, str], two: tuple[str, str]) -> DataFrame:
    return named_customers(wh, buyers(wh, *one).union(buyers(wh, *two)).distinct())


def customers_without_orders(wh: Warehouse, first: str, last: str) -> DataFrame:
    """Customers who placed no order at all in the period, cancelled ones included."""
    placed = in_period(wh.orders, first, last).select("customer_id").distinct()
    return wh.customers.join(placed, "customer_id", "left_anti").select("customer_number")


# ---- orders, returns, prices ----------------------------------------------------------------

def order_count_vs_quantity_sold(wh: Warehouse) -> DataFrame:
    """Placed orders (cancelled included) next to quantity sold (cancelled excluded)."""
    placed = wh.orders.groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("placed_orders"),
        F.count_if(F.col("order_status") != CANCELLED).alias("sold_orders"))
    sold = rate_sums(wh, {"channel_id": F.col("channel_id")}).groupBy("channel_id").agg(
        F.sum("quantity").alias("quantity_sold"))
    return (
        placed.join(sold, "channel_id", "left").join(wh.channels, "channel_id")
        .select("channel_name", "placed_orders", "sold_orders",
                F.coalesce("quantity_sold", F.lit(0)).alias("quantity_sold"))
    )


def return_rate_by_reason(wh: Warehouse) -> DataFrame:
    """Returned quantity and refunds per reason, as a share of the quantity sold (sold orders only)."""
    per_item = wh.returns.groupBy("order_item_id", "reason_code").agg(
        F.count(F.lit(1)).alias("returns"), F.sum("quantity_returned").alias("quantity_returned"),
        F.sum("refund_amount").alias("refund"))
    # Returns come with their order, so that lines meet orders once: as one row per order for what
    # was sold, and one per order and reason for what came back.
    sold = wh.order_items.groupBy("order_id").agg(F.sum("quantity").alias("sold"))
    back = per_item.join(wh.order_items.select("order_item_id", "order_id"), "order_item_id").groupBy(
        "order_id", "reason_code").agg(
            F.sum("returns").alias("returns"), F.sum("quantity_returned").alias("quantity_returned"),
            F.sum("refund").alias("refund"))
    both = sold.unionByName(back, allowMissingColumns=True).join(
        sold_orders(wh).select("order_id"), "order_id", "left_semi")
    # A row of sold quantities has no `returns`, and ends up under the reason that is null.
    reasons = both.groupBy("reason_code", F.col("returns").isNull().alias("sales")).agg(
        F.sum("sold").alias("sold"), F.sum("returns").alias("returns"),
        F.sum("quantity_returned").alias("quantity_returned"), F.sum("refund").alias("refund"))
    # One row per reason and one for the sales: the window spreads the quantity sold over them.
    rows = reasons.withColumn("sold", F.max("sold").over(Window.partitionBy()))
    return rows.filter("returns is not null").select(
        "reason_code", "returns", "quantity_returned", as_money(F.col("refund")).alias("refund_amount"),
        F.round(ratio(F.col("quantity_returned"), F.col("sold")), 6).alias("return_rate"))


def return_extent(wh: Warehouse) -> DataFrame:
    """Sales lines by whether nothing, a part or everything came back."""
    lines = wh.order_items.select("order_item_id", "quantity").join(
        returns_per_item(wh.returns), "order_item_id", "left")
    back = F.coalesce("quantity_returned", F.lit(0))
    extent = F.when(back == 0, "none").when(back < F.col("quantity"), "partial").otherwise("full")
    return lines.groupBy(extent.alias("extent")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(back).alias("quantity_returned"))


def refunds_by_return_month(wh: Warehouse, first: str | None = None, last: str | None = None) -> DataFrame:
    """Returns of sold orders by the month of the return itself, in a closed range of return dates if one is given."""
    back = wh.returns
    if first is not None or last is not None:
        back = in_period(back, first or "0001-01-01", last or "9999-12-31", "return_date")
    per_item = back.groupBy("order_item_id", F.trunc("return_date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("returns"), F.sum("quantity_returned").alias("quantity_returned"),
        F.sum("refund_amount").alias("refund"))
    per_order = per_item.join(wh.order_items.select("order_item_id", "order_id"), "order_item_id").groupBy(
        "order_id", "month").agg(*[F.sum(c).alias(c) for c in ("returns", "quantity_returned", "refund")])
    return per_order.join(sold_orders(wh).select("order_id"), "order_id", "left_semi").groupBy("month").agg(
        F.sum("returns").alias("returns"), F.sum("quantity_returned").alias("quantity_returned"),
        as_money(F.sum("refund")).alias("refunds")).withColumn("month", month_key(F.col("month")))


def refunds_by_segment(wh: Warehouse) -> DataFrame:
    """The longest chain: returns to lines to orders to customers, aggregated before each step."""
    per_order = (
        returns_per_item(wh.returns).join(wh.order_items.select("order_item_id", "order_id"), "order_item_id")
        .groupBy("order_id").agg(F.sum("refund").alias("refund"), F.count(F.lit(1)).alias("lines"))
    )
    per_customer = (
        per_order.join(wh.orders.select("order_id", "customer_id"), "order_id")
        .groupBy("customer_id").agg(F.sum("refund").alias("refund"), F.sum("lines").alias("lines"))
    )
    return (
        per_customer.join(wh.customers.select("customer_id", "segment"), "customer_id")
        .groupBy("segment")
        .agg(F.sum("lines").alias("returned_lines"), as_money(F.sum("refund")).alias("refunds"))
    )


def null_state_counts(wh: Warehouse) -> DataFrame:
    """Rows in the state that a NULL in their column stands for."""
    state = lambda t, c, name: t.agg(
        F.count_if(F.col(c).isNull()).alias("in_state"), F.count(F.lit(1)).alias("all_rows"),
    ).select(F.lit(name).alias("state"), "in_state", "all_rows")
    return (
        state(wh.orders, "ship_date", "unshipped_order")
        .unionByName(state(wh.products, "discontinued_on", "product_in_assortment"))
        .unionByName(state(wh.customers, "deleted_at", "existing_account"))
        .unionByName(state(wh.categories, "parent_category_id", "main_category"))
    )


def price_realisation(wh: Warehouse) -> DataFrame:
    """Charged value over list value of the quantity sold, per main category."""
    sold = sold_orders(wh).select("order_id")
    charged = charged_value()
    per_product = wh.order_items.join(sold, "order_id", "left_semi").groupBy("product_id").agg(
        F.sum("quantity").alias("quantity"), F.sum(charged).alias("charged"))
    list_value = F.col("quantity").cast("decimal(18,0)") * F.col("list_price")
    per_category = (
        per_product.join(wh.products.select("product_id", "category_id", "list_price"), "product_id")
        .groupBy("category_id").agg(F.sum("charged").alias("charged"), F.sum(list_value).alias("list_value"))
    )
    return (
        per_category.join(main_categories(wh.categories), "category_id").groupBy("main_category")
        .agg(F.sum("charged").alias("charged"), F.sum("list_value").alias("list_value"))
        .select("main_category", as_money(F.col("charged")).alias("charged_value"),
                as_money(F.col("list_value")).alias("list_value"),
                F.round(ratio(F.col("charged"), F.col("list_value")), 6).alias("realisation"))
    )


def orders_without_returns(wh: Warehouse) -> DataFrame:
    """Sold orders none of whose lines came back, per channel."""
    returned = (
        wh.order_items.select("order_item_id", "order_id")
        .join(wh.returns.select("order_item_id").distinct(), "order_item_id", "left_semi")
        .select("order_id").distinct()
    )
    kept = sold_orders(wh).join(returned, "order_id", "left_anti").groupBy("channel_id").agg(
        F.count(F.lit(1)).alias("orders"))
    return kept.join(wh.channels, "channel_id").select("channel_name", "orders")


def products_per_main_category(wh: Warehouse, roots: DataFrame) -> DataFrame:
    """Products below each main category, given the roots of a tree of any depth.

    Products of a category that the tree does not have are counted under a null one.
    """
    per_category = wh.products.groupBy("category_id").agg(
        F.count(F.lit(1)).alias("products"), F.count_if(F.col("discontinued_on").isNull()).alias("in_assortment"))
    return per_category.join(roots, "category_id", "left").groupBy("main_category").agg(
        F.sum("products").alias("products"), F.sum("in_assortment").alias("in_assortment"))


# ---- rankings and windows -------------------------------------------------------------------

def product_net(wh: Warehouse) -> DataFrame:
    """Net revenue per product: one row per product meets the product table."""
    net = without_tax(rate_sums(wh, by_product=True), ["product_id"])
    return net.join(wh.products.select("product_id", "product_name", "category_id"), "product_id")


def top_products(wh: Warehouse, n: int = 10) -> DataFrame:
    """Best-selling products; ties are broken by name and id."""
    best = product_net(wh).orderBy(F.col("net").desc(), "product_name", "product_id").limit(n)
    return best.select("product_name", "product_id", as_money(F.col("net")).alias("net_revenue"))


def top_products_per_category(wh: Warehouse, n: int = 3) -> DataFrame:
    """Best products of each category; each map task forwards at most n rows per category."""
    order = Window.partitionBy("category_id").orderBy(F.col("net").desc(), "product_name", "product_id")
    ranked = product_net(wh).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.join(wh.categories.select("category_id", "category_name"), "category_id").select(
        "category_name", F.col("rank").cast("bigint").alias("rank"), "product_name", "product_id",
        as_money(F.col("net")).alias("net_revenue"))


# The windows below order whole months: their input is one row per calendar month (and group).

def every_month(monthly: DataFrame, by: list[str], value: str = "net_revenue") -> DataFrame:
    """by, month (a date), value of every month from a group's first to its last; months without a row are 0."""
    span = monthly.groupBy(*by).agg(F.min("month").alias("first"), F.max("month").alias("last")).where("first is not null")
    months = span.select(*by, F.explode(F.sequence("first", "last", F.expr("interval 1 month"))).alias("month"))
    return months.join(monthly.select(*by, "month", value), [*by, "month"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0)))


def monthly_series(wh: Warehouse, dims: dict[str, Column] | None = None, date_col: str = "order_date") -> DataFrame:
    """Net revenue of every calendar month, per order dimension if asked, months without sales included."""
    dims = dims or {}
    dated = sold_orders(wh).filter(F.col(date_col).isNotNull())
    net = without_tax(rate_sums(wh, {**dims, "month": F.trunc(date_col, "month")}, orders=dated), [*dims, "month"])
    return every_month(net.select(*dims, "month", as_money(F.col("net")).alias("net_revenue")), list(dims))


def revenue_month_over_month(wh: Warehouse, dims: dict[str, Column] | None = None) -> DataFrame:
    """Each month against the one before it in the calendar, whose revenue is 0 if nothing was sold."""
    by = list(dims or {})
    before = F.lag("net_revenue").over(Window.partitionBy(*by).orderBy("month"))
    change = F.col("net_revenue") - F.col("previous")
    return monthly_series(wh, dims).withColumn("previous", before).select(
        *by, month_key(F.col("month")).alias("month"), "net_revenue", "previous", F.round(change, 2).alias("change"),
        F.round(F.try_divide(change, F.col("previous")), 6).alias("change_rate"))


def running_revenue(wh: Warehouse) -> DataFrame:
    so_far = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return net_revenue_by_month(wh).select(
        "month", "net_revenue", F.round(F.sum("net_revenue").over(so_far), 2).alias("running_revenue"))


def revenue_moving_avg(wh: Warehouse, months: int = 3, dims: dict[str, Column] | None = None) -> DataFrame:
    """Average of the last calendar months; those without sales count as 0."""
    by = list(dims or {})
    recent = Window.partitionBy(*by).orderBy("month").rowsBetween(1 - months, Window.currentRow)
    return monthly_series(wh, dims).select(
        *by, month_key(F.col("month")).alias("month"), "net_revenue",
        F.round(F.avg("net_revenue").over(recent), 4).alias("moving_avg"))


def category_net(wh: Warehouse) -> DataFrame:
    return without_tax(category_sums(wh), ["category_id"])


def category_revenue_share(wh: Warehouse) -> DataFrame:
    """Share of each category in its main category (one row per category in the window)."""
    rows = category_net(wh).join(main_categories(wh.categories), "category_id")
    whole = F.sum("net").over(Window.partitionBy("main_category"))
    return rows.select(
        "main_category", "category_name", as_money(F.col("net")).alias("net_revenue"),
        F.round(ratio(F.col("net"), whole), 6).alias("share"))


def leaf_categories_above_average(wh: Warehouse) -> DataFrame:
    """Leaf categories above the average of leaf categories; unsold leaves count as zero."""
    rows = leaf_categories(wh.categories).join(category_net(wh), "category_id", "left").select(
        "category_name", F.coalesce("net", F.lit(0)).cast("double").alias("net"))
    return (
        rows.withColumn("benchmark", F.avg("net").over(Window.partitionBy()))
        .filter(F.col("net") > F.col("benchmark"))
        .select("category_name", F.round("net", 2).alias("net_revenue"))
    )
