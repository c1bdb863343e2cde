"""Warehouse and dataset views over the given test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.plans.calendar import dim_date, order_span
from querykiln.schemas import MONEY, RATE

# The test orders run from 1995 to 2001, so their snapshot lies there as well.
SNAPSHOT = "2001-06-30"
YEAR = ("2000-07-01", "2001-06-30")
FIRST_HALF, SECOND_HALF = ("2000-07-01", "2000-12-31"), ("2001-01-01", "2001-06-30")
ITEM_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]
PROHIBITED = ["src3", "src7", "src11"]
TRAIN_SOURCES = [f"src{i}" for i in range(16)]
EVAL_SOURCES = [f"src{i}" for i in range(16, 20)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- warehouse ----------------------------------------------------------------------------

def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id", "o_custkey AS customer_id",
        "CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS channel_id",
        "CAST(o_orderdate AS DATE) AS order_date",
        "CASE WHEN o_orderstatus <> 'O' THEN date_add(CAST(o_orderdate AS DATE), 3) END AS ship_date",
        "CASE o_orderstatus WHEN 'P' THEN 'cancelled' WHEN 'F' THEN 'delivered' ELSE 'placed' END"
        " AS order_status",
        f"CAST(4.99 AS {MONEY}) AS shipping_cost",
        "element_at(array('card', 'invoice', 'paypal', 'direct_debit'), CAST(o_orderkey % 4 AS INT) + 1)"
        " AS payment_method",
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their unit price: whole cents of the extended price per piece."""
    cents = "(CAST(l_extendedprice * 100 + 0.5 AS BIGINT) div CAST(l_quantity AS BIGINT))"
    return table(spark, sf_dir, "lineitem").withColumns({
        "order_item_id": F.struct(*ITEM_KEY),
        "quantity": F.col("l_quantity").cast("bigint"),
        "unit_price_gross": F.expr(f"CAST(CAST({cents} AS DECIMAL(15,0)) * 0.01BD AS {MONEY})"),
    })


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).selectExpr(
        "order_item_id", "l_orderkey AS order_id", "l_partkey AS product_id", "quantity",
        "unit_price_gross",
        "CAST(CAST(quantity AS DECIMAL(9,0)) * unit_price_gross"
        f" * CAST(CAST(l_discount * 100 + 0.5 AS INT) * 0.01BD AS DECIMAL(4,2)) AS {MONEY})"
        " AS discount_amount",
        f"CAST(CAST(l_tax * 100 + 0.5 AS INT) * 0.01BD AS {RATE}) AS tax_rate",
    )


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One return per line flagged R, and for status F a second one with the remaining pieces."""
    half = F.ceil(F.col("quantity") / 2)
    rest = F.when(F.col("l_linestatus") == "F", F.col("quantity") - half)
    parts = F.filter(
        F.array(F.struct(F.lit(1).alias("part"), half.alias("pieces")),
                F.struct(F.lit(2).alias("part"), rest.alias("pieces"))),
        lambda p: p["pieces"] > 0)
    return (
        _lines(spark, sf_dir).filter("l_returnflag = 'R'").withColumn("r", F.explode(parts))
        .selectExpr(
            "struct(order_item_id, r.part) AS return_id", "order_item_id",
            "date_add(CAST(l_shipdate AS DATE), 14) AS return_date", "r.pieces AS quantity_returned",
            "element_at(array('defect', 'wrong_size', 'not_as_described', 'no_reason'),"
            " l_linenumber % 4 + 1) AS reason_code",
            f"CAST(CAST(r.pieces AS DECIMAL(9,0)) * unit_price_gross AS {MONEY}) AS refund_amount",
        )
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id", "concat('SKU-', p_partkey) AS sku", "p_name AS product_name",
        "100 + p_partkey % 25 AS category_id", f"CAST(p_retailprice AS {MONEY}) AS list_price",
        f"CAST(CAST(p_retailprice AS DECIMAL(15,2)) * 0.6BD AS {MONEY}) AS purchase_price",
        "DATE'1994-01-01' AS launched_on",
        "CASE WHEN p_size > 45 THEN DATE'2001-01-01' END AS discontinued_on",
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "region").selectExpr(
        "CAST(1 + r_regionkey AS BIGINT) AS category_id", "r_name AS category_name",
        "CAST(NULL AS BIGINT) AS parent_category_id")
    leaves = table(spark, sf_dir, "nation").selectExpr(
        "CAST(100 + n_nationkey AS BIGINT) AS category_id", "n_name AS category_name",
        "CAST(1 + n_regionkey AS BIGINT) AS parent_category_id")
    return top.unionByName(leaves)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS customer_id", "c_name AS customer_number",
        "date_add(DATE'1994-01-01', CAST(c_custkey % 365 AS INT)) AS signup_date",
        "element_at(array('DE', 'AT', 'CH'), c_nationkey % 3 + 1) AS country_code",
        "CAST(NULL AS STRING) AS postal_code", "c_mktsegment AS segment",
        "c_custkey % 2 = 0 AS newsletter_optin",
        "CASE WHEN c_acctbal < 0 THEN TIMESTAMP'2001-01-01 00:00:00' END AS deleted_at",
    )


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    partner = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    names = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return names.select(
        F.substring("o_orderpriority", 1, 1).cast("bigint").alias("channel_id"),
        F.col("o_orderpriority").alias("channel_name"),
        F.when(partner, "partner").otherwise("direct").alias("channel_type"),
        F.when(partner, F.lit("0.15")).otherwise("0.00").cast(RATE).alias("commission_rate"))


class FixtureWarehouse:
    """The `Warehouse` attributes over the test tables; only those used are opened."""

    _builders = {
        "orders": orders, "order_items": order_items, "products": products,
        "categories": categories, "customers": customers, "channels": channels, "returns": returns,
        "dim_date": lambda spark, sf_dir: dim_date(order_span(orders(spark, sf_dir))),
    }

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._at = (spark, sf_dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name not in FixtureWarehouse._builders:
            raise AttributeError(name)
        frame = FixtureWarehouse._builders[name](*self._at)
        setattr(self, name, frame)
        return frame


def warehouse(spark: SparkSession, sf_dir: str) -> FixtureWarehouse:
    return FixtureWarehouse(spark, sf_dir)


# ---- question/SQL examples ----------------------------------------------------------------

def _pick(values: list[str], key: str = "doc_id") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]),
                        (F.col(key) % len(values) + 1).cast("int"))


def every(n: int, key: str = "doc_id") -> Column:
    return F.col(key) % n == 0


def difficulty_of(n_chars: Column) -> Column:
    return F.when(n_chars < 1000, "easy").when(n_chars < 2500, "medium").otherwise("hard")


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as examples, with planted rule violations at fixed distances."""
    gold = F.concat(
        F.lit("SELECT "), F.col("n_chars"), F.lit(" FROM ecom_v1.orders"),
        F.when(every(59), " WHERE order_date < CURRENT_DATE ( )").otherwise(""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("example_id"),
        F.when(every(41), F.concat(F.lit("gen_"), "doc_id")).when(every(37), "train_shared")
        .otherwise(F.concat(F.lit("train_"), "doc_id")).alias("seed_id"),
        F.when(every(43), "ecom-v2").otherwise("ecom-v1").alias("schema"),
        F.when(every(47), "expert").otherwise(difficulty_of(F.col("n_chars"))).alias("difficulty"),
        F.when(every(53), "cte").otherwise(_pick(["flat", "join_group", "cte_window_set"]))
        .alias("axis_structure"),
        _pick(["none", "window_abs", "window_rel", "period_compare"]).alias("axis_time"),
        F.when(F.col("doc_id") % 20 < 9, "house_term").otherwise("literal").alias("axis_terminology"),
        F.col("text").alias("question_de"), gold.alias("gold_sql"),
        F.when(every(122), F.array(F.lit("axis_time"), F.lit("gold_sql")))
        .when(every(61), F.array(F.lit("axis_time")))
        .otherwise(F.array().cast("array<string>")).alias("missing_keys"),
        F.col("doc_id").alias("line_number"), "source", "lang", "doc_id", "n_chars",
    )


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).filter(F.col("source").isin(TRAIN_SOURCES))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).filter(F.col("source").isin(EVAL_SOURCES))


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examples(spark, sf_dir).filter(F.col("source").isin("src0", "src1"))


def axis_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eval set of the scored records; the Spanish documents are left out on purpose."""
    return examples(spark, sf_dir).filter("lang <> 'es'")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs under two conditions from the labels; some verdicts are missing."""
    return scored_from(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def scored_from(labels: DataFrame, documents: DataFrame) -> DataFrame:
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    cells = F.array(*[
        F.struct(F.lit(run).alias("run"), F.lit(cond).alias("condition"), v.alias("verdict"))
        for run, cond, v in [("run_a", "P0", good), ("run_a", "P1", good | clean),
                             ("run_b", "P0", clean), ("run_b", "P1", good | clean)]])
    rows = labels.select("doc_id", F.explode(cells).alias("c")).select(
        "doc_id", "c.run", "c.condition",
        F.when(~every(17), F.col("c.verdict")).alias("result_equivalent"))
    wrong = ~F.coalesce(F.col("result_equivalent"), F.lit(False))
    lengths = documents.select("doc_id", difficulty_of(F.col("n_chars")).alias("difficulty"))
    return rows.join(lengths, "doc_id").select(
        "run", "condition", F.col("doc_id").cast("string").alias("example_id"), "difficulty",
        "result_equivalent",
        F.when(wrong, _pick(["syntax", "wrong_rows", "timeout"])).alias("error_class"), "doc_id")


def generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as generation records."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(event_id AS STRING) AS example_id", "event_type AS model",
        "concat('P', user_id % 3) AS condition",
        "CAST(floor(value * 10 + 0.5) AS BIGINT) AS latency_ms",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS generated_tokens")


def model_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model answers around document texts: reasoning blocks, fences, plain text."""
    sql = F.concat(F.lit("SELECT "), "n_chars", F.lit(" FROM ecom_v1.orders"))
    text = F.col("text")
    forms = [
        sql,
        F.concat(F.lit("```sql\n"), sql, F.lit("\n```")),
        F.concat(F.lit("<think>"), text, F.lit("</think>\n```sql\n"), sql, F.lit("\n```\n")),
        F.concat(F.lit("<think>a</think>"), text, F.lit("</think> "), sql),
        F.concat(F.lit("``` "), sql, F.lit("```")),
        F.concat(F.lit(" \t"), text, F.lit("\n ")),
        F.concat(F.lit("```\n"), text),
        F.concat(sql, F.lit("\n```")),
    ]
    answer = forms[-1]
    for i, form in enumerate(forms[:-1]):
        answer = F.when(F.col("doc_id") % 8 == i, form).otherwise(answer)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("example_id"), answer.alias("generated_text"), "doc_id")


def sql_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL of each document: good forms and one broken form per lint rule."""
    n = F.col("doc_id").cast("string")
    of = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    forms = [
        of("SELECT COUNT(*) FROM ecom_v1.orders WHERE customer_id = ", n),
        of("SELECT order_id FROM orders WHERE order_id > ", n),
        of("SELECT * FROM ecom_v1.order_lines o JOIN ecom_v1.orders p ON o.id = p.order_id"),
        of("SELECT * FROM ecom_v1.orders WHERE order_date = CURRENT_DATE()"),
        of("SELECT * FROM ecom_v1.orders WHERE order_date < current_date"),
        of("```sql\nSELECT ", n, " FROM ecom_v1.orders\n```"),
        of("SELECT ", n, " FROM ecom_v1.orders -- note"),
        of("SELECT 1 FROM ecom_v1.orders; SELECT ", n, " FROM ecom_v1.returns"),
        of("DELETE FROM ecom_v1.orders WHERE order_id = ", n, ";"),
        of("WITH m AS (SELECT * FROM ecom_v1.orders), n AS (SELECT * FROM m) ",
           "SELECT * FROM n JOIN `ecom_v1.returns` r ON TRUE;"),
        of("SELECT EXTRACT(YEAR FROM order_date) FROM ecom_v1.orders WHERE x = 'FROM a; -- b'"),
        of("WITH RECURSIVE t AS (SELECT 1 AS n FROM ecom_v1.orders UNION ALL SELECT n + 1 FROM t) SELECT * FROM t"),
        of("SELECT EXTRACT(WEEK(MONDAY) FROM order_date) FROM ecom_v1.orders"),
        of("SELECT 1 FROM ecom_v1.orders WHERE ship_date IS NOT DISTINCT FROM order_date"),
        of('SELECT "a;b -- c" AS t FROM ecom_v1.orders WHERE order_id = ', n),
        of("SELECT 'it\\'s; x', \"\"\"a \"b\" -- c;\"\"\" FROM ecom_v1.orders"),
        of("SELECT ", n, " FROM ecom_v1.orders # note"),
        of("SELECT '", F.col("text"), "' AS t FROM ecom_v1.orders"),
    ]
    text = forms[-1]
    for i, form in enumerate(forms[:-1]):
        text = F.when(F.col("doc_id") % len(forms) == i, form).otherwise(text)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("example_id"), text.alias("gold_sql"))


# ---- results and plans --------------------------------------------------------------------

def results(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and predicted result rows: orders per status and month, some predicted differently."""
    o = table(spark, sf_dir, "orders")
    example = F.concat("o_orderstatus", F.lit(" "), F.date_format("o_orderdate", "yyyy-MM"))
    row = lambda price: F.struct(F.col("o_custkey").alias("c0"), price.alias("c1"))
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5)
    hit = F.col("o_orderkey") % 997 == 0
    gold = o.select(example.alias("example_id"), row(cents).alias("row"))
    copies = F.when(F.col("o_orderkey") % 1499 == 0, 2).otherwise(1)
    predicted = o.select(
        example.alias("example_id"), row(F.when(hit, cents + 1).otherwise(cents)).alias("row"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("_copy")).drop("_copy")
    return gold, predicted


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as plan slots: three per family, some moved to the next family."""
    p = table(spark, sf_dir, "part")
    family = F.floor(F.col("p_partkey") / 3) + F.when(every(100, "p_partkey"), 1).otherwise(0)
    return p.select(
        F.col("p_partkey").alias("slot_id"), F.concat(F.lit("F"), family).alias("family"),
        F.when(F.col("p_size") % 2 == 0, "iid").otherwise("ood").alias("split"),
        _pick(["easy", "medium", "hard"], "p_size").alias("difficulty"),
        _pick(["flat", "join_group", "cte_window_set"], "p_partkey").alias("axis_structure"),
        _pick(["none", "window_abs", "window_rel", "period_compare"], "p_size").alias("axis_time"),
        _pick(["literal", "house_term"], "p_partkey").alias("axis_terminology"),
        "p_name", "p_type", "p_brand")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated candidates: some slots have none, some drift from their family."""
    return plan(spark, sf_dir).filter(~every(7, "slot_id")).withColumns({
        "difficulty": F.when(every(11, "slot_id"), "hard").otherwise(F.col("difficulty")),
        "axis_time": F.when(~every(13, "slot_id"), F.col("axis_time")),
    })


def gold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select(
        "slot_id", F.when(every(17, "slot_id"), "replace").otherwise("ok").alias("status"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempt log: one row per line item of a part."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("slot_id"))
