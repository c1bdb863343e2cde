"""The same views as `views.py` in DuckDB SQL, written independently with whole numbers.

Amounts are integers: cents, or 1e-4 units where a percent discount has been taken off.
"""

from __future__ import annotations

VIEWS = {
    "fx_orders": """
        SELECT o_orderkey AS order_id, o_custkey AS customer_id,
               CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS channel_id,
               CAST(o_orderdate AS DATE) AS order_date,
               CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
               o_orderstatus = 'P' AS is_cancelled, o_orderstatus = 'O' AS unshipped
        FROM orders""",
    "fx_items": """
        SELECT struct_pack(a := l_orderkey, b := l_partkey, c := l_suppkey, d := l_linenumber,
                           e := l_shipdate) AS item, l_orderkey AS order_id,
               l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity,
               CAST(round(l_extendedprice * 100) AS BIGINT) // CAST(l_quantity AS BIGINT) AS unit_cents,
               CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
               l_returnflag, l_linestatus, l_linenumber
        FROM lineitem""",
    "fx_lines": """
        SELECT i.*, quantity * unit_cents * (100 - disc) AS gross4, customer_id, channel_id,
               order_date, month, is_cancelled
        FROM fx_items i JOIN fx_orders USING (order_id)""",
    "fx_returns": """
        SELECT item, order_id, l_linenumber % 4 AS reason, part, pieces, pieces * unit_cents AS refund_cents
        FROM (SELECT *, 1 AS part, (quantity + 1) // 2 AS pieces FROM fx_items WHERE l_returnflag = 'R'
              UNION ALL
              SELECT *, 2 AS part, quantity // 2 AS pieces FROM fx_items
              WHERE l_returnflag = 'R' AND l_linestatus = 'F')
        WHERE pieces > 0""",
    "fx_item_returns": """
        SELECT item, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(refund_cents) AS BIGINT) AS refund_cents
        FROM fx_returns GROUP BY item""",
    "fx_products": """
        SELECT p_partkey AS product_id, p_name AS product_name, 100 + p_partkey % 25 AS category_id,
               CAST(round(p_retailprice * 100) AS BIGINT) AS list_cents, p_size > 45 AS discontinued
        FROM part""",
    "fx_categories": """
        SELECT CAST(1 + r_regionkey AS BIGINT) AS category_id, r_name AS category_name,
               CAST(NULL AS BIGINT) AS parent_category_id FROM region
        UNION ALL
        SELECT CAST(100 + n_nationkey AS BIGINT), n_name, CAST(1 + n_regionkey AS BIGINT) FROM nation""",
    "fx_tree": """
        SELECT c.category_id, c.category_name, coalesce(p.category_name, c.category_name) AS main_category
        FROM fx_categories c LEFT JOIN fx_categories p ON c.parent_category_id = p.category_id""",
    "fx_channels": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS channel_id,
               o_orderpriority AS channel_name, o_orderpriority = '4-NOT SPECIFIED' AS partner
        FROM orders""",
    "fx_customers": """
        SELECT c_custkey AS customer_id, c_name AS customer_number, c_mktsegment AS segment,
               c_acctbal < 0 AS is_deleted, c_nationkey % 3 AS country
        FROM customer""",
    "fx_examples": """
        SELECT CAST(doc_id AS VARCHAR) AS example_id,
               CASE WHEN doc_id % 41 = 0 THEN 'gen_' || doc_id WHEN doc_id % 37 = 0 THEN 'train_shared'
                    ELSE 'train_' || doc_id END AS seed_id,
               CASE WHEN doc_id % 43 = 0 THEN 'ecom-v2' ELSE 'ecom-v1' END AS schema,
               CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 2500 THEN 'medium' ELSE 'hard' END
                    AS plain_difficulty,
               CASE WHEN doc_id % 47 = 0 THEN 'expert' ELSE plain_difficulty END AS difficulty,
               CASE WHEN doc_id % 53 = 0 THEN 'cte' ELSE
                    ['flat', 'join_group', 'cte_window_set'][doc_id % 3 + 1] END AS axis_structure,
               ['none', 'window_abs', 'window_rel', 'period_compare'][doc_id % 4 + 1] AS axis_time,
               CASE WHEN doc_id % 20 < 9 THEN 'house_term' ELSE 'literal' END AS axis_terminology,
               text AS question_de,
               'SELECT ' || n_chars || ' FROM ecom_v1.orders' ||
                    CASE WHEN doc_id % 59 = 0 THEN ' WHERE order_date < CURRENT_DATE ( )' ELSE '' END AS gold_sql,
               doc_id % 61 <> 0 AS is_complete,
               CAST(source[4:] AS INT) < 16 AS is_train, CAST(source[4:] AS INT) < 2 AS is_known,
               trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm_question,
               doc_id AS line_number, doc_id, source, lang, n_chars, text
        FROM documents""",
    "fx_train": "SELECT * FROM fx_examples WHERE is_train",
    "fx_evaluation": "SELECT * FROM fx_examples WHERE NOT is_train",
    "fx_axis_eval": "SELECT * FROM fx_examples WHERE lang <> 'es'",
    "fx_scored": """
        SELECT run, condition, CAST(doc_id AS VARCHAR) AS example_id,
               CASE WHEN n_chars < 1000 THEN 'easy' WHEN n_chars < 2500 THEN 'medium' ELSE 'hard' END
                    AS difficulty,
               doc_id,
               CASE WHEN doc_id % 17 = 0 THEN NULL WHEN condition = 'P1' THEN quality = 1 OR toxic = 0
                    WHEN run = 'run_a' THEN quality = 1 ELSE toxic = 0 END AS verdict
        FROM labels JOIN documents USING (doc_id),
             (VALUES ('run_a'), ('run_b')) r(run), (VALUES ('P0'), ('P1')) c(condition)""",
    "fx_plan": """
        SELECT p_partkey AS slot_id,
               'F' || (p_partkey // 3 + CASE WHEN p_partkey % 100 = 0 THEN 1 ELSE 0 END) AS family,
               CASE WHEN p_size % 2 = 0 THEN 'iid' ELSE 'ood' END AS split,
               ['easy', 'medium', 'hard'][p_size % 3 + 1] AS difficulty,
               ['flat', 'join_group', 'cte_window_set'][p_partkey % 3 + 1] AS axis_structure,
               ['none', 'window_abs', 'window_rel', 'period_compare'][p_size % 4 + 1] AS axis_time,
               ['literal', 'house_term'][p_partkey % 2 + 1] AS axis_terminology,
               p_name, p_type, p_brand
        FROM part""",
}

# Which other views a view reads.
_NEEDS = {
    "fx_lines": ["fx_items", "fx_orders"], "fx_returns": ["fx_items"],
    "fx_item_returns": ["fx_returns"], "fx_tree": ["fx_categories"],
    "fx_train": ["fx_examples"], "fx_evaluation": ["fx_examples"], "fx_axis_eval": ["fx_examples"],
}


def net8(gross4: str, tax: str) -> str:
    """Net value in 1e-8 units, rounded half up, of a gross sum in 1e-4 units."""
    return (f"(2 * CAST({gross4} AS HUGEINT) * 1000000 + (100 + {tax})) // (2 * (100 + {tax}))")


def money8(total8: str) -> str:
    """1e-8 units as an amount with two decimals, rounded half away from zero."""
    t = f"CAST({total8} AS HUGEINT)"
    cents = f"CASE WHEN {t} < 0 THEN -((-{t} + 500000) // 1000000) ELSE ({t} + 500000) // 1000000 END"
    return f"CAST({cents} AS DOUBLE) / 100.0"


def with_views(body: str, *views: str) -> str:
    """The query with the views it names (and theirs) as CTEs in front."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in views:
        visit(name)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in order]
    text = body.strip()
    if text.upper().startswith("WITH "):
        ctes.append(text[5:])
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" + text) if ctes else text
