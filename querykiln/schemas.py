"""Record shapes and warehouse tables as DDL text, and vocabularies."""

from __future__ import annotations


# ---- Fixed values: record keys and vocabularies -------------------------------------------
SFT_REQUIRED_KEYS = [
    "example_id", "seed_id", "schema", "difficulty", "axis_structure", "axis_time",
    "axis_terminology", "question_de", "gold_sql",
]
SCHEMA_NAME = "ecom-v1"
SEED_PREFIX = "train_"
DIFFICULTIES = ["easy", "medium", "hard"]
CONDITIONS = ["P0", "P1", "P2"]
AXIS_VOCABULARY = {
    "axis_structure": ["flat", "join_group", "cte_window_set"],
    "axis_time": ["none", "window_abs", "window_rel", "period_compare"],
    "axis_terminology": ["literal", "house_term"],
}
AXES = ["axis_terminology", "axis_structure", "axis_time", "difficulty"]
READY_QUOTA = {"easy": 334, "medium": 333, "hard": 333}
CANDIDATE_BUDGET = (1500, 2000)
HOUSE_TERM_BAND = (0.4, 0.5)
ABLATION_SIZES = [100, 250, 500, 1000]
QUALITY_GATES = [
    "json_schema", "static_sql", "execution", "nonempty_result", "semantic_review",
    "cross_dataset_dedup",
]
SNAPSHOT_DATE = "2026-06-30"
TABLE_PREFIX = "ecom_v1"
# -------------------------------------------------------------------------------------------

MONEY = "decimal(18,4)"
RATE = "decimal(9,6)"

SFT_CANDIDATE = ", ".join(f"{k} string" for k in SFT_REQUIRED_KEYS)
CHAT_RECORD = (
    "example_id string, seed_id string, schema string, difficulty string, "
    "messages array<struct<role: string, content: string>>"
)
SCORED_RECORD = (
    "example_id string, condition string, difficulty string, result_equivalent boolean, "
    "error_class string, generated_sql string"
)
EVAL_BUNDLE = (
    "examples array<struct<example_id: string, question_de: string, split: string, "
    "difficulty: string>>, contexts map<string,string>, prompt_template string, "
    "prompt_version string, eval_version string"
)
RUN_REGISTRY = (
    "ord int, scope string, run string, label string, grp string"
)

WAREHOUSE = {
    "dim_date": (
        "date_key date not null, year bigint not null, quarter bigint not null, "
        "month bigint not null, day_of_month bigint not null, day_of_week bigint not null, "
        "iso_week bigint not null, is_weekend boolean not null, is_public_holiday boolean not null"
    ),
    "categories": (
        "category_id bigint not null, category_name string not null, parent_category_id bigint"
    ),
    "products": (
        "product_id bigint not null, sku string not null, product_name string not null, "
        f"category_id bigint not null, list_price {MONEY} not null, "
        f"purchase_price {MONEY} not null, launched_on date not null, discontinued_on date"
    ),
    "customers": (
        "customer_id bigint not null, customer_number string not null, signup_date date not null, "
        "country_code string not null, postal_code string, segment string not null, "
        "newsletter_optin boolean not null, deleted_at timestamp"
    ),
    "channels": (
        "channel_id bigint not null, channel_name string not null, channel_type string not null, "
        f"commission_rate {RATE} not null"
    ),
    "orders": (
        "order_id bigint not null, customer_id bigint not null, channel_id bigint not null, "
        "order_date date not null, ship_date date, order_status string not null, "
        f"shipping_cost {MONEY} not null, payment_method string not null"
    ),
    "order_items": (
        "order_item_id bigint not null, order_id bigint not null, product_id bigint not null, "
        f"quantity bigint not null, unit_price_gross {MONEY} not null, "
        f"discount_amount {MONEY} not null, tax_rate {RATE} not null"
    ),
    "returns": (
        "return_id bigint not null, order_item_id bigint not null, return_date date not null, "
        f"quantity_returned bigint not null, reason_code string not null, refund_amount {MONEY} not null"
    ),
}

# Declared enumerations of warehouse columns.
WAREHOUSE_ENUMS = {
    "customers": {"country_code": ["DE", "AT", "CH"], "segment": ["private", "business"]},
    "channels": {"channel_name": ["webshop", "app", "marketplace_a", "phone"],
                 "channel_type": ["direct", "partner"]},
    "orders": {"order_status": ["placed", "shipped", "delivered", "cancelled"],
               "payment_method": ["card", "invoice", "paypal", "direct_debit"]},
    "order_items": {"tax_rate": ["0.19", "0.07"]},
    "returns": {"reason_code": ["defect", "wrong_size", "not_as_described", "no_reason"]},
}
