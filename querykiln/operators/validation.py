"""Validation of SFT candidates: one row per violation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.operators.keys import join_profile, key_profile, sft_keys
from querykiln.schemas import (
    AXIS_VOCABULARY, DIFFICULTIES, READY_QUOTA, SCHEMA_NAME, SEED_PREFIX,
)

# Fixed value: only the call form counts here; the lint also flags the bare keyword.
DYNAMIC_TIME_CALL = r"(?i)\bCURRENT_(?:DATE|TIMESTAMP)\s*\("

LEAK_RULES = {"seed_id": "eval seed leakage", "question": "eval question leakage",
              "gold_sql": "eval SQL leakage"}


def require_keys(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows, all of which must have `keys`: the first one without them stops the job."""
    lacking = F.array_intersect("missing_keys", F.array(*[F.lit(k) for k in keys]))
    return rows.filter(F.when(F.size(lacking) == 0, F.lit(True)).otherwise(F.raise_error(
        F.concat(F.lit(f"{what} lacks "), F.array_join(lacking, ", "))).cast("boolean")))


def complete(rows: DataFrame) -> DataFrame:
    """Rows with all required keys; the others are reported once and take no further part."""
    return rows.filter(F.size("missing_keys") == 0)


BATCH_SPAN = 1 << 48


def union_batches(batches: list[DataFrame], order_col: str = "line_number") -> DataFrame:
    """Batches one after the other; `position` orders by (batch, line).

    Both numbers share one long, which keeps later aggregations over it hash-based.
    """
    tagged = [
        b.withColumn("position", F.lit(i * BATCH_SPAN) + F.col(order_col)) for i, b in enumerate(batches)
    ]
    out = tagged[0]
    for batch in tagged[1:]:
        out = out.unionByName(batch)
    return out


def batch_of(position: Column) -> Column:
    return F.floor(position / F.lit(BATCH_SPAN)).cast("int")


def line_of(position: Column) -> Column:
    return position % F.lit(BATCH_SPAN)


def prepend_known(data: DataFrame, known: list[DataFrame]) -> list[DataFrame]:
    """Batch order of the validator: each known file is put in front of what is there."""
    return [*reversed(known), data]


def _fails(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(True))


def row_violations(rows: DataFrame, order_col: str = "line_number") -> DataFrame:
    """Rules that need only the row itself, in one pass.

    A row without all required keys has that one violation; the others are checked for the
    schema literal, difficulty, seed prefix and dynamic time.
    """
    entry = lambda rule, detail: F.struct(
        F.lit(rule).alias("rule"), F.coalesce(detail, F.lit("")).alias("detail"))
    rules = [
        (_fails(F.col("schema") != SCHEMA_NAME), "unexpected schema", F.col("schema")),
        (_fails(~F.col("difficulty").isin(DIFFICULTIES)), "invalid difficulty",
         F.col("difficulty")),
        (_fails(~F.startswith(F.col("seed_id"), F.lit(SEED_PREFIX))),
         "seed_id must start with train_", F.col("seed_id")),
        (F.col("gold_sql").rlike(DYNAMIC_TIME_CALL), "dynamic time function is forbidden",
         F.lit("")),
    ]
    missing = F.array(entry("missing keys", F.array_join("missing_keys", ",")))
    broken = F.array_compact(F.array(*[F.when(bad, entry(rule, value)) for bad, rule, value in rules]))
    found = F.when(F.size("missing_keys") > 0, missing).otherwise(broken)
    return rows.select(order_col, F.explode(found).alias("v")).select(order_col, "v.*")


def key_violations(train: DataFrame, evaluation: DataFrame | None,
                   order_col: str = "line_number") -> DataFrame:
    """Every later copy of a key, and every train row whose key the eval set has."""
    keys = sft_keys(train, order_col)
    eval_keys = None if evaluation is None else sft_keys(evaluation, None)
    flagged = join_profile(keys, key_profile(keys, eval_keys))
    leak_rule = F.create_map(*[F.lit(x) for pair in LEAK_RULES.items() for x in pair])
    found = F.array_compact(F.array(
        F.when(F.col("ord") > F.col("first_ord"), F.concat(F.lit("duplicate "), F.col("label"))),
        F.when(F.col("in_eval"), F.try_element_at(leak_rule, F.col("label"))),
    ))
    return flagged.select(
        F.col("ord").alias(order_col), F.explode(found).alias("rule"), F.lit("").alias("detail")
    )


def violations(train: DataFrame, evaluation: DataFrame | None = None,
               order_col: str = "line_number") -> DataFrame:
    """All row-level violations `(order_col, rule, detail)` of a candidate set."""
    return row_violations(train, order_col).unionByName(
        key_violations(complete(train), evaluation, order_col))


def quota_report(rows: DataFrame, quota: dict[str, int] = READY_QUOTA) -> DataFrame:
    """Actual and wanted rows per difficulty and in total; incomplete rows count too."""
    levels = list(quota)
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("difficulty") == d).alias(d) for d in levels],
    )
    lines = [("total", sum(quota.values())), *quota.items()]
    cells = F.array(*[
        F.struct(F.lit(name).alias("difficulty"), F.col(name).alias("actual"),
                 F.lit(want).cast("bigint").alias("target"))
        for name, want in lines
    ])
    return counts.select(F.explode(cells).alias("q")).select(
        "q.*", (F.col("q.actual") - F.col("q.target")).alias("gap"),
        (F.col("q.actual") == F.col("q.target")).alias("met"),
    )


def is_valid(found: DataFrame) -> bool:
    return found.isEmpty()


def vocabulary_drift(rows: DataFrame, vocabulary: dict[str, list[str]] = AXIS_VOCABULARY) -> DataFrame:
    """Axis values outside the specification, with their row counts."""
    outside = F.array_compact(F.array(*[
        F.when(~F.coalesce(F.col(axis).isin(values), F.lit(False)),
               F.struct(F.lit(axis).alias("axis"), F.col(axis).alias("value")))
        for axis, values in vocabulary.items()
    ]))
    return (
        rows.select(F.explode(outside).alias("v")).groupBy("v.axis", "v.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def conformance(table: DataFrame, name: str, not_null: list[str],
                enums: dict[str, list]) -> DataFrame:
    """Null counts of mandatory columns and counts of values outside enumerations."""
    checks = [(c, "null", F.count_if(F.col(c).isNull())) for c in not_null]
    checks += [
        (c, "enum", F.count_if(~F.col(c).isin(values))) for c, values in enums.items()
    ]
    one = table.agg(*[count.alias(f"n{i}") for i, (_, _, count) in enumerate(checks)])
    cells = F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"),
                 F.lit(kind).alias("check"), F.col(f"n{i}").alias("bad_rows"))
        for i, (c, kind, _) in enumerate(checks)
    ])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def prohibited_inputs(lineage: DataFrame, prohibited: list[str]) -> DataFrame:
    """Lineage rows whose source file may not feed the generator."""
    return lineage.filter(F.col("source_file").isin(prohibited))


def disallowed_contexts(lineage: DataFrame, allowed: list[str]) -> DataFrame:
    return lineage.filter(~F.coalesce(F.col("context_file").isin(allowed), F.lit(False)))


def error_messages(found: DataFrame, order_col: str = "line_number", keep: list[str] = ()) -> DataFrame:
    """Text form of violations, for reports."""
    text = F.when(
        F.col("rule") == "missing keys",
        F.format_string("line %d: missing [%s]", F.col(order_col),
                        F.concat(F.lit("'"), F.replace(F.col("detail"), F.lit(","), F.lit("', '")),
                                 F.lit("'"))),
    ).otherwise(F.format_string("line %d: %s", F.col(order_col), F.col("rule")))
    return found.select(F.col(order_col), text.alias("message"), *keep)
