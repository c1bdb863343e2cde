"""Condition-by-example generation grids: what is done, what is left, is it whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.functions.text import strip_sql_fences
from querykiln.operators.chat import render_prompt
from querykiln.operators.selection import values_at
from querykiln.schemas import SCHEMA_NAME

KEY = ["condition", "example_id"]


def grid(examples: DataFrame, conditions: list[str]) -> DataFrame:
    """Each example once per condition (an explode of a literal list, no join)."""
    return examples.withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))


def pending(examples: DataFrame, done: DataFrame, conditions: list[str]) -> DataFrame:
    """Grid cells that have no record yet."""
    finished = done.filter(F.col("condition").isin(conditions)).select(*KEY).distinct()
    return grid(examples, conditions).join(finished, KEY, "left_anti")


def first_records(rows: DataFrame, n: int, order_col: str = "line_number") -> DataFrame:
    """The first n rows in file order; 0 keeps all."""
    return slice_shard(rows, 0, n, order_col) if n and not rows.isEmpty() else rows


def slice_shard(rows: DataFrame, offset: int, limit: int, order_col: str = "line_number") -> DataFrame:
    """Offset-then-limit shard in file order; a limit of 0 takes the rest, a shard without rows is an error.

    `order_col` is a number, different in every row. Where the shard begins and ends is found by counting,
    so that the shard is a filter: nothing is sorted or gathered, however large it is.
    """
    first, end = values_at(rows, order_col, [offset, offset + limit if limit else -1])
    if first is None:
        raise ValueError(f"no rows from offset {offset} on: the shard is empty")
    chosen = F.col(order_col) >= F.lit(first)
    return rows.filter(chosen if end is None else chosen & (F.col(order_col) < F.lit(end)))


def hash_shard(rows: DataFrame, shard: int, shards: int, key: str = "example_id") -> DataFrame:
    """Stable share of the rows without a sort; the shards together are all rows."""
    return rows.filter(F.pmod(F.xxhash64(key), F.lit(shards)) == shard)


def resume_violations(done: DataFrame, conditions: list[str]) -> DataFrame:
    """Existing records outside the selected conditions, or present more than once."""
    known = F.col("condition").isin(conditions)
    problem = F.when(~F.coalesce(known, F.lit(False)), "unexpected condition").when(
        F.col("copies") > 1, "duplicate")
    return (
        done.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("problem", problem).filter("problem is not null")
    )


def completeness(examples: DataFrame, done: DataFrame, conditions: list[str]) -> DataFrame:
    """Finished and expected cells per condition."""
    finished = (
        done.filter(F.col("condition").isin(conditions)).select(*KEY).distinct()
        .join(examples.select("example_id").distinct(), "example_id", "left_semi")
        .groupBy("condition").agg(F.count(F.lit(1)).alias("records"))
    )
    expected = grid(examples.select("example_id").distinct(), conditions).groupBy("condition").agg(
        F.count(F.lit(1)).alias("expected"))
    return expected.join(finished, "condition", "left").select(
        "condition", F.coalesce("records", F.lit(0)).alias("records"), "expected",
    ).withColumn("complete", F.col("records") == F.col("expected"))


def prompt_grid(examples: DataFrame, conditions: list[str]) -> DataFrame:
    """Prompts of bundle examples for each condition; the context is looked up in the map."""
    cells = grid(examples, conditions)
    context = F.element_at("contexts", F.col("condition"))
    return cells.withColumn(
        "prompt", render_prompt(F.col("prompt_template"), context, F.col("question_de"))
    ).drop("contexts")


def generation_records(cells: DataFrame, outputs: DataFrame, run_id: str, model: str,
                       base_model: str, adapter_path: str | None = None,
                       max_new_tokens: int = 1536, quantization: str = "nf4-4bit",
                       thinking: bool = False, thinking_budget: int = 1536) -> DataFrame:
    """Records of answered cells.

    `outputs` holds `(condition, example_id, generated_text, latency_ms, thinking_tokens,
    generated_tokens)` from whatever ran the model.
    """
    return cells.join(outputs, KEY).select(
        F.lit(run_id).alias("run_id"), "eval_version", F.lit(SCHEMA_NAME).alias("schema"),
        "split", "difficulty", "example_id", F.lit(model).alias("model"),
        F.lit(base_model).alias("base_model"),
        F.lit(adapter_path).cast("string").alias("adapter_path"),
        F.lit("adapter" if adapter_path else "base").alias("model_mode"), "prompt_version",
        F.concat(F.lit(SCHEMA_NAME + "-"), F.lower("condition")).alias("schema_context_version"),
        "condition", strip_sql_fences(F.col("generated_text")).alias("generated_sql"),
        F.col("latency_ms").cast("bigint").alias("latency_ms"),
        F.lit(max_new_tokens).alias("max_new_tokens"), F.lit(quantization).alias("quantization"),
        F.lit(thinking).alias("thinking"),
        F.lit(thinking_budget if thinking else 0).alias("thinking_budget"),
        F.col("thinking_tokens").cast("int").alias("thinking_tokens"),
        F.col("generated_tokens").cast("int").alias("generated_tokens"),
    )


def run_manifest(done: DataFrame, examples: DataFrame, conditions: list[str], run_id: str,
                 model: str, stopped: bool = False, settings: dict | None = None) -> DataFrame:
    """One row: records, conditions and whether the grid is whole; then the run's settings as they are."""
    totals = completeness(examples, done, conditions).agg(
        F.sum("records").alias("records"), F.sum("expected").alias("expected"))
    return totals.select(
        F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), "records",
        F.array(*[F.lit(c) for c in conditions]).alias("conditions"),
        ((F.col("records") == F.col("expected")) & F.lit(not stopped)).alias("complete"),
        *[F.lit(value).alias(name) for name, value in (settings or {}).items()],
    )
