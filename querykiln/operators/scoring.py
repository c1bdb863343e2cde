"""Accuracy of scored generations by axis, run and condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.functions.numeric import count_true, ratio
from querykiln.schemas import AXES

WRONG_LABELS = [*AXES, "question_de"]


def latest_eval(evaluation: DataFrame, order_col: str = "line_number",
                columns: list[str] = AXES) -> DataFrame:
    """One row per example with the wanted columns; of several copies the last one counts."""
    return (
        evaluation.groupBy("example_id")
        .agg(F.max_by(F.struct(*columns), F.col(order_col)).alias("e"))
        .select("example_id", "e.*")
    )


def _tally(scored: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key and example before any join, so a much repeated example is one row."""
    return scored.groupBy(*keys, "example_id").agg(
        F.count(F.lit(1)).alias("n"), count_true(F.col("result_equivalent")).alias("ok"))


def _labelled(scored: DataFrame, evaluation: DataFrame, axes: list[str],
              keys: list[str]) -> DataFrame:
    """Counts with the axis values of the eval set; a matched example without one is an error."""
    given = lambda a: F.coalesce(
        F.col(a), F.raise_error(F.lit(f"eval example without {a}")).cast("string"))
    axis_of = evaluation.select("example_id", *axes)
    return _tally(scored, keys).join(axis_of, "example_id").withColumns({a: given(a) for a in axes})


def _accuracy(counts: DataFrame) -> DataFrame:
    return counts.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("total")), 6))


def accuracy_by_axis(scored: DataFrame, evaluation: DataFrame, axis: str = "axis_terminology",
                     keys: list[str] = ["condition"]) -> DataFrame:
    """Correct and total per axis value and for ALL; examples outside the eval set are dropped."""
    rows = _labelled(scored, evaluation, [axis], keys)
    totals = [F.sum("ok").alias("correct"), F.sum("n").alias("total")]
    sets = [[F.col(k) for k in keys] + [F.col(axis)], [F.col(k) for k in keys]]
    counts = rows.groupingSets(sets, *keys, axis).agg(F.grouping(axis).alias("all_row"), *totals)
    value = F.when(F.col("all_row") == 1, "ALL").otherwise(F.col(axis))
    return _accuracy(counts).select(*keys, value.alias("axis_value"), "correct", "total", "accuracy")


def accuracy_all_axes(scored: DataFrame, evaluation: DataFrame,
                      keys: list[str] = ["condition"], axes: list[str] = AXES) -> DataFrame:
    """All axes and the ALL row from one scan and one aggregation."""
    rows = _labelled(scored, evaluation, axes, keys)
    base = [F.col(k) for k in keys]
    sets = [base + [F.col(a)] for a in axes] + [base]
    counts = rows.groupingSets(sets, *keys, *axes).agg(
        *[F.grouping(a).alias(f"g_{a}") for a in axes],
        F.sum("ok").alias("correct"), F.sum("n").alias("total"))
    axis, value = F.lit("ALL"), F.lit("ALL")
    for a in axes:
        axis = F.when(F.col(f"g_{a}") == 0, a).otherwise(axis)
        value = F.when(F.col(f"g_{a}") == 0, F.col(a)).otherwise(value)
    return _accuracy(counts).select(
        *keys, axis.alias("axis"), value.alias("axis_value"), "correct", "total", "accuracy")


def run_condition_counts(scored: DataFrame, run_keys: list[str] = ["run"]) -> DataFrame:
    """Rows, strictly true verdicts and the hard subset per run and condition."""
    right = F.coalesce(F.col("result_equivalent"), F.lit(False))
    hard = F.coalesce(F.col("difficulty") == "hard", F.lit(False))
    return scored.groupBy(*run_keys, "condition").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(right).alias("correct"),
        F.count_if(hard).alias("hard_total"), F.count_if(hard & right).alias("hard_correct"))


def accuracy_by_run(scored: DataFrame, run_keys: list[str] = ["run"],
                    conditions: list[str] = ["P0", "P1"]) -> DataFrame:
    """P0 and P1 accuracy of each run side by side, their difference, and hard P0 accuracy."""
    pivot = run_condition_counts(scored, run_keys).groupBy(*run_keys).pivot("condition", conditions).agg(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"),
        F.sum("hard_total").alias("hard_total"), F.sum("hard_correct").alias("hard_correct"))
    a, b = conditions
    share = lambda c, num, den: F.round(ratio(F.col(f"{c}_{num}"), F.col(f"{c}_{den}")), 6)
    low = a.lower()
    return pivot.select(
        *run_keys,
        F.col(f"{a}_total").alias("total"),
        share(a, "correct", "total").alias(f"accuracy_{low}"),
        share(b, "correct", "total").alias(f"accuracy_{b.lower()}"),
        F.round(ratio(F.col(f"{b}_correct"), F.col(f"{b}_total"))
                - ratio(F.col(f"{a}_correct"), F.col(f"{a}_total")), 6).alias("condition_delta"),
        share(a, "hard_correct", "hard_total").alias(f"hard_accuracy_{low}"),
        F.col(f"{a}_hard_total").alias("hard_total"),
    )


def denominator_check(scored: DataFrame, run_keys: list[str] = ["run"],
                      conditions: list[str] = ["P0", "P1"]) -> DataFrame:
    """Whether every run has all conditions, each with the same, non-zero number of rows and hard rows."""
    per_file = run_condition_counts(scored, run_keys)
    whole = (
        (F.col("files") > 0) & (F.col("files") == F.col("runs") * len(conditions))
        & (F.col("min_rows") == F.col("max_rows")) & (F.col("min_hard_rows") > 0))
    return per_file.agg(
        F.count_distinct(*run_keys).alias("runs"), F.count(F.lit(1)).alias("files"),
        F.min("total").alias("min_rows"), F.max("total").alias("max_rows"),
        F.min("hard_total").alias("min_hard_rows"),
    ).withColumn("comparable", whole)


def run_gap(per_run: DataFrame, better: str, base: str, column: str,
            run_col: str = "run") -> DataFrame:
    """Difference of one measure between two runs."""
    pick = lambda r: F.max(F.when(F.col(run_col) == r, F.col(column)))
    return per_run.agg(
        pick(better).alias("better"), pick(base).alias("base"),
    ).withColumn("gap", F.round(F.col("better") - F.col("base"), 6))


def wrong_examples(scored: DataFrame, evaluation: DataFrame, keys: list[str] = ["condition"]) -> DataFrame:
    """Rows that are not equivalent, with axis labels; examples outside the eval set are kept."""
    wrong = scored.filter(~F.coalesce(F.col("result_equivalent"), F.lit(False)))
    return (
        wrong.select(*keys, "example_id", "error_class")
        .join(evaluation.select("example_id", *WRONG_LABELS), "example_id", "left")
        .select(*keys, "example_id",
                *[F.coalesce(F.col(c), F.lit("?")).alias(c) for c in WRONG_LABELS], "error_class")
    )
