"""Execution equivalence of result sets, and what follows from verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def result_row(columns: list[Column], scale: int | None = None,
               floats: set[int] = frozenset(), position: Column | None = None) -> Column:
    """A result row as one comparable value.

    Columns count by position, not by name; NULL equals NULL; floating columns (given by
    index) are rounded; with `position` the order of rows matters as well.
    """
    values = [F.round(c, scale) if i in floats and scale is not None else c
              for i, c in enumerate(columns)]
    fields = [v.alias(f"c{i}") for i, v in enumerate(values)]
    if position is not None:
        fields = [position.alias("pos"), *fields]
    return F.struct(*fields)


def equivalence(gold: DataFrame, predicted: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """Multiset equality of `(example_id, row)` results per example.

    Gold rows count +1 and predicted rows -1; an example is equivalent when every row sums to
    zero. Both steps are hash aggregations with map-side combine, so neither a huge result nor
    one row repeated many times gathers in a task. Examples with no row on either side are
    only known from `examples`; no predicted row there equals no gold row.
    """
    signed = gold.select("example_id", "row", F.lit(1).alias("s")).unionByName(
        predicted.select("example_id", "row", F.lit(-1).alias("s")))
    per_row = signed.groupBy("example_id", "row").agg(
        F.sum("s").alias("balance"), F.count_if(F.col("s") == 1).alias("g"),
        F.count_if(F.col("s") == -1).alias("p"))
    verdict = per_row.groupBy("example_id").agg(
        F.sum("g").alias("gold_rows"), F.sum("p").alias("predicted_rows"),
        (F.count_if(F.col("balance") != 0) == 0).alias("result_equivalent"))
    if examples is None:
        return verdict
    return examples.select("example_id").distinct().join(verdict, "example_id", "left").select(
        "example_id",
        F.coalesce("gold_rows", F.lit(0)).alias("gold_rows"),
        F.coalesce("predicted_rows", F.lit(0)).alias("predicted_rows"),
        F.coalesce("result_equivalent", F.lit(True)).alias("result_equivalent"))


def with_failures(verdicts: DataFrame, failed: DataFrame) -> DataFrame:
    """Predictions that are missing or did not run are never equivalent."""
    marked = verdicts.join(failed.select("example_id").distinct().withColumn("_failed", F.lit(True)),
                           "example_id", "left")
    return marked.withColumn(
        "result_equivalent", F.col("result_equivalent") & F.col("_failed").isNull()).drop("_failed")


def tables_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that two whole tables do not share, with multiplicity."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right")))


def gold_gate(slots: DataFrame, gold: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rows per gold query; a query that failed or returned nothing marks its slot for replacement."""
    counts = gold.groupBy("example_id").agg(F.count(F.lit(1)).alias("rows"))
    report = slots.select("example_id").join(counts, "example_id", "left").select(
        "example_id", F.coalesce("rows", F.lit(0)).alias("rows"))
    if failed is not None:
        report = report.join(
            failed.select("example_id").distinct().withColumn("_failed", F.lit(True)),
            "example_id", "left",
        ).withColumn("rows", F.when(F.col("_failed"), F.lit(0)).otherwise(F.col("rows"))).drop("_failed")
    return report.withColumn("status", F.when(F.col("rows") > 0, "ok").otherwise("replace"))
