"""Incremental scoring: running accuracy over scored files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from querykiln.functions.numeric import count_true, ratio
from querykiln.schemas import SCORED_RECORD

RUN_KEYS = ["condition"]


def scored_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Scored JSONL files of a folder as a stream; a malformed line stops it."""
    reader = spark.readStream.schema(SCORED_RECORD).option("mode", "FAILFAST")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def cell_verdicts(scored: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """One verdict per (keys, example): it holds only if every copy says so, in whatever order they come.

    A hash aggregation with map-side combine: an example that is delivered over and over costs
    each map task one row.
    """
    right = F.coalesce(F.col("result_equivalent"), F.lit(False))
    return scored.groupBy(*keys, "example_id").agg(F.every(right).alias("result_equivalent"))


def running_accuracy(scored: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Accuracy per key, each example counted once."""
    counts = cell_verdicts(scored, keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), count_true(F.col("result_equivalent")).alias("correct"))
    return counts.withColumn("accuracy", F.round(ratio(F.col("correct"), F.col("total")), 6))


def keep_verdicts(scored: DataFrame, out: str, checkpoint: str, keys: list[str] = RUN_KEYS) -> StreamingQuery:
    """Process what is there and add its verdicts to `out`; resume from the checkpoint.

    Each batch is a folder of its own, which a repeated batch replaces; a verdict that an earlier
    batch has is not added again, so there are at most two rows per cell.
    """
    cell = [*keys, "example_id", "result_equivalent"]

    def add(batch: DataFrame, number: int) -> None:
        new = cell_verdicts(batch, keys)
        try:
            before = batch.sparkSession.read.parquet(out).filter(F.col("batch") < number)
            new = new.join(before.select(*cell), cell, "left_anti")
        except AnalysisException:  # nothing has been written yet
            if number > 0:
                raise
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        scored.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(add).start()
    )


def latest_accuracy(spark: SparkSession, out: str, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Running accuracy over all verdicts kept so far."""
    return running_accuracy(spark.read.parquet(out), keys)
