"""An append-only store of generation records in which each key stands once.

A batch is staged as files below `data/batch=...`, one folder a condition, and counts from the moment its
entry is in `commits`. A job that was killed leaves files without an entry, which nobody reads; run again,
it stages anew what is not committed yet. One writer at a time is expected: two at once can both commit a
key, which the next append or resume reports and stops at.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from querykiln.operators.grid import KEY, resume_violations


def committed(spark: SparkSession, store: str) -> list[str]:
    """The committed batches; a store that does not exist yet has none."""
    try:
        # The partition column is of folders that hold a file: a folder alone is no commit.
        log = spark.read.schema("rows bigint, batch string").parquet(f"{store}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["batch"] for r in log.select("batch").distinct().collect())


def _batches(spark: SparkSession, store: str, batches: list[str]):
    return spark.read.option("basePath", f"{store}/data"), [f"{store}/data/batch={b}" for b in batches]


def read_records(spark: SparkSession, store: str) -> DataFrame | None:
    """All committed records, or None; a filter on `condition` reads only its folders."""
    batches = committed(spark, store)
    if not batches:
        return None
    reader, paths = _batches(spark, store, batches)
    return reader.parquet(*paths).drop("batch")


def stage(rows: DataFrame, store: str) -> str:
    batch = uuid.uuid4().hex
    rows.write.partitionBy("condition").parquet(f"{store}/data/batch={batch}")
    return batch


def commit(spark: SparkSession, store: str, batch: str, rows: int) -> None:
    """One file of one row: it is there or not. Committing a batch again changes nothing."""
    spark.createDataFrame([(rows,)], "rows bigint").coalesce(1).write.mode("append").parquet(f"{store}/commits/batch={batch}")


def check(records: DataFrame | None, conditions: list[str]) -> None:
    """Records of other conditions, or of one key twice, stop a job."""
    wrong = resume_violations(records, conditions).first() if records is not None else None
    if wrong is not None:
        raise ValueError(f"record {wrong['condition']}/{wrong['example_id']}: {wrong['problem']}")


def append_records(rows: DataFrame, store: str, conditions: list[str]) -> int:
    """Commit the rows whose key has no record yet; how many that were.

    Old records, and then the new ones, must pass `check`; what does not is staged but never committed.
    """
    spark = rows.sparkSession
    old = read_records(spark, store)
    check(old, conditions)
    if old is not None:
        rows = rows.join(old.select(*KEY), KEY, "left_anti")
    batch = stage(rows, store)
    reader, paths = _batches(spark, store, [batch])
    staged = reader.schema(rows.schema).parquet(*paths)
    check(staged, conditions)
    n = staged.count()
    if n:
        commit(spark, store, batch, n)
    return n
