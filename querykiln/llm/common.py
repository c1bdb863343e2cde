"""Helpers the operators of this folder share: tables, written intermediates, Arrow passes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.session import shared_folder

SPACED_WORD = r"[^\x20\x09-\x0D]+"
BATCH_BYTES = "4m"  # of rows that Spark and a Python worker pass each other at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write `df` to a new folder of the shared storage and read it back: lineage ends here."""
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches have up to BATCH_BYTES, however many rows that is.

    Spark's own limit, 10,000 rows or 64 MB, has each task hold some 25 MB of texts several times over, outside
    the heap and in its Python worker. The setting stays with the session: plans run when they are written.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def gives_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`run` over the batches of a task; then the memory that it freed goes back to the system.

    Workers stay for later tasks, and what one task needed at its peak would stay with them.
    """
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return whole


def thinned(rows: DataFrame, h: Column, share: Column | float) -> DataFrame:
    """An even share of the rows by their hash, picked where they are; all rows if the share is 1 or more.

    What is left to be ordered for a bounded sample is then a few times the sample, not one sample
    from every task.
    """
    return rows.where(F.pmod(h, F.lit(1 << 30)) < F.lit(float(1 << 30)) * share)


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """`df` with columns c0, c1 and so on, which no result column is named like, and its names for them."""
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def arrow_columns(df: DataFrame, inputs: dict[str, Column | str], schema: str,
                  open_task: Callable[[], Callable[[dict[str, list]], Iterable[tuple]]]) -> DataFrame:
    """`df` with new columns computed in Python, one Arrow batch at a time.

    `open_task` runs once per task and returns a function from a batch (input name -> values)
    to one tuple per row, in the order of `schema`. Every column of `df` is carried along as it
    is; a column whose name is also in `schema` gives way to the new one. An input that is the name
    of a column is read where it is carried, and a text as bytes; another one is handed over besides.
    """
    spark = df.sparkSession
    added = spark.createDataFrame([], schema).schema
    arrow = _arrow_schema(spark, added)
    carried = {name: df.columns.index(c) for name, c in inputs.items() if isinstance(c, str)}
    beside = [name for name in inputs if name not in carried]
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("kept"),
                       *[inputs[name].alias(f"in_{name}") for name in beside])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = open_task()
        for batch in batches:
            values = {n: batch.column(i + 1).to_pylist() for i, n in enumerate(beside)}
            for n, i in carried.items():
                field = batch.column(0).field(i)
                values[n] = (field.cast(pa.binary()) if pa.types.is_string(field.type) else field).to_pylist()
            rows = list(compute(values))
            columns = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], names=["kept", *(f"out_{f.name}" for f in arrow)])

    out = packed.mapInArrow(
        gives_back(run), "kept " + packed.schema["kept"].dataType.simpleString() + ", "
        + ", ".join(f"out_{f.name} {f.dataType.simpleString()}" for f in added))
    taken = {f.name.lower() for f in added}
    return out.select(*[F.col(f"kept.`{c}`") for c in df.columns if c.lower() not in taken],
                      *[F.col(f"out_{f.name}").alias(f.name) for f in added])


def _arrow_schema(spark: SparkSession, schema) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))
