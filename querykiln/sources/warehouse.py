"""Loading and opening the eight warehouse tables.

A load writes all its tables below a new folder of `versions` and then adds one file to `commits`,
which says for each table the version that counts. Readers see the tables of the last commit, so a load
that fails at any table, or is killed, changes nothing. One loader at a time is expected; two at once
that commit the same number are reported by the next reader.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.schemas import WAREHOUSE


@dataclass(frozen=True)
class Warehouse:
    """The tables the metrics read; each is a lazy DataFrame."""

    orders: DataFrame
    order_items: DataFrame
    products: DataFrame | None = None
    categories: DataFrame | None = None
    customers: DataFrame | None = None
    channels: DataFrame | None = None
    returns: DataFrame | None = None
    dim_date: DataFrame | None = None


def read_seed_csv(spark: SparkSession, table: str, path: str) -> DataFrame:
    return (
        spark.read.schema(WAREHOUSE[table]).option("header", True).option("mode", "FAILFAST")
        .csv(path)
    )


def load_seed(spark: SparkSession, csv_dir: str, out_dir: str,
              tables: list[str] | None = None) -> None:
    """Fully replace each table by its CSV, all of them at once; other tables keep their version."""
    number, versions = current_versions(spark, out_dir)
    version = uuid.uuid4().hex
    for table in tables or list(WAREHOUSE):
        read_seed_csv(spark, table, f"{csv_dir}/{table}.csv").write.parquet(_path(out_dir, table, version))
        versions = {**versions, table: version}
    rows = [(number + 1, table, name) for table, name in sorted(versions.items())]
    spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{out_dir}/commits")


_COMMIT = "number bigint, table_name string, version string"


def _path(directory: str, table: str, version: str | None) -> str:
    return f"{directory}/versions/{version}/{table}" if version else f"{directory}/{table}"


def current_versions(spark: SparkSession, directory: str, number: int | None = None) -> tuple[int, dict[str, str]]:
    """The last commit (or that of a number) and the version of each table; (0, {}) where there is none."""
    try:
        log = spark.read.schema(_COMMIT).parquet(f"{directory}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], _COMMIT)
    last = log.agg(F.max("number")).first()[0] if number is None else number
    rows = [] if last is None else log.where(F.col("number") == last).collect()
    versions = {r["table_name"]: r["version"] for r in rows}
    if len(versions) < len(rows):
        raise ValueError(f"{directory}: commit {last} was made twice")
    if number is not None and not rows:
        raise ValueError(f"{directory}: no commit {number}")
    return (last or 0), versions


def open_table(spark: SparkSession, directory: str, table: str, versions: dict[str, str]) -> DataFrame:
    return spark.read.parquet(_path(directory, table, versions.get(table)))


def open_warehouse(spark: SparkSession, directory: str, number: int | None = None) -> Warehouse:
    """The tables of one commit, the last unless a number is given; plain table folders where there is no commit."""
    _, versions = current_versions(spark, directory, number)
    return Warehouse(**{t: open_table(spark, directory, t, versions) for t in WAREHOUSE})


BUCKET_KEYS = {"orders": "order_id", "order_items": "order_id", "products": "product_id"}


def save_bucketed(wh: Warehouse, path: str, buckets: int, database: str = "default") -> None:
    """Store the big tables bucketed on their join key, so the fact join needs no exchange.

    Rows are spread by the key before writing, so each bucket is one file and not one per task.
    """
    for name, key in BUCKET_KEYS.items():
        table = getattr(wh, name)
        if table is not None:
            (table.repartition(buckets, key).write.mode("overwrite").option("path", f"{path}/{name}")
             .bucketBy(buckets, key).sortBy(key).saveAsTable(f"{database}.{name}"))


def open_bucketed(spark: SparkSession, wh: Warehouse, database: str = "default") -> Warehouse:
    """The warehouse with its big tables read from their bucketed copies."""
    stored = {n: spark.table(f"{database}.{n}") for n in BUCKET_KEYS if getattr(wh, n) is not None}
    return replace(wh, **stored)
