"""Scored files laid out as scope/run/condition.jsonl, and the run registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.schemas import SCORED_RECORD
from querykiln.sources.jsonl import parse_json, read_lines

_LAYOUT = r"([^/]+)/([^/]+)/([^/]+)\.jsonl$"

LAYOUT = ["scope", "run", "file_condition"]


def read_scored(spark: SparkSession, root: str) -> DataFrame:
    """All scored records below `root` in one scan; scope, run and condition from the path."""
    lines = read_lines(spark, f"{root.rstrip('/')}/*/*/*.jsonl")
    path = F.col("ordinal.file")
    return lines.select(
        F.regexp_extract(path, _LAYOUT, 1).alias("scope"),
        F.regexp_extract(path, _LAYOUT, 2).alias("run"),
        F.upper(F.regexp_extract(path, _LAYOUT, 3)).alias("file_condition"),
        "ordinal",
        parse_json(F.col("raw"), SCORED_RECORD).alias("r"),
    ).select("scope", "run", "file_condition", "ordinal", "r.*")


def save_runs(scored: DataFrame, path: str) -> None:
    """Scored records as a store with a folder for each scope, run and condition."""
    scored.write.mode("errorifexists").partitionBy(*LAYOUT).parquet(path)


def open_runs(spark: SparkSession, path: str, registry: DataFrame | None = None,
              conditions: list[str] | None = None) -> DataFrame:
    """Records of a store; with a registry only of its runs, and only of the given conditions.

    Conditions prune folders when the query is planned; the registry, which may be filtered, does when
    it runs. Nothing else is opened.
    """
    scored = spark.read.parquet(path)
    if conditions:
        scored = scored.where(F.col("file_condition").isin(conditions))
    if registry is not None:
        scored = scored.join(registry.select("scope", "run").distinct(), ["scope", "run"])
    return scored


def unregistered_runs(scored: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs and conditions that were read but are in no registry, with their number of records."""
    found = scored.groupBy(*LAYOUT).agg(F.count(F.lit(1)).alias("records"))
    return found.join(registry.select("scope", "run"), ["scope", "run"], "left_anti").select(*LAYOUT, "records")


def missing_files(scored: DataFrame, registry: DataFrame, conditions: list[str]) -> DataFrame:
    """Registered runs and conditions for which no record was read."""
    wanted = registry.select(
        "scope", "run", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("file_condition"))
    there = scored.select("scope", "run", "file_condition").distinct()
    return wanted.join(there, ["scope", "run", "file_condition"], "left_anti")


def with_run_labels(per_run: DataFrame, registry: DataFrame) -> DataFrame:
    """Registry label, group and order for per-run results; unknown runs are dropped."""
    return per_run.join(registry, ["scope", "run"])
