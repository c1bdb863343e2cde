"""Output folders: refuse or manifest; appended records have a store of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object per line, non-ASCII kept; an existing output is never replaced."""
    rows.write.mode("errorifexists").json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """The one-row manifest as a single JSON file."""
    manifest.coalesce(1).write.mode("errorifexists").json(path)
