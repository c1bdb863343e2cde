"""JSON-lines and JSON-document sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.functions.text import strip
from querykiln.schemas import CONDITIONS, EVAL_BUNDLE, SFT_CANDIDATE, SFT_REQUIRED_KEYS

FAILFAST = {"mode": "FAILFAST"}
ROW_MASK = (1 << 33) - 1


def parse_json(raw: Column, schema: str) -> Column:
    """Parsed record; malformed JSON fails the job, as a loader should."""
    return F.from_json(raw, schema, FAILFAST)


def missing_keys(raw: Column, required: list[str]) -> Column:
    """Sorted required keys that the JSON text lacks. A key holding null is present.

    Text that is no JSON object lacks them all.
    """
    wanted = F.array(*[F.lit(k) for k in required])
    return F.array_sort(F.coalesce(F.array_except(wanted, F.json_object_keys(raw)), wanted))


def read_lines(spark: SparkSession, path, batch: int = 0) -> DataFrame:
    """Non-blank lines `(raw, ordinal)`; ordinals sort like the lines of the files.

    The ordinal is (batch, file, block, row), because row ids alone do not follow file order
    once several splits share a task. `row` counts the lines a task has read; the task's own
    number, which differs between plans, is masked out.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    ).filter(strip(F.col("raw")) != "")
    return lines.select(
        "raw", F.struct(F.lit(batch).alias("batch"), "file", "block",
                        F.monotonically_increasing_id().bitwiseAND(ROW_MASK).alias("row")).alias("ordinal"))


def read_jsonl(spark: SparkSession, path, schema: str, required: list[str] | None = None,
               batch: int = 0) -> DataFrame:
    """Typed records with their ordinal, and `missing_keys` if keys are required."""
    lines = read_lines(spark, path, batch)
    columns = [F.col("ordinal"), parse_json(F.col("raw"), schema).alias("r")]
    if required:
        columns.append(missing_keys(F.col("raw"), required).alias("missing_keys"))
    extra = ["missing_keys"] if required else []
    return lines.select(*columns).select("ordinal", *extra, "r.*")


def read_sft(spark: SparkSession, path, batch: int = 0) -> DataFrame:
    return read_jsonl(spark, path, SFT_CANDIDATE, SFT_REQUIRED_KEYS, batch)


def read_sft_batches(spark: SparkSession, data: str, known: list[str]) -> DataFrame:
    """Candidates with the known files in front; each further one goes before the earlier ones."""
    paths = [*reversed(known), data]
    rows = read_sft(spark, paths[0], 0)
    for batch, path in enumerate(paths[1:], 1):
        rows = rows.unionByName(read_sft(spark, path, batch))
    return rows


def line_numbers(found: DataFrame, lines: DataFrame, name: str = "line_number") -> DataFrame:
    """Consecutive numbers, over all batches and files, for rows that carry an ordinal.

    A block is read by one task, so a row's place in it is the distance of its id to the
    block's first id; blocks before it add their row counts. Only this table of one row per
    block is ordered, and the records themselves are never moved to be numbered.
    """
    block = ["batch", "file", "block"]
    parts = [F.col(f"ordinal.{b}").alias(b) for b in block]
    before = Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        lines.select(*parts, F.col("ordinal.row").alias("row")).groupBy(*block)
        .agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
        .select(*block, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    number = F.col("shift") + F.col("ordinal.row") - F.col("first") + 1
    return (
        found.select("*", *parts).join(blocks, block).withColumn(name, number)
        .drop(*block, "first", "shift")
    )


def ingest_sft(spark: SparkSession, path: str, out: str) -> None:
    """Parquet copy of a candidate file with plain line numbers.

    Later checks then read only the columns they need and order by a number instead of an ordinal;
    `raw` keeps the line with all its fields.
    """
    lines = read_lines(spark, path)
    rows = lines.select(
        "ordinal", "raw", missing_keys(F.col("raw"), SFT_REQUIRED_KEYS).alias("missing_keys"),
        parse_json(F.col("raw"), SFT_CANDIDATE).alias("r")).select("ordinal", "raw", "missing_keys", "r.*")
    line_numbers(rows, lines).drop("ordinal").write.mode("errorifexists").parquet(out)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row `(text)` for a whole template or context file."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The eval bundle as one row; checked to hold the three contexts and an example."""
    bundle = spark.read.schema(EVAL_BUNDLE).json(path, multiLine=True, mode="FAILFAST")
    expected = F.array(*[F.lit(c) for c in CONDITIONS])
    good = (F.array_sort(F.map_keys("contexts")) == expected) & (F.size("examples") > 0)
    return bundle.filter(
        F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.lit("expected a non-empty bundle with contexts P0, P1 and P2"))
            .cast("boolean")
        )
    )


def bundle_examples(bundle: DataFrame) -> DataFrame:
    """One row per example, with its position, template, contexts and versions."""
    return bundle.select(
        F.posexplode("examples").alias("position", "example"),
        "contexts", "prompt_template", "prompt_version", "eval_version",
    ).select("position", "example.*", "contexts", "prompt_template", "prompt_version",
             "eval_version")
