"""Token lengths of rendered conversations."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions.text import through_marker, word_count
from querykiln.operators.selection import values_at, values_by_group
from querykiln.session import kept

ASSISTANT_MARKER = "<|im_start|>assistant\n"
FRACTIONS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def tokenizer_counter(encode_batch: Callable) -> Callable[[Column], Column]:
    """Token counter from a user's tokenizer: `encode_batch(list[str]) -> list[int]` lengths.

    Runs as an Arrow-batched pandas UDF; the default `word_count` needs no Python.
    """

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(encode_batch(texts.tolist()), dtype="int64")

    return count


def token_lengths(rendered: DataFrame, text_col: str = "text", marker: str = ASSISTANT_MARKER,
                  counter: Callable[[Column], Column] = word_count) -> DataFrame:
    """Adds the whole length and the length up to the answer; a missing marker fails."""
    prefix = F.coalesce(
        through_marker(F.col(text_col), marker),
        F.raise_error(F.lit("assistant marker is missing")).cast("string"),
    )
    return rendered.withColumns({
        "tokens": counter(F.col(text_col)), "prefix_tokens": counter(prefix),
    }).withColumn("supervised_tokens", F.col("tokens") - F.col("prefix_tokens"))


def nearest_rank(rows: DataFrame, value: str, fractions: dict[str, float] = FRACTIONS,
                 by: list[str] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """Sorted value at index round((n-1)*f), half to even, per group, with total and extra sums.

    Ranks are found by counting ranges of values, so neither the rows nor the distinct values are ever in
    one place. `sums` are aggregates that ride along in the first pass.
    """
    by, sums = by or [], sums or {}
    totals = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.min(value).alias("min"), F.max(value).alias("max"),
        F.sum(value).alias("total"), *[c.alias(name) for name, c in sums.items()])
    index = lambda f: F.bround((F.col("records") - 1) * F.lit(f)).cast("bigint")
    if not by:
        totals = kept(totals, "ranks")
        n = totals.first()["records"]
        ranks = list(totals.select(*[index(f) for f in fractions.values()]).first()) if n else [-1] * len(fractions)
        picks = dict(zip(fractions, values_at(rows, value, ranks), strict=True))
        kind = rows.schema[value].dataType
        return totals.select("records", "min", *[F.lit(v).cast(kind).alias(name) for name, v in picks.items()],
                             "max", "total", *sums)
    totals = kept(totals, "ranks")
    wanted = totals.select(*by, F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), index(f).alias("rank")) for name, f in fractions.items()])).alias("w"),
        F.col("min").alias("lo"), F.col("max").alias("hi")).select(*by, "w.name", "w.rank", "lo", "hi")
    found = values_by_group(rows, value, wanted, by).groupBy(*by).agg(
        *[F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in fractions])
    found = found.select(*[F.col(c).alias(f"key_{c}") for c in by], *fractions)
    return totals.join(found, [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in by]).select(
        *by, "records", "min", *fractions, "max", "total", *sums)


def token_length_report(lengths: DataFrame, limit: int) -> DataFrame:
    """Distribution of lengths and how many records a length limit would hurt; one pass."""
    report = nearest_rank(lengths, "tokens", sums={
        "over_limit": F.count_if(F.col("tokens") > limit),
        "no_response_tokens": F.count_if(F.col("prefix_tokens") >= limit),
    })
    return report.select(
        "records", "min", *FRACTIONS, "max", "over_limit",
        F.col("over_limit").alias("response_truncated"), "no_response_tokens")


def supervised_summary(lengths: DataFrame) -> DataFrame:
    """Records, supervised tokens in total, and records without any."""
    return lengths.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum("supervised_tokens"), F.lit(0)).alias("supervised_tokens"),
        F.count_if(F.col("supervised_tokens") <= 0).alias("without_supervision"),
    )
