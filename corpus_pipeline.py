"""From raw documents to a training mix, in five stages; and all training-text queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from querykiln.llm import decontamination, minhash_dedup, mixing, quality, secret_scan
from querykiln.llm.common import small_batches, stored, table
from querykiln.llm.registry import QUERIES as OPERATORS


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def in_small_batches(stage: Stage) -> Stage:
    """The stages follow each other on the same executors, which keep what the largest batches took."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones among them, does not reject."""
    labels = table(spark, sf_dir, "labels")
    texts = quality.trusted_texts(docs, quality.trusted_ids(labels), toxic=quality.toxic_ids(labels))
    return quality.keep_good(docs, quality.fit(texts))


@in_small_batches
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id."""
    return minhash_dedup.keep_first(docs, common=minhash_dedup.NO_LEAST)


@in_small_batches
def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are masked, and n_chars follows."""
    return secret_scan.redact(docs, secret_scan.fit(docs, lang="lang"))


@in_small_batches
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their share of the mix: size, source_size, target, taken, draws."""
    return mixing.mix(docs)


STAGES = [("quality", good_quality), ("near duplicates", one_of_each), ("decontamination", uncontaminated),
          ("secrets", without_secrets), ("mixing", mixed)]

# Sampled similarities, trees and language models have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written before the next begins, but the last."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**OPERATORS, "pipeline": (run, ORACLE_SQL)}
