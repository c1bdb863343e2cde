"""Consensus triage, review and quality gates of candidate sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _verdict(scored: DataFrame, name: str) -> DataFrame:
    """One verdict per example: it holds only if every record of the model says so."""
    right = F.coalesce(F.col("result_equivalent"), F.lit(False))
    return scored.groupBy("example_id").agg(F.every(right).alias(name))


def consensus_triage(candidates: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Candidates with status: accepted when both models agree with the gold result, else review."""
    both = F.coalesce("first_ok", F.lit(False)) & F.coalesce("second_ok", F.lit(False))
    return (
        candidates
        .join(_verdict(first, "first_ok"), "example_id", "left")
        .join(_verdict(second, "second_ok"), "example_id", "left")
        .withColumn("status", F.when(both, "accepted").otherwise("review"))
    )


def triage_summary(triage: DataFrame) -> DataFrame:
    return triage.groupBy("status").agg(F.count(F.lit(1)).alias("examples"))


def finalise(triage: DataFrame, approved: DataFrame, rejected: DataFrame) -> DataFrame:
    """Consensus rows and manually approved review rows, without the rejected ones."""
    said_yes = approved.select("example_id").distinct().withColumn("approved", F.lit(True))
    by = F.when(F.col("status") == "accepted", "consensus").when(
        (F.col("status") == "review") & F.col("approved"), "review")
    return (
        triage.select("example_id", "status").join(said_yes, "example_id", "left")
        .select("example_id", by.alias("accepted_by")).filter("accepted_by is not null")
        .join(rejected.select("example_id").distinct(), "example_id", "left_anti")
    )


def gate_funnel(rows: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """Survivors after each gate, in order, from a single aggregation."""
    names = list(gates)
    flags = rows.select(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in gates.items()])
    alive = F.lit(True)
    counts = [F.count(F.lit(1)).alias("_all")]
    for n in names:
        alive = alive & F.col(n)
        counts.append(F.count_if(alive).alias(f"s_{n}"))
    before = ["_all", *[f"s_{n}" for n in names]]
    cells = F.array(*[
        F.struct(F.lit(i + 1).alias("step"), F.lit(n).alias("gate"),
                 F.col(f"s_{n}").alias("survivors"),
                 (F.col(before[i]) - F.col(f"s_{n}")).alias("dropped"))
        for i, n in enumerate(names)
    ])
    return flags.agg(*counts).select(F.explode(cells).alias("g")).select("g.*")


def slots_to_regenerate(plan: DataFrame, candidates: DataFrame, report: DataFrame,
                        attempts: DataFrame | None = None, max_attempts: int | None = None) -> DataFrame:
    """Slots without a candidate and slots whose gold query failed; spent slots are left out."""
    there = candidates.select("slot_id").distinct().withColumn("there", F.lit(True))
    bad = report.filter(F.col("status") == "replace").select("slot_id").distinct().withColumn("bad", F.lit(True))
    reason = F.when(F.col("there").isNull(), "missing").when(F.col("bad"), "failed")
    out = (
        plan.select("slot_id").join(there, "slot_id", "left").join(bad, "slot_id", "left")
        .select("slot_id", reason.alias("reason")).filter("reason is not null")
    )
    if attempts is not None and max_attempts is not None:
        spent = attempts.groupBy("slot_id").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") >= max_attempts)
        out = out.join(spent.select("slot_id"), "slot_id", "left_anti")
    return out


def plan_mismatches(plan: DataFrame, candidates: DataFrame, fields: list[str]) -> DataFrame:
    """Candidates whose split, difficulty or axes differ from their slot's family."""
    wanted = plan.select("slot_id", F.struct(*fields).alias("want"))
    got = candidates.select("slot_id", F.struct(*fields).alias("got"))
    differs = F.array_compact(F.array(*[
        F.when(~F.col(f"want.{f}").eqNullSafe(F.col(f"got.{f}")), F.lit(f)) for f in fields
    ]))
    return wanted.join(got, "slot_id").select("slot_id", F.explode(differs).alias("field"))


def family_sizes(plan: DataFrame, per_family: int = 3) -> DataFrame:
    """Families that do not have exactly the planned number of slots."""
    return plan.groupBy("family").agg(F.count(F.lit(1)).alias("slots")).filter(
        F.col("slots") != per_family)


def held_out_violations(training_inputs: DataFrame, held_out: DataFrame) -> DataFrame:
    """Training rows that belong to the held-out material."""
    return training_inputs.join(held_out.select("example_id").distinct(), "example_id", "left_semi")
