"""Dataset versions, cross-set duplicates, ablation subsets and manifests."""

from __future__ import annotations

import hashlib
import itertools
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.functions.numeric import multiset_fingerprint, ratio
from querykiln.functions.text import digest
from querykiln.operators.keys import join_profile, key_profile, label_of, sft_keys
from querykiln.schemas import (
    ABLATION_SIZES, AXES, CANDIDATE_BUDGET, HOUSE_TERM_BAND, READY_QUOTA,
)

MANIFEST_IDS = 10_000  # ids that a manifest row lists; longer lists are a table of their own
CHANGES = {"fixed": "fixed_ids", "added": "added_ids", "removed": "removed_repetition_ids"}


def duplicate_values(rows: DataFrame, order_col: str = "line_number") -> DataFrame:
    """Per duplicate key kind: values held more than once, and the later copies of them."""
    profile = key_profile(sft_keys(rows, order_col))
    return profile.groupBy("kind").agg(
        F.count(F.lit(1)).alias("values"), F.sum(F.col("copies") - 1).alias("extra_copies"),
    ).select(label_of(F.col("kind")).alias("label"), "values", "extra_copies")


def leakage_hits(train: DataFrame, evaluation: DataFrame, order_col: str = "line_number") -> DataFrame:
    """Train rows whose seed, question or gold SQL is in the eval set."""
    leaking = ["seed_id", "question", "gold_sql"]
    keys, eval_keys = sft_keys(train, order_col, leaking), sft_keys(evaluation, None, leaking)
    found = join_profile(keys, key_profile(keys, eval_keys)).filter("in_eval")
    return found.select(F.col("ord").alias(order_col), "label")


def dedup_gate(rows: DataFrame, text: Column, priority: list[str], id_col: str = "example_id") -> DataFrame:
    """The one surviving row per normalised text: first by the priority columns, then by id.

    A minimum per text (combined on the map side) instead of a ranking window, so a text with
    very many copies never gathers in one task.
    """
    order = F.struct(*priority, id_col)
    marked = rows.select(digest(text).alias("_k"), order.alias("_o"))
    return (
        marked.groupBy("_k").agg(F.min("_o").alias("_o"))
        .select(*[F.col(f"_o.{c}").alias(c) for c in [*priority, id_col]])
    )


def next_version(base: DataFrame, removed: DataFrame, added: DataFrame,
                 fixed: DataFrame | None = None) -> DataFrame:
    """Base without the removed ids, with corrected rows in place of old ones, and added rows.

    An id has one row in `fixed`.
    """
    kept = base.join(removed.select("example_id").distinct(), "example_id", "left_anti").select(
        base.columns)
    if fixed is not None:
        new = fixed.select("example_id", F.struct(*base.columns).alias("new"))
        kept = kept.join(new, "example_id", "left").select(*[
            F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns])
    return kept.unionByName(added.select(base.columns))


def axis_counts(rows: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """Row counts of each value of each axis, in one scan."""
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.axis", "c.value").agg(
        F.count(F.lit(1)).alias("rows"))


def version_diff(base: DataFrame, new: DataFrame, axes: list[str] = AXES) -> DataFrame:
    """Axis counts of two versions side by side."""
    tagged = base.select(*axes, F.lit(0).alias("v")).unionByName(new.select(*axes, F.lit(1).alias("v")))
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in axes])
    return (
        tagged.select("v", F.explode(cells).alias("c")).groupBy("c.axis", "c.value")
        .agg(F.count_if(F.col("v") == 0).alias("base_rows"), F.count_if(F.col("v") == 1).alias("new_rows"))
        .withColumn("change", F.col("new_rows") - F.col("base_rows"))
    )


def version_changes(base: DataFrame, new: DataFrame, columns: list[str], id_col: str = "example_id") -> DataFrame:
    """id, change: `removed`, `added` or `fixed` (other values in `columns`) of every id that differs.

    Both versions are added up per id in one aggregation, so a repeated id costs each task a row: an id
    is the same if it has the same rows as often, in any order. A null id is an id.
    """
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    halves = [F.xxhash64(F.lit(seed), text).cast("decimal(20,0)") for seed in (0, 1)]
    tagged = base.select(id_col, F.lit(-1).alias("side"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]).unionByName(
        new.select(id_col, F.lit(1).alias("side"), *[h.alias(f"h{i}") for i, h in enumerate(halves)]))
    sums = tagged.groupBy(id_col).agg(
        F.count_if(F.col("side") < 0).alias("before"), F.count_if(F.col("side") > 0).alias("after"),
        *[F.sum(F.col("side") * F.col(h)).alias(h) for h in ("h0", "h1")])
    change = F.when(F.col("after") == 0, "removed").when(F.col("before") == 0, "added").when(
        (F.col("before") != F.col("after")) | (F.col("h0") != 0) | (F.col("h1") != 0), "fixed")
    return sums.select(id_col, change.alias("change")).where("change is not null")


def change_lists(changes: DataFrame, most: int = MANIFEST_IDS, id_col: str = "example_id") -> dict[str, list[str] | None]:
    """The ids of each change in order, as a manifest row lists them; None for more than `most` ids."""
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    out: dict[str, list[str] | None] = {}
    for change, name in CHANGES.items():
        few = counts.get(change, 0) <= most
        out[name] = sorted(str(r[0]) for r in changes.where(F.col("change") == change).select(id_col).collect()) if few else None
    return out


def change_digests(changes: DataFrame, id_col: str = "example_id") -> DataFrame:
    """One row: SHA-256 of the ids of each change in order, joined by commas; of nothing if it has none.

    All ids count, however many. A digest of a text reads it in one go, so the ids of a change pass one
    task, sorted there with spilling and never held as a list. A null id is left out.
    """
    def digests(batches):
        found: dict = {}
        for batch in batches:
            ordered = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for change, pairs in itertools.groupby(ordered, lambda pair: pair[0]):
                text = ",".join(i for _, i in pairs).encode()
                if change in found:
                    found[change].update(b"," + text)
                else:
                    found[change] = hashlib.sha256(text)
        yield pa.RecordBatch.from_pydict({
            "change": pa.array(list(found), pa.string()), "digest": pa.array([h.hexdigest() for h in found.values()], pa.string())})

    ids = changes.where(F.col(id_col).isNotNull()).select("change", F.col(id_col).cast("string").alias("id"))
    each = ids.repartition("change").sortWithinPartitions("change", "id").mapInArrow(digests, "change string, digest string")
    return each.agg(*[F.coalesce(F.max(F.when(F.col("change") == c, F.col("digest"))), F.sha2(F.lit(""), 256)).alias(name)
                      for c, name in CHANGES.items()])


def budget_check(rows: DataFrame, budget: tuple[int, int] = CANDIDATE_BUDGET) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("candidates")).withColumn(
        "within_budget", F.col("candidates").between(*budget))


def house_term_share(rows: DataFrame, band: tuple[float, float] = HOUSE_TERM_BAND) -> DataFrame:
    """Share of house-term questions and whether it lies in the band."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("axis_terminology") == "house_term").alias("house_terms"))
    share = ratio(F.col("house_terms"), F.col("total"))
    return counts.select("total", "house_terms", F.round(share, 6).alias("share"),
                         share.between(*band).alias("within_band"))


def stratum_quotas(sizes: list[int], target: dict[str, int]) -> dict[int, dict[str, int]]:
    """Per-stratum share of each size by largest remainder; grows with the size, so sets nest."""
    whole = sum(target.values())
    out = {}
    for size in sizes:
        exact = {k: size * v / whole for k, v in target.items()}
        quota = {k: math.floor(x) for k, x in exact.items()}
        by_rest = sorted(target, key=lambda k: (quota[k] - exact[k], list(target).index(k)))
        for k in by_rest[: size - sum(quota.values())]:
            quota[k] += 1
        out[size] = quota
    return out


def ablation_subsets(rows: DataFrame, seed: str = "0", sizes: list[int] = ABLATION_SIZES,
                     target: dict[str, int] = READY_QUOTA, stratum: str = "difficulty") -> DataFrame:
    """Nested, stratified subsets: each chosen example with the smallest subset that has it.

    The constant rank filter lets Spark keep only the first rows of each stratum in every map
    task before the shuffle, so a stratum with most of the data stays small.
    """
    quotas = stratum_quotas(sorted(sizes), target)
    most = max(q for per in quotas.values() for q in per.values())
    draw = F.sha2(F.concat(F.lit(seed), F.col("example_id")), 256)
    order = Window.partitionBy(stratum).orderBy("draw", "example_id")
    ranked = (
        rows.filter(F.col(stratum).isin(list(target)))
        .select("example_id", stratum, draw.alias("draw"))
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    )
    smallest = F.lit(None).cast("int")
    for size in sorted(sizes, reverse=True):
        fits = F.lit(False)
        for level, n in quotas[size].items():
            fits = fits | ((F.col(stratum) == level) & (F.col("rank") <= n))
        smallest = F.when(fits, F.lit(size)).otherwise(smallest)
    return ranked.select("example_id", stratum, smallest.alias("smallest_subset")).filter(
        "smallest_subset is not null")


def dataset_manifest(rows: DataFrame, version: str, row_text: Column, axes: list[str] = AXES,
                     ids: dict[str, list[str] | None] | None = None) -> DataFrame:
    """One row: version, counts per axis value as maps, the content fingerprint, and lists of ids (or null)."""
    totals = rows.agg(F.count(F.lit(1)).alias("total"), multiset_fingerprint(row_text).alias("digest"))
    cells = axis_counts(rows, axes).unionByName(totals, allowMissingColumns=True)
    counts_of = lambda a: F.map_from_entries(F.array_sort(F.collect_list(
        F.when((F.col("axis") == a) & F.col("value").isNotNull(), F.struct("value", "rows")))))
    manifest = cells.agg(
        F.lit(version).alias("version"), F.max("total").alias("selected_candidates"),
        *[counts_of(a).alias(a.removeprefix("axis_")) for a in axes],
        F.max("digest").alias("candidate_sha256"))
    for name, values in (ids or {}).items():
        manifest = manifest.withColumn(
            name, F.lit(None).cast("array<string>") if values is None else
            F.array(*[F.lit(v) for v in values]).cast("array<string>"))
    return manifest


def step_plan(rows: DataFrame, accumulation: int = 8, epochs: float = 3.0,
              max_steps: int = -1) -> DataFrame:
    """Optimiser and warm-up steps that a dataset of this size leads to."""
    steps = (
        F.lit(max_steps) if max_steps > 0
        else F.ceil(F.ceil(F.col("records") / F.lit(accumulation)) * F.lit(epochs))
    ).cast("bigint")
    warmup = F.when(F.col("planned_steps") < 20, 0).otherwise(
        F.greatest(F.lit(1), F.bround(F.col("planned_steps") * F.lit(0.03)).cast("int")))
    return (
        rows.agg(F.count(F.lit(1)).alias("records")).withColumn("planned_steps", steps)
        .withColumn("warmup_steps", warmup.cast("bigint"))
    )


def fingerprint(rows: DataFrame, row_text: Column) -> DataFrame:
    """Rows and order-independent content digest of a dataset."""
    return rows.agg(F.count(F.lit(1)).alias("records"),
                    multiset_fingerprint(row_text).alias("fingerprint"))


def file_sha256(spark: SparkSession, path: str) -> DataFrame:
    """Byte-exact digest of each file, for single dataset files as published in manifests."""
    return spark.read.format("binaryFile").load(path).select(
        "path", "length", F.sha2("content", 256).alias("sha256"))
