"""Mixing sources to target sizes, by a multivariate-hypergeometric splitting tree.

Every source is dealt into blocks of a few hundred documents. A target is so many whole passes over
the source plus the first blocks of a permuted order, cut exactly where the target is met. These
block draws are the source's quota. A binary tree over the output shards splits the quotas: at
each node the draws of the left half follow a multivariate hypergeometric law, so shards have equal
numbers of draws and random shares of the sources. A leaf's quota is the next run of the source's
permuted blocks, so no two shards hold the same draw, and each shard is shuffled by itself.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.llm.common import SPACED_WORD, arrow_columns, stored, table

WEIGHTS = (3.0, 1.0, 2.0)  # of the sources in code point order, null last; repeating
SHARE = 1.5                # of all words that the mix takes
MAX_REPEATS = 2.0          # times a source's size that its target may reach
BLOCK_DOCS = 256
SHARDS = 64
SEED = 8

RESULT = ("size bigint, source_size bigint, target double, taken bigint, "
          "draws array<struct<shard:int,slot:bigint,words:bigint>>")


@dataclass
class SourcePlan:
    size: int
    target: float
    blocks: int
    step: int            # block -> rank in permuted order: (block * step + shift) mod blocks
    shift: int
    passes: int          # whole passes over the source
    rest: int            # words of the pass that is cut
    cut_rank: int = 0    # blocks of a smaller rank are in the cut pass
    cut_hash: int = -(1 << 63)  # in the block at cut_rank: documents of a smaller hash are in it
    cut_words: int = 0   # and of each document with this hash so many words
    shard_ends: list[int] | None = None


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MAX_REPEATS) -> list[float]:
    """Shares of `share` x all sizes by weight; what is above `most` x a size is shared anew."""
    out = [0.0] * len(sizes)
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free = share * sum(sizes), set(range(len(sizes)))
    while free:
        unit = left / sum(weight[i] for i in sorted(free))
        full = [i for i in sorted(free) if unit * weight[i] > most * sizes[i]]
        for i in full or sorted(free):
            out[i] = most * sizes[i] if full else unit * weight[i]
            left -= out[i]
            free.discard(i)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Draws per shard and source: equal sums over sources for each shard (give or take one)."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = sum(quotas)
    capacity = [total * (j + 1) // shards - total * j // shards for j in range(shards)]

    def node(first: int, last: int, have: np.ndarray) -> None:
        if last - first == 1:
            out[first] = have
            return
        middle = (first + last) // 2
        rng = np.random.default_rng([seed, first, last])
        left = rng.multivariate_hypergeometric(have, sum(capacity[first:middle]), method="marginals")
        node(first, middle, left)
        node(middle, last, have - left)

    if len(quotas):
        node(0, shards, np.array(quotas, dtype=np.int64))
    return out


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        shards: int = SHARDS, block_docs: int = BLOCK_DOCS, seed: int = SEED) -> DataFrame:
    """`docs` with size, source_size, target (of the source), taken and draws (shard, slot, words).

    A null text has size 0; a null source is a source of its own, the last. `taken` is the sum of
    the draws' words, at most twice the size; the words taken of a source are its target rounded
    down, less what rounding costs where several rows share one id at the cut. The same rows give
    the same mix in any order and partitioning; repeated rows are drawn alike. A result column
    replaces one of its name. One row per source comes to the driver: a mix has a weight for each.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.lit(seed), F.col(f"`{doc_id}`"))
    name = F.col(f"`{source}`").cast("string")
    sized = stored(docs.select(name.alias("source"), h.alias("h"), word_count(F.col(f"`{text}`")).alias("words")),
                   "mix-sizes")
    plans = _plan(spark, sized, block_docs, seed)
    for plan, column in zip(plans.values(), split_quotas(
            [_quota(p) for p in plans.values()], shards, seed).T, strict=True):
        plan.shard_ends = np.cumsum(column).tolist()
    held = spark.sparkContext.broadcast(plans)

    def open_task():
        plans = held.value

        def one(source, h, words, slot):
            p = plans[source]
            rank = _rank(p, h)
            draws = [(_shard(p, k * p.blocks + rank), slot ^ k, words) for k in range(p.passes) if words]
            part = words if rank < p.cut_rank or rank == p.cut_rank and h < p.cut_hash else (
                min(words, p.cut_words) if rank == p.cut_rank and h == p.cut_hash else 0)
            if part:
                draws.append((_shard(p, p.passes * p.blocks + rank), slot ^ p.passes, part))
            draws = [{"shard": a, "slot": b, "words": c} for a, b, c in draws]
            return words, p.size, p.target, sum(d["words"] for d in draws), draws

        return lambda b: map(one, b["source"], b["h"], b["words"], b["slot"])

    return arrow_columns(docs, {"source": name, "h": h, "words": word_count(F.col(f"`{text}`")),
                                "slot": F.xxhash64(F.lit(seed + 1), h)}, RESULT, open_task)


def _rank(p: SourcePlan, h: int) -> int:
    return (h % p.blocks * p.step + p.shift) % p.blocks


def _shard(p: SourcePlan, draw: int) -> int:
    return bisect_right(p.shard_ends, draw)


def _quota(p: SourcePlan) -> int:
    cut = p.cut_words > 0 or p.cut_hash > -(1 << 63)
    return p.passes * p.blocks + p.cut_rank + cut


def _plan(spark: SparkSession, sized: DataFrame, block_docs: int, seed: int) -> dict[str | None, SourcePlan]:
    """Where each source's target is met: first the run of blocks, then the block, then the document."""
    rows = sized.groupBy("source").agg(F.sum("words").alias("size"), F.count("*").alias("n")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    plans: dict[str | None, SourcePlan] = {}
    for i, (row, target) in enumerate(zip(rows, targets([r["size"] for r in rows]), strict=True)):
        blocks = max(1, -(-row.n // block_docs))
        rng = np.random.default_rng([seed, i, blocks])
        step = int(rng.integers(1, blocks + 1))
        while math.gcd(step, blocks) != 1:
            step = step % blocks + 1
        words = int(target)
        passes = words // row["size"] if row["size"] else 0
        plans[row.source] = SourcePlan(row["size"], target, blocks, step, int(rng.integers(blocks)), passes,
                                       words - passes * row["size"])
    plan = spark.createDataFrame(
        [(s, p.blocks, p.step, p.shift, p.rest) for s, p in plans.items() if p.rest],
        "name string, blocks long, step long, shift long, rest long")
    ranked = sized.join(plan, F.col("source").eqNullSafe(F.col("name"))).withColumn(
        "rank", F.expr("pmod(pmod(h, blocks) * step + shift, blocks)"))
    # Sums over runs of 1,024 blocks first, so that no window holds more than a few thousand rows
    # of a source, however many blocks it has.
    runs = _first_to_reach(ranked, F.floor(F.col("rank") / 1024), F.col("rest"))
    found = {r.source: (r.key, r.before) for r in runs.collect()}
    for level in ("rank", "h"):
        at = spark.createDataFrame([(s, k, b) for s, (k, b) in found.items()],
                                   "at_name string, at long, before long")
        inside = F.floor(F.col("rank") / 1024) if level == "rank" else F.col("rank")
        part = ranked.join(at, F.col("source").eqNullSafe(F.col("at_name")) & (inside == F.col("at")))
        cuts = _first_to_reach(part, F.col(level), F.col("rest") - F.col("before")).collect()
        already = {s: b for s, (_, b) in found.items()}
        for r in cuts:
            p = plans[r.source]
            if level == "rank":
                p.cut_rank = r.key
            else:
                p.cut_hash = r.key
                p.cut_words = (p.rest - already[r.source] - r.before) // r.n
        found = {r.source: (r.key, already[r.source] + r.before) for r in cuts}
    return plans


def _first_to_reach(rows: DataFrame, key: Column, words: Column) -> DataFrame:
    """Per source the first key at which the running sum reaches `words`, and the sum before it."""
    sums = rows.groupBy("source", key.alias("key"), words.alias("goal")).agg(
        F.sum("words").alias("words"), F.count(F.when(F.col("words") > 0, 1)).alias("n"))
    upto = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum("words").over(upto) - F.col("words")
    return (sums.withColumn("before", before)
            .where("before < goal and before + words >= goal").select("source", "key", "before", "n"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """The mix as files: one folder per shard, each in its own shuffled order, cut documents shortened.

    A draw that is cut has its first words, one space apart; whole draws keep their text as it is.
    """
    rows = mixed.withColumn("draw", F.explode("draws"))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACED_WORD), F.lit(0)), F.lit(1),
                               F.col("draw.words").cast("int")), " ")
    rows = rows.withColumns({
        "text": F.when(F.col("draw.words") < F.col("size"), cut).otherwise(F.col("text")),
        "shard": F.col("draw.shard"), "slot": F.col("draw.slot")})
    (rows.drop("draws", "draw").repartition("shard").sortWithinPartitions("shard", "slot").drop("slot")
     .write.partitionBy("shard").parquet(path))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select(
        "doc_id", "size", "source_size", "target", "taken")
