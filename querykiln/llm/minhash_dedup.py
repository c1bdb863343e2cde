"""Near-duplicate texts: weighted MinHash over TF-IDF shingles, banded, verified exactly.

Shingles are runs of five words; their weight is term frequency times inverse document frequency. The
document frequency of every shingle is counted, exactly: hashes are dealt out by their leading bits,
counted there, and each text gets the counts of its shingles back.
Improved consistent weighted sampling (Ioffe) draws samples that two texts share with a chance equal to
their weighted Jaccard similarity; texts with an equal band of samples are candidates. Candidates are
verified by the exact weighted Jaccard similarity, and linked texts form classes.

Buckets are not turned into all pairs. Equal texts are one text from the start. A text that holds
more than the allowed difference in shingles no other candidate has can be linked to nothing, and
goes. Each bucket then compares its texts with a pivot, which joins most of them; only texts of one
bucket that are still in different classes, and whose shared weight could suffice, meet in pairs. In a
large bucket, shingles that few of its texts have say which pairs those are: two texts either share
such a rare shingle (few pairs), or all their rare shingles count as differences.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.llm.common import gives_back, partitions, stored, table
from querykiln.llm.components import components
from querykiln.llm.decontamination import _FOLD
from querykiln.llm.words import gram_hashes, mixed, plain, portions, texts_by_key, word_hashes
from querykiln.session import shared_folder

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 14, 4  # a pair at similarity 0.8 shares a band with a chance of 0.9994
# With a least share, shingles in less than this share of the texts count as being in so many: the
# weight is ln(1 + 1 / max(df / N, share)). A third, so that a group of near copies of that size does not
# make its own shingles light. The queries take none: TF-IDF as it is, ln(1 + N / df).
COMMON = 1 / 3
NO_LEAST = 0.0
PIVOT_ROUNDS = 3
SMALL = 4  # texts of a bucket that meet without further ado
FEW = 16   # texts that a rare shingle is in
BLOCK_SHINGLES = 1 << 19  # of texts that a task counts and deals out together
BUCKET_BYTES = 1 << 20    # compressed text, some 300,000 shingles, for each bucket of hashes
REPEATS = 64              # a shingle in more texts of a block is dealt out once, with their number
NO_ID = (1 << 63) - 1

_draws = np.random.default_rng(20)
_R = _draws.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
_LN_C = np.log(_draws.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)
_SEEDS = _draws.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, times) of the distinct shingles of each text, sorted by text and hash.

    Words are runs of ASCII letters and digits (A-Z in lower case) and of characters outside ASCII;
    a text of fewer words than a shingle, but not none, is one shingle.
    """
    words, owner = word_hashes([t.translate(_FOLD) for t in texts])
    grams = gram_hashes(words, SHINGLE)
    inside = owner[SHINGLE - 1:] == owner[:len(grams)]
    h, of = grams[inside], owner[:len(grams)][inside]
    numbers, begin, counts = np.unique(owner, return_index=True, return_counts=True)
    short = [(gram_hashes(words[b:b + c], c)[0], n) for n, b, c in zip(numbers, begin, counts, strict=True)
             if c < SHINGLE]
    if short:
        h = np.concatenate([h, np.array([s[0] for s in short], dtype=np.uint64)])
        of = np.concatenate([of, np.array([s[1] for s in short])])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    if not len(h):
        return h, of, np.zeros(0, dtype=np.int64)
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
    at = np.flatnonzero(new)
    return h[at], of[at], np.diff(np.append(at, len(h)))


class Weights:
    """TF-IDF weights of shingles, by their document frequency or by a table of common ones."""

    def __init__(self, common: dict[int, int], texts: int, share: float):
        self.hashes = np.array(sorted(common), dtype=np.uint64)
        self.values = self.idf(np.array([common[h] for h in sorted(common)], dtype=np.float64), texts, 0.0)
        self.texts, self.share = texts, share

    @staticmethod
    def idf(df: np.ndarray, texts: int, share: float) -> np.ndarray:
        return np.log1p(texts / np.maximum(np.maximum(df, 1.0), share * texts))

    def counted(self, df: np.ndarray, times: np.ndarray) -> np.ndarray:
        return times * self.idf(df, self.texts, self.share)

    def of(self, h: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By the table; all others are in the least share."""
        idf = np.full(len(h), math.log1p(1 / self.share))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            idf = np.where(self.hashes[at] == h, self.values[at], idf)
        return times * idf


def band_keys(h: np.ndarray, owner: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text numbers, and a row of band hashes for each, from consistent weighted samples."""
    starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    spread = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(owner))))
    ln_w = np.log(weight).astype(np.float32)
    keys = np.zeros((len(starts), BANDS), dtype=np.uint64)
    for k in range(BANDS * ROWS):
        x = mixed(h ^ _SEEDS[k])
        r = _R[x & np.uint64(0xFFFF)]
        beta = ((x >> np.uint64(32)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2.0 ** -24)
        t = np.floor(ln_w / r + beta)
        a = _LN_C[(x >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t + 1 - beta)
        least = np.minimum.reduceat(a, starts)
        at = np.flatnonzero(a == least[spread])
        at = at[np.unique(spread[at], return_index=True)[1]]
        band = k // ROWS
        sample = mixed(h[at] + np.uint64(0x9E3779B97F4A7C15) * t[at].astype(np.int64).view(np.uint64))
        keys[:, band] = mixed(keys[:, band] * np.uint64(31) + sample + np.uint64(k))
    return owner[starts], keys


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    both = np.minimum(a[1][i], b[1][j]).sum()
    return both / (a[1].sum() + b[1].sum() - both)


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            threshold: float = SIMILARITY, common: float = COMMON) -> DataFrame:
    """doc_id, class_id, kept and `row` (the other columns), body (compressed text): a row per row.

    class_id is the least doc_id (an integer) of the texts reachable over links; kept marks one row of
    each class, the one with that id. A null text is no duplicate of anything and kept; equal texts,
    also empty ones, are one class; a text without words is a duplicate of equal texts only; a null
    id counts as the largest id and its class_id may be null; of equal rows one is kept. `common` is the
    least share of texts that a shingle counts as being in, or `NO_LEAST`.
    """
    texts = texts_by_key(docs, doc_id, text, "minhash", keep=True)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    first = stored(texts.where("body is not null").groupBy("text_key").agg(
        F.min(order).alias("first_id"), F.min_by("doc_key", F.struct(order, F.col("doc_key"))).alias("first_key"),
        F.max(F.length("body")).alias("bytes"),
    ), "minhash")
    repeated = any(r["copies"] > 1 for r in texts.groupBy("doc_key").agg(F.count("*").alias("copies")).where(
        "copies > 1").limit(1).collect())

    def one_each(keys: DataFrame) -> DataFrame:
        found = texts.select("doc_key", "body").join(keys, "doc_key")
        return found.dropDuplicates(["doc_key"]) if repeated else found

    n, size = first.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    distinct = one_each(_frequencies(one_each(first.select(F.col("first_key").alias("doc_key"))), size))
    links = _links(distinct, Weights({}, n, common), threshold)
    groups = components(links).withColumnRenamed("node", "first_key")
    named = stored(first.join(groups, "first_key", "left").withColumn(
        "component", F.coalesce("component", "first_key")), "minhash")
    best = named.groupBy("component").agg(F.min(F.struct("first_id", "first_key")).alias("best"))
    named = named.join(best, "component").select(
        "text_key", F.col("best.first_id").alias("class"), F.col("best.first_key").alias("best_key"))
    by_key = texts.select("doc_key", "text_key").distinct().join(named, "text_key").select("doc_key", "class", "best_key")
    rows = texts.join(by_key, "doc_key", "left")
    # Equal rows share a key; the first of them stays.
    copy = F.row_number().over(Window.partitionBy("doc_key").orderBy("best_key"))
    known = F.col("body").isNotNull()
    return rows.withColumn("copy", copy).select(
        "doc_id", F.when(known, F.nullif("class", F.lit(NO_ID))).otherwise(F.col("doc_id").cast("long")).alias("class_id"),
        (~known | ((F.col("doc_key") == F.col("best_key")) & (F.col("copy") == 1))).alias("kept"), "row", "body")


def _frequencies(distinct: DataFrame, size: int, block: int = BLOCK_SHINGLES, repeats: int = REPEATS) -> DataFrame:
    """doc_key, df: in how many texts each shingle of the text is, in the order of the shingles' hashes.

    Tasks deal out the hashes of a block of texts by their leading bits, into buckets that grow in number
    with the `size` of the texts (compressed bytes). What a bucket counts goes back to the blocks, hash for
    hash in the order in which it came, and each block hands its texts their counts. So no list of all
    shingles is ever in one place. A shingle that many texts of a block have is sent once, so that one of
    most texts adds no more than a hash and a number for each block to its bucket.
    """
    bits = 8 + max(0, math.ceil(math.log2(max(1, size) / BUCKET_BYTES / 256)))

    def deal(batches):
        held, shingled = [], 0
        for batch in portions(batches, 1):
            h, owner, _ = shingles(plain(batch.column(1)))
            held.append((batch.column(0).to_numpy(), np.bincount(owner, minlength=batch.num_rows), h))
            shingled += len(h)
            if shingled >= block:
                yield from _dealt(held, bits, repeats)
                held, shingled = [], 0
        if held:
            yield from _dealt(held, bits, repeats)

    schema = "block long, bucket long, hashes binary, often binary, times binary"
    spark = distinct.sparkSession
    n, name = partitions(spark), f"querykiln_frequencies_{uuid.uuid4().hex}"
    dealt = distinct.select("doc_key", "body").mapInArrow(gives_back(deal), schema).repartition(
        max(n, size // (2 * BUCKET_BYTES)), "bucket")
    counted = dealt.groupBy("bucket").applyInArrow(lambda rows: _counted(rows, bits), schema)
    found = counted.groupBy("block").applyInArrow(_returned, "doc_key long, df binary")
    # Bucketed like the texts, so that both meet where they are.
    (found.repartition(n, "doc_key").write.bucketBy(n, "doc_key").option("path", shared_folder(spark, "frequencies"))
     .option("compression", "uncompressed").saveAsTable(name))
    return spark.table(name)


def _press(values: np.ndarray, kind: type) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def _spread(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=kind)


def _dealt(held: list[tuple], bits: int, repeats: int):
    """Rows of one block of texts: the hashes of each bucket, and (bucket below 0) what leads them back.

    Of a hash in a bucket, the leading byte is known, so seven are sent. Buckets of a text's hashes rise.
    """
    keys, sizes, h = (np.concatenate(c) for c in zip(*held, strict=True))
    ordered = np.sort(h)
    often = np.unique(ordered[repeats:][ordered[repeats:] == ordered[:-repeats]])
    at = np.searchsorted(often, h)
    common = np.append(often, np.uint64(0))[at] == h
    common &= at < len(often)
    shift = np.uint64(64 - bits)
    bucket = (h[~common] >> shift).astype(np.int64)
    rare = h[~common][np.argsort(bucket, kind="stable")]
    low = np.ascontiguousarray(rare).view(np.uint8).reshape(-1, 8)[:, :7]
    times = np.bincount(at[common], minlength=len(often))
    name, filled = keys[0], np.unique(np.concatenate([rare >> shift, often >> shift]))
    edges = [np.searchsorted(x >> shift, np.append(filled, filled[-1:] + np.uint64(1))) for x in (rare, often)]
    rows = [(b, low[r0:r1].tobytes(), often[o0:o1].tobytes(), times[o0:o1].tobytes()) for b, r0, r1, o0, o1 in zip(
        filled.tolist(), edges[0][:-1], edges[0][1:], edges[1][:-1], edges[1][1:], strict=True)]
    back = [_press(keys, np.int64), _press(sizes, np.uint32), _press(np.diff(bucket, prepend=0), np.int32),
            _press(np.flatnonzero(common), np.uint32), _press(at[common], np.uint32)]
    ends = np.cumsum([len(b) for b in back])
    rows.append((-1 - int(name) % (1 << bits), b"".join(back), ends.astype(np.int64).tobytes(), None))
    for i in range(0, len(rows), 1024):
        b, hashes, hot, n = zip(*rows[i:i + 1024], strict=True)
        yield pa.RecordBatch.from_pydict({
            "block": np.full(len(b), name), "bucket": pa.array(b, pa.int64()), "hashes": pa.array(hashes, pa.binary()),
            "often": pa.array(hot, pa.binary()), "times": pa.array(n, pa.binary())})


def _counted(rows: pa.Table, bits: int) -> pa.Table:
    """The rows of a bucket with the document frequency of each hash in its place."""
    bucket = rows["bucket"][0].as_py()
    if bucket < 0:
        return rows
    low = [np.frombuffer(b, dtype=np.uint8).reshape(-1, 7) for b in rows["hashes"].to_pylist()]
    often = [np.frombuffer(b, dtype=np.uint64) for b in rows["often"].to_pylist()]
    times = [np.frombuffer(b, dtype=np.int64) for b in rows["times"].to_pylist()]
    whole = np.empty((sum(map(len, low)), 8), dtype=np.uint8)
    whole[:, :7] = np.concatenate(low)
    whole[:, 7] = bucket >> (bits - 8)
    _, which = np.unique(np.concatenate([whole.view(np.uint64).ravel(), *often]), return_inverse=True)
    df = np.bincount(which, np.concatenate([np.ones(len(whole), dtype=np.int64), *times]))[which]
    parts = np.split(df, np.cumsum([len(x) for x in (*low, *often)])[:-1])
    for name, values in (("hashes", parts[:len(low)]), ("often", parts[len(low):])):
        rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(
            [_press(v, np.uint32) for v in values], pa.binary()))
    return rows.set_column(rows.schema.get_field_index("times"), "times", pa.nulls(len(rows), pa.binary()))


def _returned(rows: pa.Table) -> pa.Table:
    """The texts of a block, each with the document frequencies of its shingles."""
    found = sorted(zip(*(rows[c].to_pylist() for c in ("bucket", "hashes", "often")), strict=True), key=lambda r: r[0])
    (_, back, ends), found = found[0], found[1:]
    ends = np.frombuffer(ends, dtype=np.int64).tolist()
    keys, sizes, bucket, common, which = (_spread(back[a:b], kind) for a, b, kind in zip(
        [0, *ends], ends, (np.int64, np.uint32, np.int32, np.uint32, np.uint32), strict=False))
    rare, often = (np.concatenate([np.zeros(0, np.uint32), *(_spread(r[i], np.uint32) for r in found)]) for i in (1, 2))
    df = np.zeros(int(sizes.sum()), dtype=np.uint32)
    df[common] = often[which]
    alone = np.ones(len(df), dtype=bool)
    alone[common] = False
    df[np.flatnonzero(alone)[np.argsort(np.cumsum(bucket), kind="stable")]] = rare
    texts = np.split(df, np.cumsum(sizes.astype(np.int64))[:-1])
    return pa.table({"doc_key": keys, "df": pa.array([_press(t, np.uint32) for t in texts], pa.binary())})


def _weighed(batch: pa.RecordBatch, body: int, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, weight) of the shingles of texts; their frequencies follow their column."""
    h, owner, times = shingles(plain(batch.column(body)))
    return h, owner, weights.counted(np.frombuffer(b"".join(plain(batch.column(body + 1))), dtype=np.uint32), times)


def _links(distinct: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(a, b) of texts (doc_key) at the threshold or above, enough of them to connect every class."""
    def sign(batches):
        for batch in portions(batches, 1):
            h, owner, w = _weighed(batch, 1, weights)
            if len(h):
                numbers, keys = band_keys(h, owner, w)
                yield pa.RecordBatch.from_pydict({
                    "band": keys.ravel().view(np.int64),
                    "doc_key": np.repeat(batch.column(0).to_numpy()[numbers], BANDS)})

    def weigh(batches):
        for batch in portions(batches, 1):
            h, owner, w = _weighed(batch, 1, weights)
            yield pa.RecordBatch.from_pydict({"h": h.view(np.int64), "doc_key": batch.column(0).to_numpy()[owner], "w": w})

    bands = stored(distinct.mapInArrow(gives_back(sign), "band long, doc_key long"), "minhash")
    members = stored(_shared(bands), "minhash")
    weighed = distinct.join(members.select("doc_key").distinct(), "doc_key").mapInArrow(
        gives_back(weigh), "h long, doc_key long, w double")
    # A shingle of one candidate only is that text's own; its owner's weight is out of reach.
    per = weighed.groupBy("h").agg(F.count("*").alias("n"), F.max("doc_key").alias("doc_key"), F.sum("w").alias("w"))
    own = per.where("n = 1").groupBy("doc_key").agg(F.sum("w").alias("own"))
    mass = distinct.join(members.select("doc_key").distinct(), "doc_key").mapInArrow(
        gives_back(_mass(weights)), "doc_key long, mass double")
    able = mass.join(own, "doc_key", "left").select(
        "doc_key", "mass", (F.col("mass") - F.coalesce("own", F.lit(0.0))).alias("common"))
    able = stored(able.where(F.col("common") >= threshold * F.col("mass") * (1 - 1e-9)), "minhash")
    members = stored(_shared(members.join(able.select("doc_key"), "doc_key", "left_semi")), "minhash")
    links = None
    rest = members.join(able.select("doc_key", (1 - F.col("common") / F.col("mass")).alias("own")), "doc_key").select(
        "band", "doc_key", "own", F.col("doc_key").alias("component"))
    used = None
    for _ in range(PIVOT_ROUNDS):
        # The text with least of its own is likeliest to be near any other; a later pivot speaks for
        # classes of the bucket that no earlier one belongs to.
        free = rest if used is None else rest.join(
            rest.join(used, ["band", "doc_key"], "left_semi").select("band", "component"), ["band", "component"], "left_anti")
        pivot = stored(free.groupBy("band").agg(F.min_by(
            F.struct("doc_key", "component"), F.struct("own", F.xxhash64("doc_key"))).alias("p")), "minhash")
        chosen = pivot.select("band", "p.doc_key")
        used = chosen if used is None else used.union(chosen)
        pairs = rest.join(pivot, "band").where("component != p.component").select(
            F.least("doc_key", "p.doc_key").alias("a"), F.greatest("doc_key", "p.doc_key").alias("b"))
        found = _verify(distinct, stored(pairs.distinct(), "minhash"), weights, threshold)
        links = stored(found if links is None else links.union(found), "minhash")
        rest = rest.drop("component").join(_near_least(links), "doc_key", "left").select(
            "band", "doc_key", "own", F.coalesce("component", "doc_key").alias("component"))
        unlike = rest.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
        rest = stored(rest.join(unlike.where("x != y").select("band"), "band", "left_semi"), "minhash")
        if rest.isEmpty():
            return links
    # From here on only whole classes will do: what is linked by now meets no more.
    known = components(links)
    rest = rest.drop("component").join(known.withColumnRenamed("node", "doc_key"), "doc_key", "left").withColumn(
        "component", F.coalesce("component", "doc_key"))
    pairs = stored(_remaining(distinct, rest, able, weigh, threshold), "minhash")
    return known.toDF("a", "b").union(_verify(distinct, pairs, weights, threshold))


def _remaining(distinct: DataFrame, rest: DataFrame, able: DataFrame, weigh, threshold: float) -> DataFrame:
    """(a, b): texts of one bucket and different classes that can still reach the threshold."""
    sizes = rest.groupBy("band").agg(F.count("*").alias("n"))
    rest = stored(rest.join(sizes, "band").join(able, "doc_key"), "minhash")
    small = _pairs(rest.where(F.col("n") <= SMALL), threshold)
    large = rest.where(F.col("n") > SMALL)
    texts = large.select("doc_key", "component").distinct()
    shingled = stored(distinct.join(texts.select("doc_key").distinct(), "doc_key").mapInArrow(
        gives_back(weigh), "h long, doc_key long, w double"), "minhash")
    few = shingled.groupBy("h").agg(F.count("*").alias("of")).where(F.col("of") <= FEW)
    rare = stored(shingled.join(few, "h"), "minhash")
    share = rare.where("of > 1").select("h", "doc_key").join(texts, "doc_key")
    left, right = (share.select("h", F.col("doc_key").alias(s), F.col("component").alias(f"component_{s}")) for s in "ab")
    sharing = left.join(right, "h").where("a < b and component_a != component_b").select("a", "b")
    mass = rare.groupBy("doc_key").agg(F.sum("w").alias("rare"))
    large = large.join(mass, "doc_key", "left").withColumn("common", F.col("mass") - F.coalesce("rare", F.lit(0.0)))
    alike = _pairs(large.where(F.col("common") >= threshold * F.col("mass") * (1 - 1e-9)), threshold)
    return small.union(alike).union(sharing).distinct()


def _pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """Pairs of one band and different components whose common weights allow the threshold."""
    left, right = (rows.select("band", *[F.col(c).alias(f"{c}_{s}") for c in (
        "doc_key", "component", "mass", "common")]) for s in "ab")
    least = F.least("common_a", "common_b")
    return left.join(right, "band").where(
        (F.col("doc_key_a") < F.col("doc_key_b")) & (F.col("component_a") != F.col("component_b"))
        & (least >= threshold * (1 - 1e-9) * (F.col("mass_a") + F.col("mass_b") - least))).select(
        F.col("doc_key_a").alias("a"), F.col("doc_key_b").alias("b")).distinct()


def _near_least(links: DataFrame) -> DataFrame:
    """doc_key, component: the least text within about two links. Equal values mean one class."""
    both = links.union(links.select("b", "a")).toDF("doc_key", "other")
    least = stored(both.groupBy("doc_key").agg(F.least("doc_key", F.min("other")).alias("component")), "minhash")
    further = least.select(F.col("doc_key").alias("component"), F.col("component").alias("further"))
    return least.join(further, "component").select("doc_key", F.col("further").alias("component"))


def _shared(bands: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one text."""
    several = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    return bands.join(several, "band", "left_semi")


def _mass(weights: Weights):
    def run(batches):
        for batch in portions(batches, 1):
            _, owner, w = _weighed(batch, 1, weights)
            yield pa.RecordBatch.from_pydict({"doc_key": batch.column(0), "mass": np.bincount(
                owner, w, minlength=batch.num_rows)})

    return run


def _verify(distinct: DataFrame, pairs: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs whose exact similarity reaches the threshold."""
    def run(batches):
        last: tuple = (None, None)
        for batch in portions(batches, 4):
            keep = []
            for n, a in enumerate(batch.column(0).to_pylist()):
                one = batch.slice(n, 1)
                if last[0] != a:
                    last = (a, _weighed(one, 2, weights)[::2])
                keep.append(similarity(last[1], _weighed(one, 4, weights)[::2]) >= threshold)
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).filter(pa.array(keep)) for i in (0, 1)], names=["a", "b"])

    # Texts of b come to the pairs; texts of a, of which one may be in very many pairs, come in a
    # join that can be split.
    with_b = pairs.join(distinct.toDF("b", "body_b", "df_b"), "b")
    of_a = distinct.join(pairs.select(F.col("a").alias("doc_key")).distinct(), "doc_key").toDF("a", "body_a", "df_a")
    return with_b.join(of_a, "a").select("a", "b", "body_a", "df_a", "body_b", "df_b").mapInArrow(gives_back(run), "a long, b long")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each class, with the columns of `docs`; texts without a class stay."""
    kept = classes(docs, doc_id, text, **options).where("kept")

    def run(batches):
        for batch in portions(batches, 1):
            bodies = batch.column(1)
            texts = [None if b is None else t.decode("utf-8", "replace")
                     for b, t in zip(bodies.to_pylist(), plain(bodies), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    out = kept.select("row", "body").mapInArrow(
        gives_back(run), f"row {kept.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("text") if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs, common=NO_LEAST).select("doc_id", "class_id", "kept")
