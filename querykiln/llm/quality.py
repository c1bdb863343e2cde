"""Text quality by an interpolated modified Kneser-Ney model of character n-grams.

The model of a language is trained on its trusted text, of which every fifth document (by hash) is
held out. Counts, continuation counts, discounts and interpolation are Spark aggregations and joins,
sharded by the n-gram. A document's perplexity decides: it is rejected above a quantile of
the held-out texts of its language, which the model has seen as little as any other document.

Toxic text is fluent and passes that limit. So two smaller models of the same kind, of single words
counted by document, are trained on toxic and on trusted text: a word that toxic text has shown to be
its own gains the logarithm of the two probabilities' ratio. A document's gain per word is held
against a quantile of the same held-out texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import arrow_columns, gives_back, plain_names, stored, table
from querykiln.llm.words import word_hashes

ORDER = 5
SYMBOL_BITS = 12
# A language's model is dealt into buckets of about so many n-grams, and every n-gram is kept: a larger
# model has more buckets, of which a task holds KEPT_BUCKETS at a time.
BUCKET_GRAMS = 1 << 18
KEPT_BUCKETS = 8
QUANTILE = 0.975
TOXIC_QUANTILE = 0.99
HELD_OUT = 3  # one in so many trusted documents sets the limit instead of training the model
# A document counts as having so many further characters of average trusted text: a few words alone
# say little about quality.
PRIOR_CHARS = 100
PRIOR_WORDS = 50   # a document's toxicity counts as having so many further words without gain
LEAST_GAIN = 1.0   # of a word's log-ratio; what is below is noise of rare words
CHUNK_CHARS = 1 << 20      # counted at a time
PORTION_CHARS = 1 << 19    # judged at a time
OVER = 1e-9

RESULT = "perplexity double, perplexity_limit double, toxicity double, toxicity_limit double, quality_kept boolean"
_SPACES = re.compile(r"\s+")
# ASCII other than letters parts words.
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def symbols(text: str) -> np.ndarray:
    """Codes of the characters, after ORDER - 1 start symbols (0); digits are one symbol."""
    points = np.frombuffer(_SPACES.sub(" ", text).encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64)
    points = np.where((points >= 48) & (points <= 57), 48, points)
    half = 1 << (SYMBOL_BITS - 1)
    points = np.where(points < half, points, half + points * 2654435761 % half)
    return np.concatenate([np.zeros(ORDER - 1, dtype=np.int64), points])


def grams(codes: np.ndarray) -> np.ndarray:
    """The ORDER symbols up to each character, packed into one number."""
    n = len(codes) - ORDER + 1
    out = np.zeros(n, dtype=np.int64)
    for j in range(ORDER):
        out = (out << SYMBOL_BITS) | codes[j:j + n]
    return out


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-case words of letters, and the text number of each."""
    h, owner = word_hashes([t.lower().encode("utf-8", "replace").translate(_LETTERS) for t in texts])
    return h.view(np.int64), owner


def trusted_texts(docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  lang: str = "lang", toxic: DataFrame | None = None) -> DataFrame:
    """lang, body (compressed text), held, toxic of the labelled documents, written.

    `trusted` and `toxic` have their ids (doc_id); an id that is in both is toxic.
    """
    def run(batches):
        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([press(t) for t in batch.column(2).to_pylist()], pa.binary())],
                names=["doc_id", "lang", "body"])

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{lang}`"), F.lit("")).alias("lang"),
                       F.col(f"`{text}`").cast("binary").alias("text")).where("text is not null and length(text) > 0")
    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = rows.mapInArrow(gives_back(run), f"doc_id {kind}, lang string, body binary")
    ids = trusted.select("doc_id", F.lit(False).alias("toxic"))
    if toxic is not None:
        ids = ids.union(toxic.select("doc_id", F.lit(True)))
    ids = ids.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # The ids grow with the labels, so the join is the same at every size: never a broadcast.
    return stored(packed.join(ids.hint("merge"), "doc_id").select(
        "lang", "body", (F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0).alias("held"), "toxic"), "trusted")


def count_grams(texts: DataFrame) -> DataFrame:
    """lang, gram, n over all texts; each task adds up its own texts first."""
    def run(batches):
        held: dict[str, list] = {}
        sums: dict[str, tuple] = {}
        expand = zstandard.ZstdDecompressor().decompress

        def add(lang):
            keys, n = np.unique(np.concatenate([grams(c) for c in held.pop(lang)]), return_counts=True)
            if lang in sums:
                both, at = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
                n = np.bincount(at, np.concatenate([sums[lang][1], n]), minlength=len(both)).astype(np.int64)
                keys = both
            sums[lang] = (keys, n)

        for batch in batches:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(lang, []).append(symbols(expand(body).decode("utf-8", "replace")))
                if sum(map(len, held[lang])) > CHUNK_CHARS:
                    add(lang)
        for lang in list(held):
            add(lang)
        for lang, (keys, n) in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(keys), "gram": keys, "n": n})

    counts = texts.mapInArrow(gives_back(run), "lang string, gram long, n long")
    return stored(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")


def estimate(counts: DataFrame) -> DataFrame:
    """lang, size, gram, prob, context, left: the interpolated model, one row per n-gram.

    The highest order has counts; lower orders have the number of different symbols to the left.
    prob is interpolated with the next lower order, joined on the n-gram without its first symbol;
    left is what a context leaves to the lower order for symbols not seen after it.
    """
    levels = {ORDER: counts.select("lang", "gram", F.col("n").alias("c"))}
    for size in range(ORDER - 1, 0, -1):
        longer = levels[size + 1]
        levels[size] = stored(longer.groupBy("lang", F.col("gram").bitwiseAND((1 << SYMBOL_BITS * size) - 1).alias("gram"))
                              .agg(F.count("*").alias("c")), "grams")
    out, lower = None, None
    for size in range(1, ORDER + 1):
        rows = levels[size]
        of_counts = discounts(rows.groupBy("lang").agg(*counts_of_counts("c")), "lang")
        rows = rows.withColumn("context", F.shiftright("gram", SYMBOL_BITS))
        totals = rows.groupBy("lang", "context").agg(F.sum("c").alias("total"))
        kept = rows.join(F.broadcast(of_counts), "lang").join(totals, ["lang", "context"]).withColumn(
            "own", discounted("c") / F.col("total"))
        left = kept.groupBy("lang", "context").agg((1 - F.sum("own")).alias("left"))
        kept = kept.join(left, ["lang", "context"])
        if lower is None:
            kept = kept.withColumn("prob", F.col("own") + F.col("left") / (F.col("kinds") + 1))
        else:
            suffix = F.col("gram").bitwiseAND((1 << SYMBOL_BITS * (size - 1)) - 1)
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("prob").alias("below"))
            kept = kept.withColumn("suffix", suffix).join(below, ["lang", "suffix"], "left").withColumn(
                "prob", F.col("own") + F.col("left") * F.coalesce("below", F.lit(OVER)))
        lower = stored(kept.select("lang", F.lit(size).alias("size"), "gram", "prob", "context", "left"), "grams")
        out = lower if out is None else out.union(lower)
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """lang, toxic, word (hash), n: in how many texts the word is; each task adds up its own texts first."""
    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bodies: dict[tuple, list] = {}
            for lang, body, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bodies.setdefault((lang, toxic), []).append(expand(body).decode("utf-8", "replace"))
            for (lang, toxic), own in bodies.items():
                h, owner = letter_words(own)
                # The words of a text once each, then the texts of a word.
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
                word, n = np.unique(h[new], return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(word), pa.string()), "toxic": pa.array([toxic] * len(word), pa.bool_()),
                    "word": word, "n": n.astype(np.int64)})

    counts = texts.select("lang", "body", "toxic").mapInArrow(gives_back(run), "lang string, toxic boolean, word long, n long")
    return counts.groupBy("lang", "toxic", "word").agg(F.sum("n").alias("n"))


def count_neighbours(texts: DataFrame) -> DataFrame:
    """lang, word (hash), before: how many different words stand before it, the start of a text being one."""
    def run(batches):
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            bodies: dict[str, list] = {}
            for lang, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bodies.setdefault(lang, []).append(expand(body).decode("utf-8", "replace"))
            for lang, own in bodies.items():
                word, owner = letter_words(own)
                before = np.zeros(len(word), dtype=np.int64)
                before[1:] = np.where(owner[1:] == owner[:-1], word[:-1], 0)
                yield pa.RecordBatch.from_pydict({
                    "lang": pa.array([lang] * len(word), pa.string()), "word": word, "before": before})

    pairs = texts.select("lang", "body").mapInArrow(gives_back(run), "lang string, word long, before long").distinct()
    return pairs.groupBy("lang", "word").agg(F.count("*").alias("before"))


def discounts(of_counts: DataFrame, *keys: str) -> DataFrame:
    """keys, kinds, d1, d2, d3: Chen and Goodman's discounts for counts of one, two, and three or more."""
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    return of_counts.select(*keys, "kinds", *[
        F.when(usable, F.greatest(F.lit(0.1), k - (k + 1) * y * F.col(f"n{k + 1}") / F.nullif(F.col(f"n{k}"), F.lit(0))))
        .otherwise(0.5).alias(f"d{k}") for k in (1, 2, 3)])


def counts_of_counts(c: str) -> list[Column]:
    return [*[F.count(F.when(F.col(c) == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)], F.count("*").alias("kinds")]


def discounted(c: str) -> Column:
    discount = F.when(F.col(c) == 1, F.col("d1")).when(F.col(c) == 2, F.col("d2")).otherwise(F.col("d3"))
    return F.greatest(F.lit(0.0), F.col(c) - discount)


def toxic_words(texts: DataFrame, least: float = LEAST_GAIN) -> DataFrame:
    """lang, word, gain of the words whose log-ratio is above `least`, by what it is above.

    A word counts once for each text, but in toxic text not more often than different words stand
    before it: the words of a passage that several texts share are not signs of what they are about.

    Both models interpolate their discounted counts with a uniform share; the ratio is taken against
    that of a word in neither, so it does not depend on how much text of each kind there is. Only
    words of toxic text, in languages with trusted text, can gain.
    """
    counts = count_words(texts)
    toxic = counts.where("toxic").join(count_neighbours(texts.where("toxic")), ["lang", "word"])
    counts = stored(counts.where("not toxic").union(
        toxic.select("lang", "toxic", "word", F.least("n", "before").alias("n"))), "words")
    side = discounts(counts.groupBy("lang", "toxic").agg(F.sum("n").alias("total"), *counts_of_counts("n")),
                     "lang", "toxic", "total")
    own = counts.join(F.broadcast(side), ["lang", "toxic"]).select(
        "lang", "toxic", "word", (discounted("n") / F.col("total")).alias("own"))
    other = (own.groupBy("lang", "toxic").agg((1 - F.sum("own")).alias("left"))
             .join(F.broadcast(side.select("lang", "toxic", "kinds")), ["lang", "toxic"])
             .select("lang", "toxic", (F.col("left") / (F.col("kinds") + 1)).alias("other")))
    part = lambda toxic, p, u: (
        own.where(F.col("toxic") == toxic).select("lang", "word", F.col("own").alias(p)),
        other.where(F.col("toxic") == toxic).select("lang", F.col("other").alias(u)))
    bad, bad_other = part(True, "p", "u")
    good, good_other = part(False, "q", "v")
    # Of the trusted words only those that toxic text has matter.
    both = bad.join(good, ["lang", "word"], "left").join(F.broadcast(bad_other), "lang").join(F.broadcast(good_other), "lang")
    ratio = F.log1p(F.col("p") / F.col("u")) - F.log1p(F.coalesce("q", F.lit(0.0)) / F.col("v"))
    return both.select("lang", "word", (ratio - least).alias("gain")).where("gain > 0")


class Lookup:
    """Values by 60-bit key: one slot per hash, and a sorted rest for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, len(keys).bit_length()))
        slot = self._slot(keys)
        self.key = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int64)
        self.value = np.zeros(len(self.key), dtype=np.float32)
        first = np.unique(slot, return_index=True)[1]
        self.key[slot[first]], self.value[slot[first]] = keys[first], values[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.rest_key, self.rest_value = keys[rest], values[rest].astype(np.float32)

    def _slot(self, keys):
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, found) of each key."""
        slot = self._slot(keys)
        found, value = self.key[slot] == keys, self.value[slot]
        missing = np.flatnonzero(~found)
        if len(missing) and len(self.rest_key):
            at = np.minimum(np.searchsorted(self.rest_key, keys[missing]), len(self.rest_key) - 1)
            there = self.rest_key[at] == keys[missing]
            found[missing[there]], value[missing[there]] = True, self.rest_value[at[there]]
        return value, found


PACKED = {"gram": np.int64, "prob": np.float32, "context": np.int64, "left": np.float32}


class Model:
    """Log-probabilities of one language, from the rows of `estimate`."""

    def __init__(self, levels: dict[int, tuple]):
        words = levels.get(WORDS)
        self.words = Lookup(words[0], words[1]) if words else None
        # A bucket need not have n-grams of every order.
        nothing = tuple(np.zeros(0, dtype=kind) for kind in PACKED.values())
        orders = {s: levels.get(s, nothing) for s in range(1, ORDER + 1)}
        self.grams = {s: Lookup(g, np.log(np.maximum(p, OVER))) for s, (g, p, _, _) in orders.items()}
        self.contexts = {}
        for s, (_, _, context, left) in orders.items():
            at = np.unique(context, return_index=True)[1]
            self.contexts[s] = Lookup(context[at], np.log(np.maximum(left[at], OVER)))

    def logs(self, key: np.ndarray) -> np.ndarray:
        """ln p of the last symbol of each n-gram of the highest order."""
        out, todo = np.zeros(len(key)), np.arange(len(key))
        for size in range(ORDER, 0, -1):
            part = key[todo] & ((1 << SYMBOL_BITS * size) - 1)
            value, found = self.grams[size].find(part)
            out[todo[found]] += value[found]
            todo, part = todo[~found], part[~found]
            if not len(todo):
                return out
            back, known = self.contexts[size].find(part >> SYMBOL_BITS)
            out[todo] += np.where(known, back, 0)
        out[todo] += math.log(OVER)
        return out

    def gains(self, word: np.ndarray) -> np.ndarray:
        value, found = self.words.find(word) if self.words else (np.zeros(len(word)), np.zeros(len(word), dtype=bool))
        return np.where(found, value, 0.0)

    def surprise(self, text: str) -> tuple[float, int]:
        """(sum of -ln p, number of characters)."""
        key = grams(symbols(text))
        return -float(self.logs(key).sum()), len(key)


WORDS = 0  # the order under which words with their gain are kept in a bucket
PAIR = (1 << 2 * SYMBOL_BITS) - 1
SPREAD = 2654435761


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """By the two symbols before the last: all that an n-gram falls back on is then in its bucket."""
    return ((key >> SYMBOL_BITS & PAIR) * SPREAD >> 16) % buckets


def surprises(texts: Iterable[str], buckets: list, model) -> list[tuple[float, int, float, int]]:
    """`Model.surprise` of each text, its words' gain and their number.

    `model` gives the model of a bucket, wanted once per portion of text.
    """
    out: list[tuple[float, int, float, int]] = []
    portion: list[str] = []

    def add():
        keys = [grams(symbols(t)) for t in portion]
        lengths = [len(k) for k in keys]
        key, of = np.concatenate(keys), np.repeat(np.arange(len(keys)), lengths)
        del keys
        word, of_word = letter_words(portion)
        at, at_word = bucket_of(key, len(buckets)), word % len(buckets)
        total, gain = np.zeros(len(portion)), np.zeros(len(portion))
        for b in np.union1d(at, at_word):
            here, own = at == b, at_word == b
            lookup = model(buckets[b])
            total -= np.bincount(of[here], lookup.logs(key[here]), minlength=len(portion))
            gain += np.bincount(of_word[own], lookup.gains(word[own]), minlength=len(portion))
        out.extend(zip(total.tolist(), lengths, gain.tolist(),
                       np.bincount(of_word, minlength=len(portion)).tolist(), strict=True))
        portion.clear()

    held = 0
    for text in texts:
        portion.append(text)
        held += len(text)
        if held > PORTION_CHARS:
            add()
            held = 0
    if portion:
        add()
    return out


def bucket_models():
    """A function from a broadcast bucket to its model; it holds a bounded number of them, the latest."""
    @lru_cache(KEPT_BUCKETS)
    def model(bucket) -> Model:
        # Not by `value`, which would hold every bucket until the worker ends.
        path = getattr(bucket, "_path", None)
        return Model(bucket.load_from_path(path) if path else bucket.value)

    return model


def _packed(rows: DataFrame, bucket_grams: int) -> DataFrame:
    """One row per language, bucket and order: the model as the driver passes it on, bucket by bucket.

    Orders of one and two symbols, bounded by the alphabet, are in every bucket of a language; words
    are dealt by their hash.
    """
    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "gram"])
        return pd.DataFrame([{"lang": key[0], "bucket": key[1], "buckets": part["buckets"].iloc[0], "size": size, **{
            c: own[c].to_numpy().astype(kind).tobytes() for c, kind in PACKED.items()}}
            for size, own in part.groupby("size")])

    buckets = rows.groupBy("lang").agg(F.ceil(F.count("*") / bucket_grams).cast("int").alias("buckets"))
    own = F.pmod(F.shiftright(F.shiftright("gram", SYMBOL_BITS).bitwiseAND(PAIR) * F.lit(SPREAD), 16), F.col("buckets"))
    dealt = rows.join(F.broadcast(buckets), "lang").withColumn("bucket", F.explode(
        F.when(F.col("size") > 2, F.array(own.cast("int")))
        .when(F.col("size") == WORDS, F.array(F.pmod("gram", F.col("buckets").cast("long")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("buckets") - 1))))
    return dealt.groupBy("lang", "bucket").applyInPandas(
        pack, "lang string, bucket int, buckets int, size int, gram binary, prob binary, context binary, left binary")


def broadcast_buckets(model: DataFrame, bucket_grams: int) -> dict[str, list]:
    """lang -> broadcast buckets of the rows of `estimate`. The driver holds one bucket at a time."""
    spark = model.sparkSession
    out: dict[str, list] = {}
    bucket: tuple | None = None
    levels: dict[int, tuple] = {}

    def put():
        if bucket:
            out.setdefault(bucket[0], [None] * bucket[2])[bucket[1]] = spark.sparkContext.broadcast(dict(levels))
            levels.clear()

    for row in stored(_packed(model, bucket_grams), "grams").toLocalIterator():
        if bucket != (row["lang"], row["bucket"], row["buckets"]):
            put()
            bucket = (row["lang"], row["bucket"], row["buckets"])
        levels[row["size"]] = tuple(np.frombuffer(row[c], dtype=kind) for c, kind in PACKED.items())
    put()
    return out


def fit(texts: DataFrame, bucket_grams: int = BUCKET_GRAMS, quantile: float = QUANTILE, prior: int = PRIOR_CHARS,
        toxic_quantile: float = TOXIC_QUANTILE) -> dict:
    """lang -> (broadcast buckets of the model, mean surprise per character, limits on smoothed perplexity and toxicity).

    `texts` are the rows of `trusted_texts`. The limits are quantiles over a language's held-out texts;
    a language without any, or without others, has no model.
    """
    trusted, held = texts.where("not toxic and not held"), texts.where("not toxic and held")
    words = toxic_words(texts.where("toxic or not held"))
    of_grams = estimate(count_grams(trusted.select("lang", "body")))
    model = of_grams.union(words.select("lang", F.lit(WORDS), "word", "gain", F.lit(0).cast("long"), F.lit(0.0)))
    buckets = broadcast_buckets(model, bucket_grams)

    def run(batches):
        expand, model = zstandard.ZstdDecompressor().decompress, bucket_models()
        for batch in batches:
            bodies: dict[str, list] = {}
            for lang, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang in buckets:
                    bodies.setdefault(lang, []).append(b)
            found = [(lang, *x) for lang, own in bodies.items() for x in surprises(
                (expand(b).decode("utf-8", "replace") for b in own), buckets[lang], model)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], t) for i, t in enumerate(
                    (pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.int64()))],
                names=["lang", "s", "n", "gain", "words"])

    scored = stored(held.select("lang", "body").mapInArrow(
        gives_back(run), "lang string, s double, n long, gain double, words long"), "trusted")
    means = scored.groupBy("lang").agg((F.sum("s") / F.sum("n")).alias("mean"))
    smooth = (F.col("s") + prior * F.col("mean")) / (F.col("n") + prior)
    limits = scored.join(F.broadcast(means), "lang").groupBy("lang").agg(
        F.first("mean").alias("mean"), F.percentile_approx(F.exp(smooth), quantile, 100000).alias("limit"),
        F.percentile_approx(F.col("gain") / (F.col("words") + PRIOR_WORDS), toxic_quantile, 100000).alias("toxic_limit"))
    return {r.lang: (buckets[r.lang], r["mean"], r["limit"], r["toxic_limit"]) for r in limits.collect()}


def judge(docs: DataFrame, fitted: dict, text: str = "text", lang: str = "lang", prior: int = PRIOR_CHARS) -> DataFrame:
    """`docs` with perplexity and toxicity (both smoothed), their limits and quality_kept: neither is above.

    A null language is a language of its own. A document is kept without scores if its text is
    null or empty or its language has no trusted text. A result column replaces one of its name.
    """
    def open_task():
        model = bucket_models()

        def of(batch):
            rows: list[tuple] = [(None, None, None, None, True)] * len(batch["text"])
            at: dict[str, list[int]] = {}
            for i, (content, name) in enumerate(zip(batch["text"], batch["lang"], strict=True)):
                if content and (name or "") in fitted:
                    at.setdefault(name or "", []).append(i)
            for name, own in at.items():
                buckets, mean, limit, toxic_limit = fitted[name]
                for i, (total, n, gain, words) in zip(own, surprises(
                        (batch["text"][i].decode("utf-8", "replace") for i in own), buckets, model), strict=True):
                    perplexity = math.exp((total + prior * mean) / (n + prior))
                    toxicity = gain / (words + PRIOR_WORDS)
                    rows[i] = (perplexity, limit, toxicity, toxic_limit,
                               perplexity <= limit and toxicity <= toxic_limit)
            return rows

        return of

    return arrow_columns(docs, {"text": text, "lang": F.col(f"`{lang}`")}, RESULT, open_task)


def keep_good(docs: DataFrame, fitted: dict, text: str = "text", lang: str = "lang") -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    rows, names = plain_names(docs)
    return judge(rows, fitted, names[text], names[lang]).where("quality_kept").select(
        *[F.col(n).alias(c) for c, n in names.items()])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids whose labels all say good quality, and none says toxic."""
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.where("q = 1 and coalesce(t, 0) = 0").select("doc_id")


def toxic_ids(labels: DataFrame) -> DataFrame:
    """Ids that a label says to be toxic."""
    return labels.where("toxic = 1").select("doc_id").distinct()


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels")
    fitted = fit(trusted_texts(docs, trusted_ids(labels), toxic=toxic_ids(labels)))
    return judge(docs, fitted).drop("text")
