"""Language identification by compression: the dictionary that shortens a text most names it.

Each language has a raw-content Zstandard dictionary, filled with one piece of each text of a bounded
sample of labelled texts. A text is compressed whole, in lower case, in pieces of a few kilobytes, with every
dictionary; pieces keep the dictionary's share in a long text as large as in a short one.
"""

from __future__ import annotations

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from querykiln.llm.common import arrow_columns, table, thinned

# The bounded sample: at most so many labelled texts per language, which share the characters of a
# dictionary evenly; each gives a run from a place its hash picks, so openings weigh no more than the rest.
SAMPLE_TEXTS = 200
DICTIONARY_BYTES = 32 << 10
PIECE_BYTES = 4096
# Lazy matching from four bytes on, in tables just large enough for a dictionary and a piece.
COMPRESSION = {"window_log": 17, "chain_log": 16, "hash_log": 16, "search_log": 3, "min_match": 4,
               "target_length": 8, "strategy": zstandard.STRATEGY_LAZY}
# A text whose second-best size is less than this share above the best is rejected.
MIN_MARGIN = 0.01
UNKNOWN = "und"


def train(labelled: DataFrame, key: str, text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A dictionary per language, from the texts with the lowest hash of `key` (spread evenly).

    Rows without text or language teach nothing. Languages are few; each gives a bounded sample. What
    is longer than a dictionary is cut from its end; what short texts leave free stays free.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang"),
                           F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("h"))
    rows = rows.where("text is not null and lang is not null and text != ''")
    # About four times the sample, evenly; what is ranked then no longer grows with the data.
    shares = {r["lang"]: 4 * SAMPLE_TEXTS / r["count"] for r in rows.groupBy("lang").count().collect()}
    if not shares:
        return {}
    rows = thinned(rows, F.col("h"), F.element_at(
        F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang")))
    first = Window.partitionBy("lang").orderBy("h")
    # A text that may be picked brings one run of the most it could give to the ranking, not all of it.
    start = F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - DICTIONARY_BYTES, F.lit(0)) + 1).cast("int") + 1
    picked = (rows.select("lang", "h", F.substring("text", start, F.lit(DICTIONARY_BYTES)).alias("text"))
              .withColumn("n", F.row_number().over(first)).where(F.col("n") <= SAMPLE_TEXTS))
    picked = picked.withColumn("chars", F.floor(DICTIONARY_BYTES / F.count("*").over(Window.partitionBy("lang"))).cast("int"))
    start = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.length("text") - F.col("chars"), F.lit(0)) + 1).cast("int") + 1
    sample = picked.select("lang", "n", F.substring("text", start, F.col("chars")).alias("text")).orderBy("lang", "n").collect()
    out: dict[str, bytes] = {}
    for row in sample:
        out[row.lang] = (out.get(row.lang, b"") + row.text.lower().encode() + b"\n")[:DICTIONARY_BYTES]
    return out


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """`docs` with lang_best, score and lang_accepted.

    lang_best is `und` for a text that is null, empty or has no letter, or if there is no
    dictionary; score is 1 - smallest size / second smallest size (0 to 1; 1 for a single
    language); lang_accepted is lang_best, or null where the margin is narrower than
    `min_margin`. Equal sizes go to the first language by code point. A result column replaces
    one of its name.
    """
    held = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries.items()))

    def open_task():
        how = zstandard.ZstdCompressionParameters(**COMPRESSION)
        coders = []
        for name, content in held.value:
            data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=how)
            coders.append((name, zstandard.ZstdCompressor(dict_data=data, compression_params=how).compress))

        def one(content: str | None):
            if not content or not coders or not any(map(str.isalpha, content)):
                return UNKNOWN, 0.0, None
            raw = content.lower().encode()
            pieces = [raw[i:i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]
            sizes = sorted((sum(len(press(p)) for p in pieces), name) for name, press in coders)
            score = 1 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0
            return sizes[0][1], score, sizes[0][1] if score >= min_margin else None

        return lambda batch: map(one, batch["text"])

    return arrow_columns(docs, {"text": F.col(f"`{text}`")},
                         "lang_best string, score double, lang_accepted string", open_task)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    dictionaries = train(docs.where(~held_out), "doc_id")
    named = identify(docs.select("doc_id", "text", held_out.alias("held_out")), dictionaries)
    return named.select("doc_id", "held_out", F.col("lang_best").alias("lang_pred"), "score", "lang_accepted")
