"""Benchmark passages inside documents, by Wu-Manber search over words.

Words are the alphabet: a pattern is a window of consecutive item words, a block is the last one
to three words of the search window. A table says for each block how far the search may move on;
a block that ends a pattern selects a bucket, and comparing the words confirms the occurrence.
No shuffle: documents stream once past patterns of a bounded size.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import arrow_columns, plain_names, table

WINDOW_WORDS = 10
# Item text searched for at a time. More text means further passes of the same kind, one after
# the other in one plan, so what a task holds does not grow with the benchmark.
BLOCK_BYTES = 4 << 20

# A-Z to a-z; every other ASCII byte that is not a letter or digit separates words.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256))

RESULT = ("n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, "
          "contaminated boolean")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search tables for word patterns of one length or of several, one table set per length."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[str]]):
        by_length = defaultdict(dict)
        for words, items in patterns.items():
            by_length[len(words)][words] = items
        self.groups = []
        for length, group in sorted(by_length.items()):
            block = min(3, length)
            shift: dict = {}
            buckets: dict = defaultdict(dict)
            for words, items in group.items():
                for end in range(block, length + 1):
                    key = words[end - block:end]
                    shift[key] = min(shift.get(key, length), length - end)
                buckets[words[length - block:]][words] = items
            self.groups.append((length, block, shift, dict(buckets)))

    def search(self, words: list[bytes]):
        """Every occurrence as (first word, number of words, items)."""
        count = len(words)
        for length, block, shift, buckets in self.groups:
            longest = length - block + 1
            at = length
            while at <= count:
                key = tuple(words[at - block:at])
                step = shift.get(key, longest)
                if step:
                    at += step
                    continue
                items = buckets[key].get(tuple(words[at - length:at]))
                if items:
                    yield at - length, length, items
                at += 1


def windows(words: list[bytes], size: int = WINDOW_WORDS) -> list[tuple[bytes, ...]]:
    """The windows of an item: all runs of `size` words, or the whole item if it has fewer."""
    if len(words) <= size:
        return [tuple(words)] if words else []
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def mark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
         item_text: str = "text", size: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`docs` with n_words, n_hit, n_items, items_sha256 and contaminated.

    A null or empty text has no words and no hits; a null or empty item has no windows; an item
    without id counts as `null`; rows of one id are one item; repeated document rows are judged
    each for itself. Documents may be of any length. A result column replaces one of its name.
    """
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"),
                         F.col(item_text).cast("binary").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out, names = plain_names(docs)
    out = out.withColumns({"wm_hits": F.lit(None).cast("binary"), "wm_items": F.lit(None).cast("array<string>")})
    for block in range(blocks):
        chosen = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        held = spark.sparkContext.broadcast([(r.id, bytes(r.text)) for r in chosen.collect()])
        out = _pass(out, held, names[text], size, block == blocks - 1)
    added = [c for c in out.columns if c not in names.values() and not c.startswith("wm_")]
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c.lower() not in added], *added)


def _pass(docs: DataFrame, held, text: str, size: int, last: bool) -> DataFrame:
    def open_task():
        patterns = defaultdict(set)
        for item, content in held.value:
            for window in windows(words_of(content), size):
                patterns[window].add(item)
        search = WuManber(patterns).search

        def compute(batch):
            for content, hits, items in zip(batch["text"], batch["hits"], batch["items"], strict=True):
                words = words_of(content)
                found = set(items or ())
                hits = bytearray(hits) if hits else None
                for start, length, ids in search(words):
                    if hits is None:
                        hits = bytearray(len(words))
                    hits[start:start + length] = b"\1" * length
                    found |= ids
                names = sorted(found)
                if not last:
                    yield (bytes(hits) if hits else None, names)
                    continue
                n_hit = sum(hits) if hits else 0
                yield (len(words), n_hit, len(names),
                       hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0)

        return compute

    return arrow_columns(
        docs, {"text": text, "hits": F.col("wm_hits"), "items": F.col("wm_items")},
        RESULT if last else "wm_hits binary, wm_items array<string>", open_task)


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    rows, names = plain_names(docs)
    marked = mark(rows, items, names[options.pop("text", "text")], **options)
    return marked.where("not contaminated").select(*[F.col(n).alias(c) for c, n in names.items()])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark(docs, table(spark, sf_dir, "benchmark")).drop("text")


# One row per document word and per item window; windows meet documents on their text.
ORACLE_SQL = r"""
with item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
item_windows as (
  select distinct item_id, win, len(win) as n from (
    select item_id, unnest(list_transform(range(1, greatest(2, len(w) - 8)),
      lambda i: w[i : i + 9])) win from item_words where len(w) > 0)),
doc_words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
positions as (
  select doc_id, s, n, w[s : s + n - 1] win from (
    select doc_id, w, n, unnest(range(1, len(w) - n + 2)) s
    from doc_words, (select distinct n from item_windows) where len(w) >= n)),
found as (select p.doc_id, p.s, p.n, i.item_id from positions p join item_windows i on p.win = i.win),
hit as (select doc_id, count(distinct pos) n_hit from (
  select doc_id, unnest(range(s, s + n)) pos from found) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
  from (select distinct doc_id, item_id::varchar item_id from found) group by doc_id)
select d.doc_id, len(d.w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit,
  coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256,
  coalesce(n_hit, 0) > 0 contaminated
from doc_words d left join hit using (doc_id) left join items using (doc_id)
"""
