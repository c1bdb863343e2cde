"""Repeated word spans, by a de Bruijn graph of words whose paths follow their source.

The edges are windows of 20 words. Most windows occur once, so the graph is laid only where text can
repeat: every run of 15 six-word grams has a least one (its minimizer), equal windows have equal
minimizers, and a window whose minimizer occurs once occurs once. Edges of the rest meet by their
hash; the first coordinates of an edge are its source. Consecutive edges of a document whose
sources are consecutive too are one path without a branch: a repeated span with source coordinates.
A second hash must agree at the source before an edge counts as repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.llm.common import stored, table
from querykiln.llm.words import gram_hashes, plain, sliding, texts_by_key, word_hashes

WINDOW = 20
GRAM = 6
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
NO_ID = (1 << 63) - 1  # orders rows without an id last


def minimizers(words: np.ndarray, owner: np.ndarray, window: int, gram: int):
    """Grams, the least gram of each window (0 where a window leaves its text), and who is least."""
    grams = gram_hashes(words, gram)
    grams[owner[gram - 1:] != owner[:len(grams)]] = _LAST
    least = sliding(grams, window - gram + 1)
    least[owner[window - 1:] != owner[:len(least)]] = 0
    pad = np.zeros(window - gram, dtype=np.uint64)
    chosen = sliding(np.concatenate([pad, least, pad]), window - gram + 1, np.maximum) == grams
    return grams, least, chosen


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW,
          gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text, spans.

    `spans` are the repeated paths (first word, number of words, source id, first word there); a
    document whose whole text occurred earlier has one span. Earlier means a smaller id (integer),
    or the same id and an earlier start; a null id is the largest. Equal rows are one document and give
    equal results; rows of one id with different texts count as one document with several texts.
    A null or empty text, and one of fewer words than a window, loses nothing. Other columns are
    not read.
    """
    texts = texts_by_key(docs, doc_id, text, "spans")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    first = texts.where("body is not null").groupBy("text_key").agg(
        F.min(order).alias("first_id"), F.min_by("doc_key", F.struct(order, F.col("doc_key"))).alias("first_key"))
    first = stored(first, "spans")
    distinct = texts.join(first.select(F.col("first_key").alias("doc_key"), "first_id"), "doc_key")

    def anchors(batches):
        for batch in batches:
            words, owner = word_hashes(plain(batch.column(1)))
            if len(words) < window:
                continue
            grams, _, chosen = minimizers(words, owner, window, gram)
            at = np.flatnonzero(chosen)
            begin = np.searchsorted(owner, owner[at])
            keys = batch.column(0).to_numpy()[owner[at]]
            yield pa.RecordBatch.from_pydict({
                "h": grams[at].view(np.int64), "doc_key": keys, "pos": (at - begin).astype(np.int32)})

    anchor_rows = distinct.select("doc_key", "body").mapInArrow(anchors, "h long, doc_key long, pos int")
    # Written, so that the join with a gram that very many texts have can be split.
    again = stored(anchor_rows.groupBy("h").count().where("count > 1").select("h"), "spans")
    marks = stored(anchor_rows.join(again, "h", "left_semi").groupBy("doc_key").agg(
        F.collect_list("pos").alias("marks")), "spans")

    def edges(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for key, first_id, body, marked in zip(
                    *(batch.column(i).to_pylist() for i in (0, 1)), plain(batch.column(2)),
                    batch.column(3).to_pylist(), strict=True):
                words, owner = word_hashes([body])
                grams, least, _ = minimizers(words, owner, window, gram)
                hit = np.full(len(grams), _LAST)
                hit[marked] = grams[marked]
                starts = np.flatnonzero(sliding(hit, window - gram + 1) == least)
                for column, values in zip(out, (
                        gram_hashes(words, window, 2)[starts].view(np.int64),
                        (gram_hashes(words, window, 3)[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32),
                        np.full(len(starts), first_id), np.full(len(starts), key), starts.astype(np.int32)),
                        strict=True):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(
                    ("h", "check", "id", "doc_key", "start"), map(np.concatenate, out), strict=True)))

    # Made twice, for the sources and for the join with them: cheaper than the disk to keep them.
    edge_rows = distinct.join(marks, "doc_key").select("doc_key", "first_id", "body", "marks").mapInArrow(
        edges, "h long, check int, id long, doc_key long, start int")
    source = edge_rows.groupBy("h").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "start", "check")).alias("source")).where("n > 1")
    repeated = edge_rows.join(source.select("h", "source"), "h").where(
        "check = source.check and (id != source.id or start != source.start)")
    paths = repeated.groupBy("doc_key").agg(F.collect_list(
        F.struct("start", F.col("source.id").alias("id"), F.col("source.start").alias("at"))).alias("edges"))

    return _result(texts, first, paths, window, docs.schema[doc_id].dataType.simpleString())


def _result(texts: DataFrame, first: DataFrame, paths: DataFrame, window: int, kind: str) -> DataFrame:
    copies = (texts.where("body is not null").select("doc_key", "text_key").distinct()
              .join(first, "text_key").where("doc_key != first_key")
              .select("doc_key", F.col("first_id").alias("copy_of")))
    found = paths.join(copies, "doc_key", "full_outer")
    rows = texts.join(found, "doc_key", "left").select("doc_id", "body", "edges", "copy_of")
    span = "struct<start:int,length:int,source:bigint,source_start:int>"

    def run(batches):
        for batch in batches:
            out = [_judge(body, edges, copy, window) for body, edges, copy in zip(
                plain(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text", "spans"])

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct(
        [("start", pa.int32()), ("length", pa.int32()), ("source", pa.int64()), ("source_start", pa.int32())]))]
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<{span}>")


def _judge(body: bytes, edges: list[dict] | None, copy_of: int | None, window: int) -> tuple:
    words = body.split()
    found: list[dict] = []
    if copy_of is not None and len(words) >= window:
        found = [{"start": 0, "length": len(words), "source": copy_of, "source_start": 0}]
    for e in sorted(edges or (), key=lambda e: e["start"]):
        last = found[-1] if found else None
        if last and last["source"] == e["id"] and e["start"] - last["start"] == last["length"] - window + 1 == (
                e["at"] - last["source_start"]):
            last["length"] += 1
        else:
            found.append({"start": e["start"], "length": window, "source": e["id"], "source_start": e["at"]})
    kept = bytearray(b"\1") * len(words)
    for f in found:
        kept[f["start"]:f["start"] + f["length"]] = bytes(f["length"])
    rest = b" ".join([w for w, k in zip(words, kept, strict=True) if k]) if found else b" ".join(words)
    return (len(words), len(words) - sum(kept), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace"), found)


# Every window of every document; a window is repeated if its words also start earlier.
ORACLE_SQL = r"""
with words as (
  select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) w from documents),
windows as (
  select doc_id, s, array_to_string(w[s : s + 19], ' ') win from (
    select doc_id, w, unnest(range(1, len(w) - 18)) s from words where len(w) >= 20)),
earlier as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by win order by doc_id, s) n from windows)
  where n > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) pos from earlier),
removed as (select doc_id, list(pos) p, count(*) n from gone group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(n, 0)::bigint n_removed,
  sha256(case when n is null then array_to_string(w, ' ') else coalesce(array_to_string(
    list_filter(w, lambda x, i: not list_contains(p, i)), ' '), '') end) kept_sha256
from words left join removed using (doc_id)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")
