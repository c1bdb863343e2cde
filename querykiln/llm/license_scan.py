"""License texts inside documents, by voting along diagonals.

Every run of K words of every document is joined, as a hash, with the positions of the templates. A hit at
word i of the document and word j of the template votes for the diagonal i - j; votes are added up, and
diagonals of a long template that lie close together (a word put in or left out) become one span. A span
with enough votes is verified: the words along its diagonals are compared with those of the template.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.llm.common import arrow_columns, stored, table
from querykiln.llm.decontamination import _FOLD, words_of
from querykiln.llm.words import gram_hashes, word_hashes

# Phrases that name a license, and the notices by which texts are put under one.
PHRASES = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
            "the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
)
TEMPLATES = PHRASES + NOTICES
SHORT = 8            # words of a template that must be there as they are
K_SHORT, K_LONG = 2, 4
GAP = 8              # diagonals of a template of GAP words a step apart are neighbours
VOTES = 0.25         # share of a template's hashes that make a span worth verifying
COVERED = 0.8        # share of a long template's words that makes a span a finding
GRAMS_A_ROW = 1 << 12
BROADCAST_GRAMS = 1 << 17  # more positions of templates than this are joined in a shuffle

RESULT = "n_words long, spans array<struct<template int, label string, start long, stop long, score double>>"


def _template_words(templates) -> list[list[bytes]]:
    return [words_of(t.encode()) for _, t in templates]


def _k(words: list[bytes]) -> int:
    return K_SHORT if len(words) < SHORT else K_LONG


def _hashes(texts: list[bytes | None], k: int):
    """(text number, hashes of its runs of k words) of the texts that have any."""
    words, owner = word_hashes([(t or b"").translate(_FOLD) for t in texts])
    numbers, begin, count = np.unique(owner, return_index=True, return_counts=True)
    for n, b, c in zip(numbers, begin, count, strict=True):
        if c >= k:
            yield n, gram_hashes(words[b:b + c], k).view(np.int64)


def _template_rows(spark: SparkSession, templates) -> DataFrame:
    rows = []
    for number, words in enumerate(_template_words(templates)):
        k = _k(words)
        for _, hashes in _hashes([b" ".join(words)], k):
            rows += [(k, int(h), number, j, len(words)) for j, h in enumerate(hashes)]
    frame = spark.createDataFrame(rows, "k int, h long, template int, j int, words int")
    return F.broadcast(frame) if len(rows) <= BROADCAST_GRAMS else frame


def _key(text: str) -> Column:
    """128 bits of a text, by which its candidates find back to it."""
    return F.unhex(F.md5(F.col(f"`{text}`").cast("binary"))).alias("text_key")


def candidates(docs: DataFrame, text: str = "text", templates=TEMPLATES) -> DataFrame:
    """text_key, spans: by text (a 128-bit hash), template and diagonals of the spans to be verified.

    Equal texts vote once. Votes are rows of (text, template, diagonal, position), added up where
    they arise; a long text's hits are rows like those of others.
    """
    spark = docs.sparkSession
    sizes = sorted({_k(w) for w in _template_words(templates)})

    def grams(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for k in sizes:
                for n, hashes in _hashes(texts, k):
                    parts = range(0, len(hashes), GRAMS_A_ROW)
                    yield pa.RecordBatch.from_pydict({
                        "text_key": pa.array([batch.column(0)[int(n)].as_py()] * len(parts), pa.binary()),
                        "k": pa.array([k] * len(parts), pa.int32()), "first": pa.array(list(parts), pa.int64()),
                        "hashes": pa.array([hashes[i:i + GRAMS_A_ROW] for i in parts], pa.list_(pa.int64()))})

    rolled = docs.select(_key(text), F.col(f"`{text}`").cast("binary").alias("text")).mapInArrow(
        grams, "text_key binary, k int, first long, hashes array<long>")
    rolled = rolled.select("text_key", "k", "first", F.posexplode("hashes").alias("at", "h"))
    hits = rolled.join(_template_rows(spark, templates), ["k", "h"]).select(
        "text_key", "template", "words", "k", (F.col("first") + F.col("at") - F.col("j")).alias("diagonal"), "j").distinct()
    votes = hits.groupBy("text_key", "template", "words", "k", "diagonal").agg(F.count("*").alias("votes"))
    # Neighbouring diagonals: a step wider than the template allows begins a new span.
    along = Window.partitionBy("text_key", "template").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(along)
    new = (step > F.when(F.col("words") < SHORT, 0).otherwise(F.call_function("div", "words", F.lit(GAP)))).cast("int")
    spans = votes.withColumn("new", F.coalesce(new, F.lit(0))).withColumn("span", F.sum("new").over(along))
    spans = spans.groupBy("text_key", "template", "words", "k", "span").agg(
        F.sum("votes").alias("votes"), F.array_sort(F.collect_list("diagonal")).alias("diagonals"))
    worth = F.col("votes") >= VOTES * (F.col("words") - F.col("k") + 1)
    return spans.where(worth).groupBy("text_key").agg(F.collect_list(F.struct("template", "diagonals")).alias("spans"))


def _verified(words: list[bytes], template: list[bytes], diagonals: list[int]) -> float:
    """Share of the template's words that stand on one of the diagonals."""
    covered = 0
    for t, word in enumerate(template):
        covered += any(0 <= t + d < len(words) and words[t + d] == word for d in diagonals)
    return covered / len(template)


def scan(docs: DataFrame, text: str = "text", templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """`docs` with n_words and spans (template, label, start, stop, score), by start and template.

    Short templates (phrases) are found where their words stand consecutively, at every place; of long
    ones (notices) the share `covered` is enough, and places of one span are one finding, from its first
    diagonal to the end of its last. Words are counted from 0. Null and empty texts have no words; equal
    rows are judged each for itself; very long texts are scanned whole; result columns replace columns
    of their names.
    """
    # Written, so that Spark sees its size: a small table comes to the texts, otherwise both are shuffled.
    found = stored(candidates(docs, text, templates), "licenses")
    words_by_template, labels = _template_words(templates), [label for label, _ in templates]
    joined = docs.select(_key(text), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("row"),
                         F.col(f"`{text}`").alias("text")).join(found, "text_key", "left").drop("text_key")

    def open_task():
        def compute(batch):
            for content, spans in zip(batch["text"], batch["spans"], strict=True):
                words, out = words_of(content), []
                for span in spans or ():
                    template, diagonals = words_by_template[span["template"]], span["diagonals"]
                    score = _verified(words, template, diagonals)
                    if score >= (1 if len(template) < SHORT else covered):
                        out.append((max(0, diagonals[0]), span["template"], min(len(words), diagonals[-1] + len(template)), score))
                yield len(words), [{"template": t, "label": labels[t], "start": a, "stop": z, "score": s}
                                   for a, t, z, s in sorted(out)]

        return compute

    judged = arrow_columns(joined.withColumnRenamed("spans", "diagonals"), {"text": "text", "spans": "diagonals"}, RESULT, open_task)
    return judged.select(*[F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns
                           if c.lower() not in ("n_words", "spans")], "n_words", "spans")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base places, labels and the best score of every document; nulls, ties and repeats as `scan` says."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["template"] < len(PHRASES))
    starts = F.transform(base, lambda s: s["start"])

    def labels(spans):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"))


def _sql_templates() -> str:
    return ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(TEMPLATES))


def _sql_grams(k: int) -> str:
    words = ", ".join(["word", *[f"lead(word, {i}) over (partition by r order by i)" for i in range(1, k)]])
    return f"select * from (select r, {k} k, i, [{words}] gram from words) where gram[{k}] is not null"


# The same definition word by word: hits, diagonals, spans, and the words along them.
ORACLE_SQL = rf"""
with templates as (
  select n t, label, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from (values {_sql_templates()}) v(n, label, body)),
shapes as (select *, len(w) m, case when len(w) < {SHORT} then {K_SHORT} else {K_LONG} end k,
  case when len(w) < {SHORT} then 0 else len(w) // {GAP} end gap from templates),
docs as (
  select row_number() over () r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w from documents),
template_grams as (select t, k, unnest(range(0, m - k + 1)) j from shapes),
template_hits as (select g.t, g.k, g.j, s.w[g.j + 1 : g.j + g.k] gram from template_grams g join shapes s using (t)),
words as (select r, unnest(w) word, unnest(range(0, len(w))) i from docs),
doc_grams as ({" union all ".join(map(_sql_grams, (K_SHORT, K_LONG)))}),
votes as (select r, t, i - j d, count(*) votes from doc_grams join template_hits using (k, gram) group by all),
steps as (select v.*, s.m, s.k, coalesce((d - lag(d) over (partition by r, t order by d) > s.gap)::int, 0) fresh
  from votes v join shapes s using (t)),
spans as (select *, sum(fresh) over (partition by r, t order by d) span from steps),
worth as (select r, t, span, list(d) ds, min(d) a, max(d) z from spans group by r, t, span, m, k
  having sum(votes) >= {VOTES} * (m - k + 1)),
lines as (select x.r, x.t, x.span, x.a, unnest(x.ds) d from worth x),
template_words as (select t, unnest(w) word, unnest(range(0, m)) j from shapes),
compared as (select l.r, l.t, l.span, p.j, coalesce(bool_or(c.word = p.word), false) same
  from lines l join template_words p using (t) left join words c on c.r = l.r and c.i = l.d + p.j
  group by l.r, l.t, l.span, p.j),
scored as (select r, t, span, count(*) filter (same) / count(*) score from compared group by all),
found as (select c.r, c.t, s.label, greatest(0, x.a) a, c.score from scored c join shapes s using (t) join worth x using (r, t, span)
  where c.score >= case when s.m < {SHORT} then 1 else {COVERED} end)
select d.doc_id, len(d.w)::bigint n_words, count(f.t) filter (f.t < {len(PHRASES)}) n_base,
  min(f.a) filter (f.t < {len(PHRASES)}) first_word, max(f.a) filter (f.t < {len(PHRASES)}) last_word,
  coalesce(string_agg(distinct f.label, ',' order by f.label) filter (f.t < {len(PHRASES)}), '') base_labels,
  coalesce(string_agg(distinct f.label, ',' order by f.label), '') labels, coalesce(max(f.score), 0)::double score
from docs d left join found f using (r) group by d.r, d.doc_id, d.w
"""
