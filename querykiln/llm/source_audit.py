"""How far the sources of a language differ in their words, from exact counts.

Texts are split into terms by Arrow's compute functions inside mapInArrow (`ascii_lower`,
`split_pattern_regex`, `dictionary_encode`, hash `group_by`), which gives partial counts; Spark merges
them. Terms that too few documents of their language hold are dropped, the other counts are dealt into
columnar shards: so many terms of a language by two blocks of its sources. A shard computes its part of
the divergence of every two sources, terms absent from a source included, and Spark adds the parts up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.llm.common import stored, table

MIN_DOCS = 10      # documents of a language that hold a term
TOP_TERMS = 10
SCALE = 10 ** 9    # probabilities are whole numbers of this
# A shard holds about so many terms of up to twice so many sources: about a million cells.
SHARD_TERMS = 1 << 12
SOURCE_BLOCK = 1 << 7
# Text that is split at once, and distinct (group, term) rows a task holds before it passes them on.
SLICE_BYTES = 1 << 20
HELD_ROWS = 1 << 18

SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_SEPARATOR = np.ones(256, dtype=bool)
_SEPARATOR[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it): a row per term of a group.

    A term is a run of ASCII letters (A-Z in lower case) and characters outside ASCII. A null text,
    language or source is an empty one; a group without terms has no row here.
    """
    names = ["lang", "source", "term", "n", "docs"]

    def run(batches):
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            for part in _slices(batch.column(2)):
                found = _split(part, batch)
                if found.num_rows:
                    held.append(found)
                    rows += found.num_rows
            if rows > HELD_ROWS:
                merged = _added(held)
                if merged.num_rows > HELD_ROWS // 2:
                    yield from merged.select(names).to_batches()
                    held, rows = [], 0
                else:
                    held, rows = [merged], merged.num_rows
        if held:
            yield from _added(held).select(names).to_batches()

    rows = docs.select(_text(lang).alias("lang"), _text(source).alias("source"), _text(text).alias("text"))
    partial = rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _text(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def _slices(texts: pa.Array):
    """(row numbers, texts) of bounded size; a longer text is cut between terms, with its row number again."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, length in enumerate(sizes):
        if size + length > SLICE_BYTES and i > begin:
            yield [(np.arange(begin, i), texts.slice(begin, i - begin))]
            begin, size = i, 0
        if length > SLICE_BYTES:
            yield [(np.array([i]), pa.array([p], pa.binary()).cast(pa.string())) for p in _cut(texts[i].as_py().encode())]
            begin = i + 1
        else:
            size += length
    if begin < len(sizes):
        yield [(np.arange(begin, len(sizes)), texts.slice(begin))]


def _cut(text: bytes):
    raw = np.frombuffer(text, dtype=np.uint8)
    at = 0
    while at < len(raw):
        end = min(at + SLICE_BYTES, len(raw))
        while end < len(raw) and not _SEPARATOR[raw[end]]:
            end += 1
        yield text[at:end]
        at = end


def _split(parts: list[tuple[np.ndarray, pa.Array]], batch: pa.RecordBatch) -> pa.Table:
    """Counts of the terms of a slice (or of the pieces of one text) by language and source."""
    per_row = []
    for numbers, texts in parts:
        pieces = pc.split_pattern_regex(pc.ascii_lower(texts), SEPARATORS)
        owner = pa.array(numbers).take(pc.list_parent_indices(pieces))
        terms = pc.list_flatten(pieces)
        solid = pc.greater(pc.binary_length(terms), 0)
        coded = terms.filter(solid).dictionary_encode()
        counts = pa.table({"row": owner.filter(solid), "code": coded.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
        per_row.append(pa.table({"row": counts["row"], "term": pc.take(coded.dictionary, counts["code"]), "n": counts["count_all"]}))
    rows = per_row[0]
    if len(per_row) > 1:  # the pieces of one text: it holds a term once
        rows = pa.concat_tables(per_row).group_by(["row", "term"]).aggregate([("n", "sum")]).rename_columns(["row", "term", "n"])
    return pa.table({"lang": batch.column(0).take(rows["row"].combine_chunks()), "source": batch.column(1).take(rows["row"].combine_chunks()),
                     "term": rows["term"], "n": rows["n"]}).group_by(["lang", "source", "term"]).aggregate(
        [("n", "sum"), ([], "count_all")]).rename_columns(["lang", "source", "term", "n", "docs"])


def _added(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate(
        [("n", "sum"), ("docs", "sum")]).rename_columns(["lang", "source", "term", "n", "docs"])


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shard_terms: int = SHARD_TERMS,
          source_block: int = SOURCE_BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: divergences from each other source, and telling terms.

    p of a term in a group (or q in its language) is 1 + floor(SCALE * (count + 2) / (N + 2 V)), V
    the kept terms of the language and N their occurrences; f = floor((p - q)^2 / (p + q)). Part
    `pair`: f summed over all kept terms against each other source of the language (0 without kept
    terms). Part `term`: f against the language, for terms of the group with p > q, the first `top`.

    Null texts, languages and sources count as empty ones; equal values are ranked by item, in UTF-8
    order; repeated rows count as often as they are there; an empty table gives no row; other
    columns are not read. Whole-number arithmetic throughout.
    """
    counts = stored(term_counts(docs, text, lang, source), "audit")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(
        F.col("docs") >= min_docs).select("lang", "term", "in_lang")
    kept = stored(counts.drop("docs").join(totals, ["lang", "term"]), "audit")
    sizes = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = docs.select(_text(lang).alias("lang"), _text(source).alias("source")).distinct()
    groups = stored(groups.join(own, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", F.coalesce("group_n", F.lit(0)).alias("group_n"), F.coalesce("v", F.lit(0)).alias("v"),
        F.coalesce("lang_n", F.lit(0)).alias("lang_n")), "audit")
    pairs = _pairs(kept, groups, shard_terms, source_block)
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return _terms(kept, groups).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", "value", "rank").union(
        pairs.withColumn("rank", F.row_number().over(ranked)).select(
            "lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _probability(count: str, total: str) -> Column:
    """Exact: a decimal of 30 digits holds the product, and `div` cuts off."""
    over = (F.col(count) + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.lit(1) + _div(over, (F.col(total) + 2 * F.col("v")).cast("decimal(20,0)"))


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    p, q = F.col("p"), F.col("q")
    return kept.join(groups, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _probability("n", "group_n").alias("p"),
        _probability("in_lang", "lang_n").alias("q")).where(p > q).select(
        "lang", "source", "item", _div((p - q) * (p - q), p + q).alias("value"))


def probabilities(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + 2) / total) in whole numbers, digit by digit so that nothing overflows.

    Exact for totals below 9e15, which is more words than a hundred petabytes of text.
    """
    rest = counts + 2
    out = rest // total
    for _ in range(3):
        rest = rest % total * 1000
        out = out * 1000 + rest // total
    return out + 1


def _pairs(kept: DataFrame, groups: DataFrame, shard_terms: int, source_block: int) -> DataFrame:
    """lang, source, item (another source), value for every two sources of a language."""
    plan = groups.groupBy("lang").agg(
        F.ceil(F.count("*") / source_block).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.max("v") / shard_terms)).cast("int").alias("shards"))
    own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")

    def tiled(rows: DataFrame, shard: Column, term: Column, n: Column, group_n: Column, v: Column) -> DataFrame:
        rows = rows.join(plan, "lang").withColumn("own", own).withColumn("shard", shard)
        return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
            "lang", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "shard", "own",
            "source", term.alias("term"), n.alias("n"), group_n.alias("group_n"), v.alias("v"))

    none = F.lit(None)
    # Every shard is told all sources of its blocks: one without a term there still has p > 0 for it.
    members = tiled(groups, F.explode(F.sequence(F.lit(0), F.col("shards") - 1)), none.cast("string"), none.cast("long"),
                    F.col("group_n"), F.col("v"))
    cells = tiled(kept, F.pmod(F.xxhash64("term"), F.col("shards")).cast("int"), F.col("term"), F.col("n"),
                  none.cast("long"), none.cast("long"))
    parts = members.union(cells).groupBy("lang", "i", "j", "shard").applyInArrow(
        _shard, "lang string, a string, b string, part long, terms long, absent long, v long")
    sums = parts.groupBy("lang", "a", "b").agg(
        # Terms that neither block has are equal for a pair: they are counted, not computed.
        (F.sum("part") + (F.max("v") - F.sum("terms")) * F.max("absent")).alias("value"))
    return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(
        sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))


def _shard(rows: pa.Table) -> pa.Table:
    """A shard's part of the divergence of every two sources, the number of its terms, f of absent terms."""
    member = pc.is_null(rows["term"])
    members, cells = rows.filter(member).combine_chunks(), rows.filter(pc.invert(member)).combine_chunks()
    sources, blocks = members["source"].combine_chunks(), members["own"].to_numpy()
    coded = cells["term"].combine_chunks().dictionary_encode()
    n_terms, v = len(coded.dictionary), members["v"][0].as_py()
    counts = np.zeros((len(sources), n_terms), dtype=np.int64)
    counts[pc.index_in(cells["source"].combine_chunks(), sources).to_numpy(), coded.indices.to_numpy()] = cells["n"].to_numpy()
    total = np.maximum(1, members["group_n"].to_numpy() + 2 * v)  # without kept terms nothing is summed up
    p = probabilities(counts, total[:, None])
    p0 = probabilities(np.zeros(len(sources), dtype=np.int64), total)
    same = rows["i"][0].as_py() == rows["j"][0].as_py()
    a, b, part, absent = [], [], [], []
    for r in range(len(sources)):
        others = np.arange(r + 1, len(sources))
        if not same:
            others = others[blocks[others] != blocks[r]]
        if len(others):
            d = p[others] - p[r]
            part.append((d * d // (p[others] + p[r])).sum(axis=1))
            d0 = p0[others] - p0[r]
            absent.append(d0 * d0 // (p0[others] + p0[r]))
            a.append(np.full(len(others), r))
            b.append(others)
    if not a:
        return _PARTS.empty_table()
    a = np.concatenate(a)
    return pa.table({
        "lang": pa.repeat(rows["lang"][0], len(a)), "a": sources.take(pa.array(a)), "b": sources.take(pa.array(np.concatenate(b))),
        "part": np.concatenate(part), "terms": np.full(len(a), n_terms), "absent": np.concatenate(absent),
        "v": np.full(len(a), v)}, schema=_PARTS)


_PARTS = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()),
                    *[(c, pa.int64()) for c in ("part", "terms", "absent", "v")]])


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`audit` of `documents`; nulls, ties, repeated rows and empty tables as it says."""
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLE_SQL = r"""
with docs as (
  select coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w, row_number() over () r from documents),
words as (select r, lang, source, unnest(w) term from docs),
kept as (select lang, term, count(*) c from words group by lang, term having count(distinct r) >= 10),
sizes as (select lang, count(*) v, sum(c) n from kept group by lang),
cells as (select lang, source, term, count(*) c from words join kept using (lang, term) group by all),
own as (select lang, source, sum(c) n from cells group by all),
groups as (select g.lang, g.source, coalesce(o.n, 0) n, coalesce(s.v, 0) v
  from (select distinct lang, source from docs) g left join own o using (lang, source) left join sizes s using (lang)),
grid as (
  select g.lang, g.source, k.term, (1 + 1000000000::hugeint * (coalesce(c.c, 0) + 2) // (g.n + 2 * g.v))::bigint p
  from groups g join kept k using (lang) left join cells c using (lang, source, term)),
pair as (
  select a.lang, a.source, b.source item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join grid x on x.lang = a.lang and x.source = a.source
  left join grid y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by a.lang, a.source, b.source),
tell as (
  select lang, source, term item, ((p - q) * (p - q) // (p + q))::bigint as value from (
    select c.lang, c.source, c.term, g.p, (1 + 1000000000::hugeint * (k.c + 2) // (s.n + 2 * s.v))::bigint q
    from cells c join grid g using (lang, source, term) join kept k using (lang, term) join sizes s using (lang))
  where p > q)
select lang, source, 'pair' part, item, value,
  row_number() over (partition by lang, source order by value desc, item)::int rank from pair
union all
select * from (select lang, source, 'term' part, item, value,
  row_number() over (partition by lang, source order by value desc, item)::int rank from tell) where rank <= 10
"""
