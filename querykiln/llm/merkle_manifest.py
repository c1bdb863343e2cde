"""A Merkle tree over a data set: leaves in id order per source, a proof for every row.

Where a row's leaf stands is not found by sorting leaves. Ids are merged into compressed bitmaps, a row
for each 64-bit word of a source that has an id; bit counts, summed up in a directory of four levels of
16 bits, say how many rows stand before a word, and the bits below an id in its word say the rest.

The tree is then reduced by keyed slot arrays: several levels at a time, each block of leaves is
one group, whose nodes are put into their slots and hashed. On the way back each block gets the
proof of its own node, and proves its leaves.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.llm.common import stored, table

FANOUT = 3
BLOCK = FANOUT ** 7         # nodes of a block, and so seven levels of the tree at a time
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NO_WORD = -(1 << 63)        # stands for a null id; no id has this word, since words are ids divided by 64
DIRECTORY_LEVELS = 4        # of 16 bits each: ids divided by 64 have 58 bits


def leaf(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each `-` if null, else its UTF-8 length, a colon and itself."""
    texts = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """`rows` with `number`, rising in `order` over all of them but not without gaps; ranges are sorted apart."""
    return stored(rows.orderBy(*order).withColumn("number", F.monotonically_increasing_id()), "manifest")


def _dense(rows: DataFrame, name: str) -> DataFrame:
    """`numbered` rows with `name` from 0 without gaps: the rows of all earlier ranges plus the place in its own."""
    ranges = rows.groupBy(F.shiftright("number", 33).alias("range")).agg(F.count("*").alias("rows"))
    ranges = ranges.select("range", (F.sum("rows").over(Window.orderBy("range")) - F.col("rows")).alias("skipped"))
    return rows.withColumn("range", F.shiftright("number", 33)).join(ranges, "range").withColumn(
        name, F.col("skipped") + F.col("number").bitwiseAND((1 << 33) - 1)).drop("range", "skipped", "number")


def positions(rows: DataFrame) -> DataFrame:
    """`rows` (rid, src, doc_id, leaf and others) with position: from 0 by doc_id within src, which is not null.

    Null ids stand first. Rows of one id stand in the order of their leaves; equal leaves have equal
    digests, so their order (by rid) changes no node. Only rows whose word holds an id twice, or is
    that of null ids, are ordered by a distributed sort; the places of all others are counted.
    """
    known, columns = F.col("doc_id").isNotNull(), rows.columns
    bit = F.col("doc_id").bitwiseAND(63).cast("int")
    rows = rows.withColumn("word", F.when(known, F.shiftright("doc_id", 6)).otherwise(NO_WORD))
    words = rows.groupBy("src", "word").agg(
        F.bit_or(F.when(known, F.call_function("shiftleft", F.lit(1).cast("long"), bit))).alias("bits"), F.count("*").alias("n"))
    words = stored(words.withColumn("counted", F.coalesce(F.col("n") == F.bit_count("bits"), F.lit(False))), "manifest")
    placed = rows.join(_before(words), ["src", "word"])
    lower = F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), bit))
    alone = placed.where("counted").select(*columns, (F.col("before") + F.bit_count(
        F.col("bits").bitwiseAND(lower))).alias("position"))
    if words.where("not counted").isEmpty():
        return alone
    tied = numbered(placed.where("not counted").drop("bits", "counted"), "src", "word", "doc_id", "leaf", "rid")
    dense = _dense(tied, "at")
    first = dense.groupBy("src", "word").agg(F.min("at").alias("first"))
    return alone.union(dense.join(first, ["src", "word"]).select(
        *columns, (F.col("before") + F.col("at") - F.col("first")).alias("position")))


def _before(words: DataFrame) -> DataFrame:
    """`words` with `before`: rows of the source in earlier words, by a directory of 16 bits a level.

    No window holds more than 65,536 rows, whatever the ids are.
    """
    levels = [words.withColumnRenamed("word", "k0")]
    for i in range(1, DIRECTORY_LEVELS):
        levels.append(levels[-1].groupBy("src", F.shiftright(f"k{i - 1}", 16).alias(f"k{i}")).agg(F.sum("n").alias("n")))
    top = DIRECTORY_LEVELS - 1
    earlier = F.sum("n").over(Window.partitionBy("src").orderBy(f"k{top}")) - F.col("n")
    level = levels[top].withColumn("before", earlier)
    for i in range(top - 1, -1, -1):
        key = ["src", f"k{i + 1}"]
        earlier = F.sum("n").over(Window.partitionBy(*key).orderBy(f"k{i}")) - F.col("n")
        above = level.select(*key, F.col("before").alias("base"))
        level = levels[i].withColumn(key[1], F.shiftright(f"k{i}", 16)).withColumn("own", earlier).join(above, key).withColumn(
            "before", F.col("base") + F.col("own"))
    return level.select("src", F.col("k0").alias("word"), "bits", "counted", "before")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def layers(rows: pa.Table, block: int) -> list[list[str]]:
    """The nodes of a block in their slots, and those of each level above them."""
    n, first = rows["n"][0].as_py(), rows["block"][0].as_py() * block
    nodes = [""] * rows.num_rows
    for at, h in zip(rows["at"].to_pylist(), rows["h"].to_pylist(), strict=True):
        nodes[at - first] = h
    out, wide = [nodes], 1
    while wide < min(n, block):
        wide *= FANOUT
        out.append([digest("".join(out[-1][i:i + FANOUT])) for i in range(0, len(out[-1]), FANOUT)])
    return out


def proofs(levels: list[list[str]], above: str) -> list[str]:
    """For each node of the lowest level its place in the run and its siblings, level by level, then `above`."""
    paths = [above]
    for nodes in reversed(levels[:-1]):
        paths = [
            str(i % FANOUT) + "".join(nodes[i - i % FANOUT:i] + nodes[i + 1:i - i % FANOUT + FANOUT])
            + ("/" + paths[i // FANOUT] if paths[i // FANOUT] else "") for i in range(len(nodes))]
    return paths


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.call_function("div", "at", F.lit(block)).cast("long"))


def _grown(nodes: DataFrame, block: int) -> list[DataFrame]:
    """Nodes of every round (src, at, h, n): the given ones, then one per block, until each src has one."""
    kind = "src string, at long, h string, n long"

    def reduced(rows: pa.Table) -> pa.Table:
        return pa.table({"src": rows["src"].slice(0, 1), "at": rows["block"].slice(0, 1), "h": layers(rows, block)[-1],
                         "n": [-(-rows["n"][0].as_py() // block)]})

    most = nodes.agg(F.max("n")).first()[0]
    rounds = [nodes]
    while most > 1:
        rounds.append(stored(_blocked(rounds[-1].select("src", "at", "h", "n"), block).groupBy("src", "block").applyInArrow(
            reduced, kind), "manifest"))
        most = -(-most // block)
    return rounds


def _descended(rounds: list[DataFrame], paths: DataFrame, block: int) -> DataFrame:
    """The first round's nodes with path and subroot, from those (src, at, path, subroot) of the last."""
    def proved(rows: pa.Table, above: pa.Table) -> pa.Table:
        first = rows["block"][0].as_py() * block
        found = proofs(layers(rows, block), above["path"][0].as_py())
        own = [found[i - first] for i in rows["at"].to_pylist()]
        return rows.append_column("path", pa.array(own, pa.string())).append_column(
            "subroot", pa.repeat(above["subroot"][0], len(own)))

    for i in range(len(rounds) - 2, -1, -1):
        nodes = _blocked(rounds[i], block)
        above = paths.select("src", F.col("at").alias("block"), "path", "subroot")
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
        paths = nodes.groupBy("src", "block").cogroup(above.groupBy("src", "block")).applyInArrow(
            proved, f"{kind}, path string, subroot string")
        if i:
            paths = stored(paths.select("src", "at", "path", "subroot"), "manifest")
    return paths


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, doc_id: str = "doc_id", source: str = "source",
             extra: dict[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof: a row per row of `docs`; and `extra` columns.

    A leaf is the digest of the row's fields. Per source, leaves ascend by the integer doc_id (nulls
    first, equal ids by leaf) and runs of three become their digest until one node is left; the
    sources' nodes, ordered by source (null first, then UTF-8 order), become the root alike. `proof` has a
    level after the other from the leaf to the root, divided by `/`: the place of the node in its run, and
    the run's other digests. It is empty if the row is the only one. `verified` folds it.

    Nulls in any field, empty and very long texts and repeated rows are leaves like others. Other
    columns are not read, so their names do not matter; an empty table gives no row.
    """
    extra = extra or {}
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        # With a mark in front, a null source is a value before all others, and joins.
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source}`").cast("string")), F.lit("")).alias("src"),
        leaf([F.col(f"`{c}`") for c in fields]).alias("leaf"), *[c.alias(f"extra_{name}") for name, c in extra.items()])
    rows = stored(rows, "manifest")
    wanted = ["doc_id", "source", "leaf", "subroot", "root", "path", *extra]
    sizes = rows.groupBy("src").agg(F.count("*").alias("n"))
    nodes = stored(positions(rows).join(sizes, "src").withColumnsRenamed({"leaf": "h", "position": "at"}).drop("rid"), "manifest")
    if nodes.isEmpty():
        return nodes.select(*[F.lit(None).cast("long" if c == "doc_id" else "string").alias(c if c != "path" else "proof")
                              for c in wanted])
    rounds = _grown(nodes, block)
    top = _dense(numbered(rounds[-1].select(F.col("src").alias("own"), "h"), "own"), "at")
    top = stored(top.select(F.lit("").alias("src"), "at", "h", F.lit(rounds[-1].count()).alias("n"), "own"), "manifest")
    top_rounds = _grown(top, block)
    root = top_rounds[-1].first()["h"]
    none = F.lit("")
    named = _descended(top_rounds, top_rounds[-1].select("src", "at", none.alias("path"), none.alias("subroot")), block)
    if len(top_rounds) == 1:
        named = top.withColumn("path", none)
    paths = named.select(F.col("own").alias("src"), F.lit(0).cast("long").alias("at"), "path", F.col("h").alias("subroot"))
    out = _descended(rounds, paths, block) if len(rounds) > 1 else nodes.join(paths.drop("at"), "src")
    return out.select("doc_id", F.when(F.col("src") != "", F.substring("src", 2, 1 << 30)).alias("source"), F.col("h").alias("leaf"),
                      "subroot", F.lit(root).alias("root"), F.col("path").alias("proof"),
                      *[F.col(f"extra_{name}").alias(name) for name in extra])


def fold(leaf_digest: str, proof: str) -> str:
    """The root that a leaf and its proof give."""
    for level in filter(None, proof.split("/")):
        cut = 1 + 64 * int(level[0])
        leaf_digest = digest(level[1:cut] + leaf_digest + level[cut:])
    return leaf_digest


def folded(rows: DataFrame, leaf_column: str = "leaf") -> DataFrame:
    """`rows` of a manifest with folded_root, from `leaf_column`, and proof_sha256, of all sibling digests in order."""
    names = rows.columns

    def run(batches):
        for batch in batches:
            proof = batch.column("proof").to_pylist()
            roots = [fold(h, p) for h, p in zip(batch.column(leaf_column).to_pylist(), proof, strict=True)]
            sums = [digest("".join(level[1:] for level in p.split("/"))) for p in proof]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string()), pa.array(sums, pa.string())],
                                             names=[*names, "folded_root", "proof_sha256"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kind}, folded_root string, proof_sha256 string")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of `documents`, and every row verified after line feeds were taken out of some texts.

    A row without doc_id is never tampered with; all else as `manifest` says.
    """
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.contains("text", F.lit("\n"))
    changed = [F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    rows = manifest(docs, extra={"tampered": F.when(chosen, leaf(changed))})
    rows = folded(rows.withColumn("seen", F.coalesce("tampered", "leaf")), "seen")
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))


_SQL_FIELD = "coalesce(strlen({0}) || ':' || {0}, '-')"
_SQL_LEAF = "sha256(" + " || ".join(_SQL_FIELD.format(f"{c}::varchar") for c in FIELDS[:-1]) + " || " + _SQL_FIELD + ")"
ORACLE_SQL = rf"""
with recursive docs as (
  select row_number() over () r, doc_id, source, {_SQL_LEAF.format("text")} leaf, {_SQL_LEAF.format("cut")} seen from (
    select *, case when doc_id is not null and xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
        string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda k, z: xor(k >> 1, case when k & 1 = 1 then 3988292384 else 0 end)::bigint)), 4294967295) % 2 = 0
      then replace(text, chr(10), '') else text end cut from documents)),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i,
  count(*) over (partition by source) n from docs),
nodes as (
  select 0 l, source, i, n, leaf h from leaves
  union all
  select l + 1, source, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from nodes where n > 1
  group by l, source, i // 3, n),
subs as (select source, h subroot, l height, row_number() over (order by source nulls first) - 1 i, count(*) over () n
  from nodes where n = 1),
tops as (
  select 0 l, i, n, subroot h from subs
  union all
  select l + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by l, i // 3, n),
runs as (
  select v.r, x.l, x.h, x.i, v.i // (3 ** x.l)::bigint own from leaves v join nodes x
    on x.source is not distinct from v.source and x.n > 1 and x.i // 3 = v.i // (3 ** (x.l + 1))::bigint
  union all
  select v.r, s.height + x.l, x.h, x.i, s.i // (3 ** x.l)::bigint from leaves v
    join subs s on s.source is not distinct from v.source join tops x on x.n > 1 and x.i // 3 = s.i // (3 ** (x.l + 1))::bigint),
steps as (select r, l, coalesce(string_agg(h, '' order by i) filter (i < own), '') a,
  coalesce(string_agg(h, '' order by i) filter (i > own), '') z from runs group by r, l),
fold as (
  select r, 0 l, seen h from docs
  union all
  select f.r, f.l + 1, sha256(s.a || f.h || s.z) from fold f join steps s on s.r = f.r and s.l = f.l),
ends as (select r, max_by(h, l) folded_root from fold group by r),
sums as (select r, sha256(string_agg(a || z, '' order by l)) proof_sha256 from steps group by r)
select v.doc_id, v.leaf, s.subroot, t.h root, coalesce(p.proof_sha256, sha256('')) proof_sha256, e.folded_root,
  e.folded_root = t.h verified
from leaves v join subs s on s.source is not distinct from v.source join tops t on t.n = 1 join ends e on e.r = v.r
left join sums p on p.r = v.r
"""
