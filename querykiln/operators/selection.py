"""The value at a rank of sorted data, without sorting it: counts per range, then only the range that holds it.

Each pass reads the data once, adds up counts, minima and maxima of at most BINS ranges per rank (combined
on the map side), and goes on with the one range in which the rank falls, from its least to its greatest
value. It ends when that is one value, so results are exact; no task ever holds or orders the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from querykiln.session import kept

BINS = 4096


def _bin(value: Column, lo: Column, hi: Column) -> Column:
    """Number of the range of `value` between lo and hi, rising with it; lo and hi are in different ones."""
    wide = F.try_subtract(hi, lo)  # null if it overflows
    share = F.when(wide.isNull(), (value.cast("double") - lo.cast("double")) / (hi.cast("double") - lo.cast("double"))).otherwise(
        F.try_subtract(value, lo).cast("double") / wide.cast("double"))
    return F.floor(share * BINS).cast("int")


def _narrowed(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, name, rank, lo, hi after one pass over `cells` (by, w of name, rank, lo, hi; v)."""
    counts = cells.groupBy(*by, F.col("w.name").alias("name"), F.col("w.rank").alias("rank"),
                           _bin(F.col("v"), F.col("w.lo"), F.col("w.hi")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    before = F.sum("n").over(Window.partitionBy(*by, "name").orderBy("bin")) - F.col("n")
    return counts.withColumn("before", before).where("before <= rank and rank < before + n").select(
        *by, "name", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi")


def values_at(rows: DataFrame, value: str, ranks: list[int]) -> list:
    """Values at 0-based ranks of a numeric column; nulls are not ranked, a rank beyond the data has None."""
    rows = rows.select(F.col(value).alias("v")).where("v is not null")
    kind = rows.schema["v"].dataType
    n, lo, hi = rows.agg(F.count(F.lit(1)), F.min("v"), F.max("v")).first()
    out = dict.fromkeys(ranks)
    todo = {r: (r, lo, hi) for r in ranks if 0 <= r < n}
    while todo:
        out.update({r: a for r, (_, a, z) in todo.items() if a == z})
        todo = {r: x for r, x in todo.items() if x[1] != x[2]}
        if todo:
            wanted = F.array(*[F.struct(F.lit(r).alias("name"), F.lit(left).cast("bigint").alias("rank"), F.lit(a).cast(kind).alias("lo"),
                                        F.lit(z).cast(kind).alias("hi")) for r, (left, a, z) in todo.items()])
            cells = rows.select("v", F.explode(wanted).alias("w")).where("v between w.lo and w.hi")
            todo = {x["name"]: (x["rank"], x["lo"], x["hi"]) for x in _narrowed(cells, []).collect()}
    return [out[r] for r in ranks]


def values_by_group(rows: DataFrame, value: str, wanted: DataFrame, by: list[str]) -> DataFrame:
    """by, name, value at the ranks of `wanted`: by, name, rank, and lo and hi, the group's least and greatest value."""
    cols = [*by, "name", "rank", "lo", "hi"]
    rows = rows.select(*by, F.col(value).alias("v")).where("v is not null")
    state = kept(wanted.select(cols), "ranks")
    while not (rest := state.where("lo < hi")).isEmpty():
        # A group's ranks meet its rows as one list, as long as there are fractions; a null is a group too.
        lists = rest.groupBy(*by).agg(F.collect_list(F.struct("name", "rank", "lo", "hi")).alias("ws"))
        lists = lists.select(*[F.col(c).alias(f"key_{c}") for c in by], "ws")
        same = [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in by]
        cells = rows.join(lists, same).select(*by, "v", F.explode("ws").alias("w")).where("v between w.lo and w.hi")
        state = kept(state.where("not lo < hi").union(_narrowed(cells, by).select(cols)), "ranks")
    return state.select(*by, "name", F.col("lo").alias("value"))
