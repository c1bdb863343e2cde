"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in `links` (a, b).

    Links from a node to itself, repeated links and links with a null end are of no account. Each
    round makes paths shorter by about half. A node's neighbours are never collected: rounds are
    minima and joins, and the minima are written first, so that the join with a hot node's links can
    be split between tasks.
    """
    links = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    links = stored(links.where("lo is not null and hi is not null and lo < hi").distinct(), "links")
    seen = None
    while True:
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64("lo", "hi"))).first()
        if mark == seen:
            break
        seen = mark
        both = links.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m")), "links")
        # Every larger neighbour of u now hangs on the smallest of u's neighbourhood ...
        large = (both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
                 .where("lo < hi").distinct())
        # ... and every node and its smaller neighbours on the smallest of those.
        root = large.groupBy("hi").agg(F.min("lo").alias("root"))
        small = large.join(root, "hi").select(F.col("root").alias("lo"), F.col("lo").alias("hi")).where("lo < hi").union(
            root.select(F.col("root").alias("lo"), "hi"))
        links = stored(small.distinct(), "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        links.select("lo").distinct().select("lo", "lo"))
