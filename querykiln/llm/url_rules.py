"""URL filter rules, by a sort-merge range join with a sweep over nested rules.

A host is keyed by its reversed characters and a closing dot, so a rule's host and all its
subdomains are one interval of keys: `net` is `ten.` up to, not including, `ten/`. Such intervals
nest or are apart. Each boundary carries the stack of rules active from there on, and one sorted
sweep over boundaries and urls hands every url the stack of the last boundary before it. Urls are
dealt out evenly, whatever their hosts, and the boundaries go to every portion.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querykiln.llm.common import partitions, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#`, in lower case; empty without `://`."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.reverse(host), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """key, stack: the rules active from `key` on, up to the next boundary.

    A stack holds the rules of one host and of the hosts above it. The hosts above are looked up
    by the prefixes of the key that end in a dot, so rules never meet in pairs.
    """
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), string.ascii_uppercase, string.ascii_lowercase).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host != ''").distinct()
    hosts = rules.groupBy(host_key(F.col("host")).alias("key")).agg(
        F.collect_list(F.struct("host", "path", "verdict")).alias("own"))
    dots = F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.substr("key", i, F.lit(1)) == ".")
    above = hosts.select("key", F.explode(F.transform(dots, lambda i: F.substr("key", F.lit(1), i))).alias("prefix"))
    stacks = (above.join(hosts.select(F.col("key").alias("prefix"), "own"), "prefix")
              .groupBy("key").agg(
                  F.flatten(F.collect_list("own")).alias("stack"),
                  F.flatten(F.collect_list(F.when(F.col("prefix") != F.col("key"), F.col("own")))).alias("parent")))
    return stacks.select("key", "stack").union(stacks.select(
        F.concat(F.expr("left(key, length(key) - 1)"), F.lit("/")), F.col("parent")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """`pages` with host, path, rule and verdict; DataFrame functions only.

    `rules` has host, path, verdict. A rule fits its host and all subdomains if the url's path
    starts with the rule's path; the longest rule (host and path together) wins, between equally
    long ones the longer host, then `block`. A url that is null, empty or without `://` has an
    empty host and path and fits no rule; a rule without host fits nothing; repeated rows stay
    repeated. A result column replaces one of its name. A sweep row carries all rules of its
    host's chain: thousands of paths under one host belong in a table of their own.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    portions = 4 * partitions(spark)
    urls = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path"),
        F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(portions)).cast("int").alias("portion"))
    marks = boundaries(rules).select(
        "key", "stack", F.explode(F.sequence(F.lit(0), F.lit(portions - 1))).alias("portion"))
    events = urls.select("row", "host", "path", "portion", host_key(F.col("host")).alias("key"),
                         F.lit(True).alias("is_url")).unionByName(
        marks.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    sweep = (Window.partitionBy("portion").orderBy("key", "is_url")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = events.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("is_url")
    fitting = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fitting, lambda r: F.struct(
        (F.length(r["host"]) + F.length(r["path"])).alias("length"), F.length(r["host"]).alias("host_length"),
        (r["verdict"] == "block").alias("blocks"), F.concat(r["host"], r["path"]).alias("rule"),
        r["verdict"].alias("verdict")))
    best = swept.withColumn("best", F.array_max(ranked))
    return best.select(*[F.col(f"row.`{c}`") for c in kept], "host", "path", F.col("best.rule").alias("rule"),
                       F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL = r"""
with cut as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path
  from pages),
rules(h, p, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
judged as (
  select page_id, host, path, (
    select {'n': length(h || p), 'rule': h || p, 'verdict': v} from rules
    where (host = h or suffix(host, '.' || h)) and starts_with(path, p)
    order by length(h || p) desc limit 1) best
  from cut)
select page_id, host, path, best.rule as rule, coalesce(best.verdict, 'allow') verdict from judged
"""
