"""Key statistics and joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions.text import digest, normalize

# At most this many keys can each hold more than 1/HOT_KEYS of the rows, so the broadcast
# table of the most frequent keys has a proven bound whatever the data size.
HOT_KEYS = 1000


# The kinds of key, in the order of their number in the `kind` column.
KEY_LABELS = ["example_id", "seed_id", "question", "gold_sql"]


def label_of(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(label) for label in KEY_LABELS]), kind.cast("int") + 1)


def sft_keys(rows: DataFrame, order_col: str | None, labels: list[str] = KEY_LABELS) -> DataFrame:
    """The duplicate keys of each example as `(kind, key, ord)` rows.

    Ids are compared raw, texts normalised; a null is a value like any other. The kind is part
    of the digest, so one evenly distributed binary column is all that joins and groups.
    """
    values: dict[str, Column] = {
        "example_id": F.col("example_id"),
        "seed_id": F.col("seed_id"),
        "question": normalize(F.col("question_de")),
        "gold_sql": normalize(F.col("gold_sql")),
    }
    pairs = F.array(*[
        F.struct(
            F.lit(kind).cast("tinyint").alias("kind"),
            digest(F.coalesce(F.concat(F.lit(f"{kind}="), values[label]), F.lit(str(kind)))).alias("key"))
        for kind, label in enumerate(KEY_LABELS) if label in labels
    ])
    order = [F.col(order_col).alias("ord")] if order_col else []
    return rows.select(*order, F.explode(pairs).alias("k")).select(*(["ord"] if order_col else []), "k.*")


def key_profile(train_keys: DataFrame, eval_keys: DataFrame | None = None) -> DataFrame:
    """Per key: its kind, first position, number of copies, and whether the eval set has it.

    One hash aggregation with map-side combine: a key with any number of copies costs each
    map task one row. Keys without a second copy or eval match are dropped. Keys are never
    null; saying so here lets both users of the profile in `join_profile` share its exchange.
    """
    tagged = train_keys.select("kind", "key", "ord", F.lit(1).alias("n"), F.lit(False).alias("in_eval"))
    if eval_keys is not None:
        null_ord = F.lit(None).cast(train_keys.schema["ord"].dataType)
        tagged = tagged.unionByName(eval_keys.select(
            "kind", "key", null_ord.alias("ord"), F.lit(0).alias("n"), F.lit(True).alias("in_eval")))
    return (
        tagged.groupBy("key")
        .agg(F.max("kind").alias("kind"), F.min("ord").alias("first_ord"), F.sum("n").alias("copies"),
             F.max("in_eval").alias("in_eval"))
        .filter(F.col("key").isNotNull())
        .filter((F.col("copies") > 1) | (F.col("in_eval") & (F.col("copies") > 0)))
    )


def join_profile(train_keys: DataFrame, profile: DataFrame, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Rows `(label, ord)` whose key is in the profile, with the profile's columns; one pass over the rows.

    The most frequent keys meet their rows through a broadcast of at most `hot_keys` rows. In
    the shuffled join with all other keys these rows carry a spread-out stand-in for their key,
    so no task receives more than a 1/`hot_keys` share because of one key.
    """
    found = F.struct("first_ord", "copies", "in_eval")
    hot = profile.orderBy(F.col("copies").desc(), "key").limit(hot_keys).select("key", found.alias("hot"))
    cold = profile.select("key", found.alias("cold"))
    spread = F.concat(F.lit("hot "), F.hex(F.xxhash64("kind", "ord"))).cast("binary")
    marked = train_keys.join(F.broadcast(hot), "key", "left").withColumn(
        "key", F.when(F.col("hot").isNull(), F.col("key")).otherwise(spread))
    return (
        marked.join(cold, "key", "left").select("kind", "ord", F.coalesce("hot", "cold").alias("f"))
        .filter(F.col("f").isNotNull()).select(label_of(F.col("kind")).alias("label"), "ord", "f.*")
    )
