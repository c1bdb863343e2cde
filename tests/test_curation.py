import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from querykiln.functions.text import normalize
from querykiln.operators import chat, curation, lengths, selection


def test_quotas_nest_and_sum():
    quotas = curation.stratum_quotas([100, 250, 500, 1000], {"easy": 334, "medium": 333, "hard": 333})
    assert [sum(q.values()) for q in quotas.values()] == [100, 250, 500, 1000]
    for small, large in zip(list(quotas.values()), list(quotas.values())[1:]):
        assert all(small[k] <= large[k] for k in small)


def test_ablation_is_nested_and_stable(spark):
    frame = spark.createDataFrame(
        [(f"e{i}", ["easy", "medium", "hard", "hard", "other"][i % 5]) for i in range(400)],
        "example_id string, difficulty string")
    pick = lambda f: {r.example_id: (r.difficulty, r.smallest_subset) for r in curation.ablation_subsets(
        f, "s", [10, 40], {"easy": 1, "medium": 1, "hard": 1}).collect()}
    got = pick(frame)
    assert got == pick(frame.repartition(5))
    assert sum(v[1] == 10 for v in got.values()) == 10 and len(got) == 40
    assert {v[0] for v in got.values()} == {"easy", "medium", "hard"}


def test_dedup_gate(spark, rows):
    frame = spark.createDataFrame(
        [("b", 1, "X  y"), ("a", 1, "x y"), ("c", 0, "X Y "), ("d", 2, "z")], "example_id string, p int, t string")
    assert rows(curation.dedup_gate(frame, normalize(F.col("t")), ["p"])) == [(0, "c"), (2, "d")]


def test_next_version(spark, rows):
    make = lambda *v: spark.createDataFrame(list(v), "example_id string, difficulty string")
    base = make(("a", "easy"), ("b", "easy"), ("c", "hard"))
    new = curation.next_version(base, make(("b", "")), make(("d", "hard")), make(("c", "easy"), ("b", "x"), ("q", "x")))
    assert rows(new) == [("a", "easy"), ("c", "easy"), ("d", "hard")]
    assert rows(curation.version_diff(base, new, ["difficulty"])) == [
        ("difficulty", "easy", 2, 2, 0), ("difficulty", "hard", 1, 1, 0)]


def test_fingerprint_is_a_multiset_digest(spark):
    frame = spark.createDataFrame([(i, f"t{i % 50}") for i in range(200)], "i int, t string")
    of = lambda f: curation.fingerprint(f, F.col("t")).first()["fingerprint"]
    assert of(frame) == of(frame.repartition(6)) == of(frame.orderBy(F.rand(1)))
    assert of(frame) != of(frame.filter("i <> 3"))
    assert of(frame) != of(frame.union(frame.limit(1)))
    swapped = frame.withColumn("t", F.when(F.col("i") == 0, "t1").otherwise(F.col("t")))
    assert of(frame) != of(swapped)


@pytest.mark.parametrize("n,steps,warmup", [(1, 3, 0), (53, 21, 1), (921, 348, 10), (1022, 384, 12)])
def test_step_plan(spark, n, steps, warmup):
    row = curation.step_plan(spark.range(n)).first()
    assert (row["planned_steps"], row["warmup_steps"]) == (steps, warmup)
    assert steps == math.ceil(math.ceil(n / 8) * 3.0)


def test_manifest(spark):
    frame = spark.createDataFrame(
        [("a", "easy"), ("b", "easy"), ("c", "hard")], "axis_time string, difficulty string")
    row = curation.dataset_manifest(frame, "v1", F.col("axis_time"), ["axis_time", "difficulty"], {"fixed_ids": ["q"]}).first()
    assert row["selected_candidates"] == 3 and row["difficulty"] == {"easy": 2, "hard": 1}
    assert row["time"] == {"a": 1, "b": 1, "c": 1} and row["fixed_ids"] == ["q"] and row["version"] == "v1"


def test_shares_and_budget(spark):
    frame = spark.createDataFrame([("house_term",)] * 9 + [("literal",)] * 11, "axis_terminology string")
    assert tuple(curation.house_term_share(frame).first()) == (20, 9, 0.45, True)
    assert tuple(curation.budget_check(frame, (1, 19)).first()) == (20, False)
    assert tuple(curation.house_term_share(frame.limit(0)).first()) == (0, 0, 0.0, False)


def test_change_sets(spark, rows):
    schema = "example_id string, a string, b string"
    base = [("same", "x", None), ("moved", None, "x"), ("gone", "x", "y"), ("twice", "1", ""), ("twice", "2", ""), ("less", "1", ""),
            ("less", "1", ""), (None, "n", ""), ("gone", "x", "z")]
    new = [("same", "x", None), ("moved", "x", None), ("twice", "2", ""), ("twice", "1", ""), ("less", "1", ""), (None, "m", ""), ("new", "", "")]
    found = curation.version_changes(spark.createDataFrame(base, schema), spark.createDataFrame(new, schema), ["a", "b"])
    assert rows(found) == sorted([("moved", "fixed"), ("gone", "removed"), ("less", "fixed"), (None, "fixed"), ("new", "added")], key=repr)
    lists = curation.change_lists(found.where("example_id is not null"))
    assert lists == {"fixed_ids": ["less", "moved"], "added_ids": ["new"], "removed_repetition_ids": ["gone"]}
    assert curation.change_lists(found, most=1)["fixed_ids"] is None


def test_change_digests_count_every_id(spark):
    n = curation.MANIFEST_IDS + 5
    changes = spark.range(n).select(F.col("id").cast("string").alias("example_id"), F.lit("fixed").alias("change")).union(
        spark.createDataFrame([("ö", "added"), ("z", "added"), (None, "added")], "example_id string, change string"))
    sha = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert tuple(curation.change_digests(changes).first()) == (sha(sorted(map(str, range(n)))), sha(["z", "ö"]), sha([]))
    assert tuple(curation.change_digests(changes.limit(0)).first()) == (sha([]),) * 3


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(20,3)"])
def test_values_at_ranks(spark, kind):
    rng = random.Random(5)
    values = [rng.choice([0, 1, 7, -5]) for _ in range(300)] + [rng.randrange(-10 ** 9, 10 ** 9) for _ in range(500)]
    values += [10 ** 12, -10 ** 12] + ([(1 << 62) + i for i in range(40)] + [-(1 << 63), (1 << 63) - 1] if kind == "bigint" else [])
    rows = spark.createDataFrame([(str(v), i % 3 or None) for i, v in enumerate(values)] + [(None, 1)], "t string, g int").select(
        F.col("t").cast(kind).alias("v"), "g")
    order, n = sorted(values), len(values)
    assert [int(v) for v in selection.values_at(rows, "v", [0, 5, n // 2, n - 1])] == [order[i] for i in (0, 5, n // 2, n - 1)]
    assert selection.values_at(rows, "v", [n, -1]) == [None, None] and selection.values_at(rows.limit(0), "v", [0]) == [None]
    if kind != "bigint":
        for r in lengths.nearest_rank(rows, "v", by=["g"]).collect():
            own = sorted(v for i, v in enumerate(values) if (i % 3 or None) == r.g)
            assert [int(r[p]) for p in ("min", *lengths.FRACTIONS, "max")] == [
                own[round((len(own) - 1) * f)] for f in (0, *lengths.FRACTIONS.values(), 1)] and r.total == sum(own)


def test_ten_million_distinct_doubles(spark):
    rows = spark.range(10_000_000).select((F.pmod(F.col("id") * 7919, F.lit(10_000_000)) / 7.0).alias("v"))
    assert selection.values_at(rows, "v", [0, 4_999_999, 9_899_999]) == [0.0, 4_999_999 / 7.0, 9_899_999 / 7.0]


@pytest.mark.parametrize("n", [1, 2, 3, 100, 101, 257])
def test_nearest_rank_like_python(spark, n):
    rnd = random.Random(n)
    values = sorted(rnd.randint(0, 40) if n != 100 else i for i in range(n))
    frame = spark.createDataFrame([(v,) for v in values], "v int")
    row = lengths.nearest_rank(frame, "v").first()
    at = lambda f: values[round((n - 1) * f)]
    assert tuple(row)[:7] == (n, values[0], at(0.5), at(0.9), at(0.95), at(0.99), values[-1])
    assert row["total"] == sum(values)


def test_length_report_and_marker(spark):
    text = lambda words, sql: f"<|im_start|>user\n{words}<|im_end|>\n<|im_start|>assistant\n{sql}<|im_end|>\n"
    frame = spark.createDataFrame([(text("a b c", "S 1"),), (text("a", "S"),)], "text string")
    rows = lengths.token_lengths(frame)
    assert sorted((r.tokens, r.prefix_tokens, r.supervised_tokens) for r in rows.collect()) == [(4, 3, 1), (7, 5, 2)]
    report = lengths.token_length_report(rows, 5).first()
    assert (report["records"], report["over_limit"], report["response_truncated"], report["no_response_tokens"]) == (2, 1, 1, 1)
    assert tuple(lengths.supervised_summary(rows).first()) == (2, 3, 0)
    with pytest.raises(Exception, match="marker"):
        lengths.token_lengths(spark.createDataFrame([("x",)], "text string")).collect()


def test_user_tokenizer(spark):
    counter = lengths.tokenizer_counter(lambda texts: [len(t) for t in texts])
    frame = spark.createDataFrame([("ab##cde",)], "text string")
    assert lengths.token_lengths(frame, marker="##", counter=counter).first()["prefix_tokens"] == 4


def test_chat_contract(spark, rows):
    records = spark.createDataFrame([
        ("ok", [("user", "q"), ("assistant", "a")]), ("order", [("assistant", "a"), ("user", "q")]),
        ("blank", [("user", "q"), ("assistant", "  ")]), ("null", [("user", None), ("assistant", "a")]),
        ("short", [("user", "q")]), ("none", None), (None, [("user", "q"), ("assistant", "a")])],
        "example_id string, messages array<struct<role: string, content: string>>")
    assert rows(chat.chat_contract_violations(records)) == [
        ("blank", "empty content"), ("none", "missing messages"), ("null", "empty content"), ("order", "roles"),
        ("short", "roles"), (None, "missing example_id")]


def test_turns_to_records(spark, rows):
    turns = spark.createDataFrame([
        (1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "user", "q"), (3, 5, "assistant", " "),
        *[(4, i, ["user", "assistant"][i % 2], "x") for i in range(4)]], "conv_id int, turn int, role string, text string")
    assert rows(chat.turn_contract(turns).select("conv_id", "problem")) == [
        (1, None), (2, "roles"), (3, "empty content"), (4, "roles")]
    (record,) = chat.records_from_turns(turns).collect()
    assert record.example_id == "1" and [tuple(m) for m in record.messages] == [("user", "q"), ("assistant", "a")]


def test_prompts_and_typed_messages(spark):
    frame = spark.createDataFrame([("e", "s", "ecom-v1", "easy", "Wie {{x}}?", "SELECT 1")],
                                  "example_id string, seed_id string, schema string, difficulty string, question_de string, gold_sql string")
    records = chat.chat_records(frame, "C: {{schema_context}} Q: {{question_de}}", "tables")
    assert records.first()["messages"][0]["content"] == "C: tables Q: Wie {{x}}?"
    typed = chat.typed_messages(records).first()["messages"]
    assert typed[1].asDict(recursive=True) == {"role": "assistant", "content": [{"type": "text", "text": "SELECT 1"}]}
    assert json.loads(records.toJSON().first())["messages"][1] == {"role": "assistant", "content": "SELECT 1"}
