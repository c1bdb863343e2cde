import json
import random

import pytest
from pyspark.sql import functions as F

from querykiln.operators import curation, validation
from querykiln.operators.keys import join_profile, key_profile, sft_keys
from querykiln.operators.lint import lint
from querykiln.schemas import SFT_REQUIRED_KEYS
from querykiln.sources import jsonl


def example(i, **over):
    base = dict(example_id=f"e{i}", seed_id=f"train_{i}", schema="ecom-v1", difficulty="easy", axis_structure="flat",
                axis_time="none", axis_terminology="literal", question_de=f"Frage {i}?", gold_sql=f"SELECT {i}")
    return {**base, **over}


def write(path, records):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in records),
                    encoding="utf-8")
    return str(path)


def check(spark, data, evaluation, known=()):
    rows = jsonl.read_sft_batches(spark, data, list(known))
    found = validation.violations(rows, jsonl.read_sft(spark, evaluation), "ordinal")
    return {(r.line_number, r.rule, r.detail) for r in jsonl.line_numbers(found, rows).collect()}


def test_all_rules_on_a_file(spark, tmp_path):
    missing = example(3)
    del missing["gold_sql"], missing["axis_time"]
    data = write(tmp_path / "d.jsonl", [
        example(1), "", "  \t ", example(2, difficulty="expert", schema="x"), missing,
        example(3, axis_time=None), example(5, question_de="frage 1? "), example(1, seed_id="gen_1", gold_sql="a"),
        example(7, gold_sql="SELECT current_date ()"), example(8, gold_sql="SELECT CURRENT_DATE, CURRENT_DATETIME()"),
        example(9, seed_id="train_eval", question_de="Eval?", gold_sql="select  EVAL"),
    ])
    evaluation = write(tmp_path / "e.jsonl", [
        example(90, seed_id="train_eval", question_de=" eval? ", gold_sql="SELECT eval")])
    assert check(spark, data, evaluation) == {
        (2, "unexpected schema", "x"), (2, "invalid difficulty", "expert"),
        (3, "missing keys", "axis_time,gold_sql"),
        (5, "duplicate question", ""), (6, "duplicate example_id", ""), (6, "duplicate question", ""),
        (6, "seed_id must start with train_", "gen_1"), (7, "dynamic time function is forbidden", ""),
        (9, "eval seed leakage", ""), (9, "eval question leakage", ""), (9, "eval SQL leakage", ""),
    }


def test_known_files_come_first_in_reverse_order(spark, tmp_path):
    evaluation = write(tmp_path / "e.jsonl", [example(90)])
    k1 = write(tmp_path / "k1.jsonl", [example(1), example(2)])
    k2 = write(tmp_path / "k2.jsonl", [example(2), "", example(3)])
    data = write(tmp_path / "d.jsonl", [example(3), example(4)])
    lines = {n for n, _, _ in check(spark, data, evaluation, [k1, k2])}
    assert lines == {4, 5}  # k2 is lines 1-2, k1 is 3-4, data is 5-6


def test_line_numbers_over_many_splits(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for f in range(3):
        write(folder / f"part{f}.jsonl", [example(f * 100 + i) if i % 7 else "" for i in range(100)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = jsonl.read_sft(spark, str(folder))
        assert rows.rdd.getNumPartitions() > 5
        numbered = jsonl.line_numbers(rows, rows).orderBy("line_number").select("line_number", "example_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.line_number for r in numbered] == list(range(1, len(numbered) + 1))
    assert [int(r.example_id[1:]) for r in numbered] == [f * 100 + i for f in range(3) for i in range(100) if i % 7]


def test_malformed_json_fails(spark, tmp_path):
    with pytest.raises(Exception):
        jsonl.read_sft(spark, write(tmp_path / "bad.jsonl", ["{not json"])).collect()


def test_a_line_that_is_no_object_is_not_lost(spark, tmp_path):
    lines = jsonl.read_lines(spark, write(tmp_path / "odd.jsonl", ["[1]", "7", json.dumps(example(1))]))
    missing = lines.select(jsonl.missing_keys(F.col("raw"), ["a", "b"]).alias("m")).collect()
    assert [r.m for r in missing] == [["a", "b"]] * 3


def brute_duplicates(train, evaluation):
    seen, out = set(), set()
    for i, row in enumerate(train):
        for label, value in row.items():
            if (label, value) in seen:
                out.add((i, f"duplicate {label}"))
            seen.add((label, value))
            if label != "example_id" and any(e[label] == value for e in evaluation):
                out.add((i, validation.LEAK_RULES[label]))
    return out


@pytest.mark.parametrize("hot_keys", [0, 1, 3, 1000])
def test_key_rules_with_skew_against_brute_force(spark, hot_keys):
    rnd = random.Random(hot_keys)
    pick = lambda: "hot" if rnd.random() < 0.4 else f"v{rnd.randint(0, 60)}"
    make = lambda: {k: pick() for k in ("example_id", "seed_id", "question", "gold_sql")}
    train, evaluation = [make() for _ in range(200)], [make() for _ in range(5)]
    frame = lambda data: spark.createDataFrame(
        [(i, *r.values()) for i, r in enumerate(data)],
        "ord int, example_id string, seed_id string, question_de string, gold_sql string")
    keys = sft_keys(frame(train), "ord")
    flagged = join_profile(keys, key_profile(keys, sft_keys(frame(evaluation), None)), hot_keys)
    got = set()
    for r in flagged.collect():
        if r.ord > r.first_ord:
            got.add((r.ord, f"duplicate {r.label}"))
        if r.in_eval and r.label in validation.LEAK_RULES:
            got.add((r.ord, validation.LEAK_RULES[r.label]))
    assert got == brute_duplicates(train, evaluation)
    assert flagged.count() == len({(r.ord, r.label) for r in flagged.collect()})


def test_quota_and_drift(spark, rows):
    frame = spark.createDataFrame(
        [("easy", "flat"), ("easy", "cte"), (None, "cte"), ("hard", None)], "difficulty string, axis_structure string")
    quota = {r.difficulty: (r.actual, r.gap, r.met)
             for r in validation.quota_report(frame, {"easy": 2, "medium": 1, "hard": 1}).collect()}
    assert quota == {"total": (4, 0, True), "easy": (2, 0, True), "medium": (0, -1, False), "hard": (1, 0, True)}
    drift = validation.vocabulary_drift(frame, {"axis_structure": ["flat"]})
    assert rows(drift) == [("axis_structure", "cte", 2), ("axis_structure", None, 1)]


def test_conformance(spark, rows):
    frame = spark.createDataFrame([(1, "a"), (None, "z"), (2, None)], "k int, e string")
    assert rows(validation.conformance(frame, "t", ["k"], {"e": ["a"]})) == [
        ("t", "e", "enum", 1), ("t", "k", "null", 1)]


def test_lint(spark):
    good = [
        "SELECT 1 FROM ecom_v1.orders;", " with a as (select 1), b as (select * from a) select * from b join ecom_v1.returns on true",
        "SELECT EXTRACT(YEAR FROM order_date) FROM `ecom_v1.orders` WHERE x = 'FROM y; -- z CURRENT_DATE'",
        "SELECT x FROM UNNEST([1, 2]) AS x", "SELECT 1 FROM ecom_v1.orders o, ecom_v1.returns AS r, UNNEST([1]) WHERE o.a = r.b",
        "SELECT 1 FROM (SELECT 1 FROM ecom_v1.orders) LEFT JOIN ecom_v1.returns USING (a) ORDER BY a, b", "SELECT 'it''s' FROM ecom_v1.orders",
    ]
    bad = {
        "SELECT 1 FROM orders": {"table_prefix"}, "SELECT 1 FROM ecom_v1.orders o, returns": {"table_prefix"},
        "SELECT 1 FROM ecom_v1.orders o\nJOIN returns r ON o.a = r.a": {"table_prefix"}, "SELECT 1 FROM ecom_v1.nope": {"table_prefix"},
        "SELECT Current_Timestamp FROM ecom_v1.orders": {"dynamic_time"},
        "SELECT 1 /* x */ FROM ecom_v1.orders": {"comment"}, "```\nSELECT 1```": {"markdown_fence", "query_start"},
        "SELECT 1; SELECT 2": {"single_query"}, "UPDATE ecom_v1.orders SET a = 1": {"query_start"},
    }
    frame = spark.createDataFrame([(s, s) for s in [*good, *bad]], "example_id string, gold_sql string")
    found = {}
    for r in lint(frame).collect():
        found.setdefault(r.example_id, set()).add(r.rule)
    assert found == bad


def test_error_messages(spark):
    found = spark.createDataFrame([(3, "missing keys", "a,b"), (4, "unexpected schema", "x")],
                                  "line_number bigint, rule string, detail string")
    assert [r.message for r in validation.error_messages(found).orderBy("line_number").collect()] == [
        "line 3: missing ['a', 'b']", "line 4: unexpected schema"]


def test_duplicates_after_repartitioning(spark):
    data = [(i, f"e{i % 9}", f"s{i}", "Q" if i % 3 else f"q{i}", "x") for i in range(90)]
    frame = spark.createDataFrame(data, "line_number int, example_id string, seed_id string, question_de string, gold_sql string")
    want = sorted(curation.duplicate_values(frame).collect())
    assert sorted(curation.duplicate_values(frame.repartition(7)).collect()) == want
    assert {r.label: r.extra_copies for r in want} == {"example_id": 81, "question": 59, "gold_sql": 89}


def test_required_keys_constant():
    assert len(SFT_REQUIRED_KEYS) == 9
