import pytest
from pyspark.sql import functions as F

from querykiln.operators import equivalence, grid, scoring, triage
from querykiln.operators.equivalence import result_row

AXES = "axis_terminology string, axis_structure string, axis_time string, difficulty string"


@pytest.fixture
def evaluation(spark):
    data = [(1, "a", "literal", "flat", "none", "easy", "?a"), (2, "b", "literal", "cte", "none", "hard", "?b"),
            (3, "a", "house_term", "flat", "none", "hard", "?a2")]
    return spark.createDataFrame(data, f"line_number int, example_id string, {AXES}, question_de string")


@pytest.fixture
def scored(spark):
    data = [("r1", "P0", "a", "hard", True, None), ("r1", "P0", "b", "hard", None, "x"), ("r1", "P0", "z", "easy", True, None),
            ("r1", "P1", "a", "hard", False, "y"), ("r1", "P1", "b", "hard", True, None), ("r1", "P1", "z", "easy", False, None)]
    return spark.createDataFrame(
        data, "run string, condition string, example_id string, difficulty string, result_equivalent boolean, error_class string")


def test_axis_accuracy(spark, scored, evaluation, rows):
    latest = scoring.latest_eval(evaluation)
    assert rows(scoring.accuracy_by_axis(scored, latest)) == [
        ("P0", "ALL", 1, 2, 0.5), ("P0", "house_term", 1, 1, 1.0), ("P0", "literal", 0, 1, 0.0),
        ("P1", "ALL", 1, 2, 0.5), ("P1", "house_term", 0, 1, 0.0), ("P1", "literal", 1, 1, 1.0)]


def test_missing_axis_is_an_error_only_where_it_counts(spark, scored, evaluation):
    gap = lambda i: evaluation.filter("line_number > 1").withColumn(
        "axis_time", F.when(F.col("example_id") != i, F.col("axis_time")))
    with pytest.raises(Exception, match="without axis_time"):
        scoring.accuracy_by_axis(scored, scoring.latest_eval(gap("a")), "axis_time").collect()
    unmatched = evaluation.union(spark.createDataFrame([(9, "unseen", "x", "x", None, "x", "?")], evaluation.schema))
    assert scoring.accuracy_by_axis(scored, scoring.latest_eval(unmatched), "axis_time").count() == 4


def test_all_axes_agree_with_single_axis(scored, evaluation, rows):
    latest = scoring.latest_eval(evaluation)
    table = scoring.accuracy_all_axes(scored, latest)
    for axis in ("axis_terminology", "axis_structure", "axis_time", "difficulty"):
        one = [r for r in rows(scoring.accuracy_by_axis(scored, latest, axis)) if r[1] != "ALL"]
        assert rows(table.filter(F.col("axis") == axis).drop("axis")) == one
    totals = {(r.condition, r.axis): 0 for r in table.collect()}
    for r in table.collect():
        totals[r.condition, r.axis] += r.total
    assert set(totals.values()) == {2}


def test_runs_and_denominators(spark, scored, rows):
    assert rows(scoring.accuracy_by_run(scored)) == [("r1", 3, 0.666667, 0.333333, -0.333333, 0.5, 2)]
    assert scoring.denominator_check(scored).first()["comparable"]
    assert not scoring.denominator_check(scored.filter("example_id <> 'z' OR condition = 'P0'")).first()["comparable"]
    assert not scoring.denominator_check(scored.limit(0)).first()["comparable"]


def test_wrong_examples_keep_unmatched(scored, evaluation, rows):
    got = rows(scoring.wrong_examples(scored, scoring.latest_eval(evaluation, columns=scoring.WRONG_LABELS)).select(
        "condition", "example_id", "axis_structure", "question_de", "error_class"))
    assert got == [("P0", "b", "cte", "?b", "x"), ("P1", "a", "flat", "?a2", "y"), ("P1", "z", "?", "?", None)]


def results(spark, data):
    frame = spark.createDataFrame(data, "example_id string, a int, b double, pos int")
    return lambda **kw: frame.select("example_id", result_row([F.col("a"), F.col("b")], **kw).alias("row"))


def test_equivalence_is_multiset_equality(spark, rows):
    gold = results(spark, [("same", 1, 0.5, 1), ("same", 1, 0.5, 2), ("count", 1, 0.5, 1), ("count", 1, 0.5, 2),
                           ("null", None, None, 1), ("extra", 1, 0.5, 1), ("float", 1, 0.1 + 0.2, 1), ("gone", 1, 0.5, 1)])
    pred = results(spark, [("same", 1, 0.5, 2), ("same", 1, 0.5, 1), ("count", 1, 0.5, 1), ("null", None, None, 1),
                           ("extra", 1, 0.5, 1), ("extra", 2, 0.5, 2), ("float", 1, 0.3, 1)])
    names = spark.createDataFrame([(n,) for n in ("same", "count", "null", "extra", "float", "gone", "empty")], "example_id string")
    rounded = dict(scale=6, floats={1})
    got = {r.example_id: r.result_equivalent
           for r in equivalence.equivalence(gold(**rounded), pred(**rounded), names).collect()}
    assert got == {"same": True, "count": False, "null": True, "extra": False, "float": True, "gone": False, "empty": True}
    failed = equivalence.with_failures(equivalence.equivalence(gold(), pred(), names), names.filter("example_id = 'empty'"))
    assert {r.example_id for r in failed.collect() if r.result_equivalent} == {"same", "null"}


def test_ordered_equivalence(spark):
    gold = results(spark, [("x", 1, 1.0, 1), ("x", 2, 1.0, 2)])
    pred = results(spark, [("x", 2, 1.0, 1), ("x", 1, 1.0, 2)])
    assert equivalence.equivalence(gold(), pred()).first()["result_equivalent"]
    at = dict(position=F.col("pos"))
    assert not equivalence.equivalence(gold(**at), pred(**at)).first()["result_equivalent"]


def test_gold_gate(spark, rows):
    slots = spark.createDataFrame([("a",), ("b",), ("c",)], "example_id string")
    gold = spark.createDataFrame([("a",), ("a",), ("c",)], "example_id string")
    assert rows(equivalence.gold_gate(slots, gold, slots.filter("example_id = 'c'"))) == [
        ("a", 2, "ok"), ("b", 0, "replace"), ("c", 0, "replace")]


def test_whole_tables(spark, rows):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "x int"), spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert rows(equivalence.tables_equal(a, b)) == [(1, "left"), (3, "right")]


def test_triage_and_final(spark, rows):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "example_id string")
    verdicts = lambda **v: spark.createDataFrame(list(v.items()), "example_id string, result_equivalent boolean")
    t = triage.consensus_triage(ids("a", "b", "c", "d"), verdicts(a=True, b=True, c=None), verdicts(a=True, b=False, c=True, d=True))
    assert {r.example_id: r.status for r in t.collect()} == {"a": "accepted", "b": "review", "c": "review", "d": "review"}
    assert rows(triage.finalise(t, ids("b", "c"), ids("c"))) == [("a", "consensus"), ("b", "review")]
    assert rows(triage.triage_summary(t)) == [("accepted", 1), ("review", 3)]


def test_slots(spark, rows):
    slots = lambda *v: spark.createDataFrame([(x,) for x in v], "slot_id int")
    report = spark.createDataFrame([(1, "replace"), (2, "ok"), (4, "replace")], "slot_id int, status string")
    got = triage.slots_to_regenerate(slots(1, 2, 3, 4), slots(1, 2, 4), report, slots(4, 4, 4, 3), 3)
    assert rows(got) == [(1, "failed"), (3, "missing")]


def test_funnel(spark, rows):
    frame = spark.createDataFrame([(True, True), (True, None), (False, True)], "a boolean, b boolean")
    assert rows(triage.gate_funnel(frame, {"a": F.col("a"), "b": F.col("b")})) == [(1, "a", 2, 1), (2, "b", 1, 1)]


def test_grid(spark, rows):
    examples = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "example_id string, line_number int")
    done = spark.createDataFrame([("P0", "a"), ("P0", "a"), ("P1", "b"), ("P9", "c")], "condition string, example_id string")
    assert rows(grid.pending(examples.select("example_id"), done, ["P0", "P1"])) == [
        ("P0", "b"), ("P0", "c"), ("P1", "a"), ("P1", "c")]
    assert rows(grid.completeness(examples, done, ["P0", "P1"])) == [("P0", 1, 3, False), ("P1", 1, 3, False)]
    assert rows(grid.resume_violations(done, ["P0", "P1"])) == [
        ("P0", "a", 2, "duplicate"), ("P9", "c", 1, "unexpected condition")]
    assert rows(grid.slice_shard(examples, 1, 1)) == [("b", 1)]
    assert rows(grid.slice_shard(examples, 2, 0)) == [("c", 2)]
    assert grid.first_records(examples, 0).count() == 3 and rows(grid.first_records(examples, 1)) == [("a", 0)]
    for empty in (3, 9):
        with pytest.raises(ValueError, match="empty"):
            grid.slice_shard(examples, empty, 2)
    with pytest.raises(ValueError, match="empty"):
        grid.slice_shard(examples.limit(0), 0, 1)
    assert grid.first_records(examples.limit(0), 2).count() == 0
    plan = grid.slice_shard(examples, 1, 1)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "Exchange" not in plan
    shards = [grid.hash_shard(examples, i, 3) for i in range(3)]
    assert rows(shards[0].union(shards[1]).union(shards[2])) == rows(examples)
    manifest = grid.run_manifest(grid.grid(examples, ["P0"]), examples, ["P0"], "r", "m").first()
    assert manifest["records"] == 3 and manifest["complete"]
