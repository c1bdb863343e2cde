"""Queries over scored runs, result sets, triage and generation grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.catalog.dataset import CONTEXT, TEMPLATE, _sql
from querykiln.fixtures import views as V
from querykiln.fixtures.oracle_views import with_views
from querykiln.operators import equivalence, grid, lengths, scoring, triage
from querykiln.schemas import CONDITIONS
from querykiln.session import kept, shared_folder
from querykiln.sources import records, runs
from querykiln.streaming.scoring import keep_verdicts, latest_accuracy

RUN = ["run", "condition"]
CONTEXTS = {"P0": "bare schema", "P1": "schema and glossary", "P2": CONTEXT}


def _scored_eval(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return V.scored(spark, sf_dir), scoring.latest_eval(V.axis_eval(spark, sf_dir))


def accuracy_by_axis(spark, sf_dir: str) -> DataFrame:
    return scoring.accuracy_by_axis(*_scored_eval(spark, sf_dir), axis="axis_structure", keys=RUN)


def accuracy_all_axes(spark, sf_dir: str) -> DataFrame:
    return scoring.accuracy_all_axes(*_scored_eval(spark, sf_dir), keys=RUN)


def accuracy_by_run_condition(spark, sf_dir: str) -> DataFrame:
    return scoring.accuracy_by_run(V.scored(spark, sf_dir))


def hard_accuracy_gap(spark, sf_dir: str) -> DataFrame:
    per_run = scoring.accuracy_by_run(V.scored(spark, sf_dir))
    return scoring.run_gap(per_run, "run_b", "run_a", "hard_accuracy_p0")


def denominator_check(spark, sf_dir: str) -> DataFrame:
    return scoring.denominator_check(V.scored(spark, sf_dir))


def wrong_examples(spark, sf_dir: str) -> DataFrame:
    found = scoring.wrong_examples(V.scored(spark, sf_dir), V.axis_eval(spark, sf_dir), RUN)
    return found.withColumn("question_de", F.sha2("question_de", 256))


def latency_summary(spark, sf_dir: str) -> DataFrame:
    """Latency and token figures per model and condition, percentiles exact."""
    by = ["model", "condition"]
    ranks = lengths.nearest_rank(
        V.generations(spark, sf_dir), "latency_ms", {"p50": 0.50, "p95": 0.95}, by,
        {"generated_tokens": F.sum("generated_tokens")})
    return ranks.select(
        *by, "records", F.round(F.col("total") / F.col("records"), 4).alias("avg_latency_ms"),
        "p50", "p95", F.col("max").alias("max_latency_ms"), "generated_tokens")


def result_equivalence(spark, sf_dir: str) -> DataFrame:
    return equivalence.equivalence(*V.results(spark, sf_dir))


def result_row_diff(spark, sf_dir: str) -> DataFrame:
    """Result rows that the gold and predicted tables do not share, with multiplicity."""
    gold, predicted = V.results(spark, sf_dir)
    return equivalence.tables_equal(gold, predicted).select(
        "side", "example_id", F.col("row.c0").alias("customer"), F.col("row.c1").alias("cents"))


def gold_nonempty_gate(spark, sf_dir: str) -> DataFrame:
    """Gold rows per example; the slots also hold months that no urgent order falls into."""
    o = V.table(spark, sf_dir, "orders")
    name = F.concat("o_orderstatus", F.lit(" "), F.to_date("o_orderdate").cast("string"))
    slots = o.select(name.alias("example_id")).distinct()
    gold = o.filter("o_orderpriority = '1-URGENT'").select(name.alias("example_id"))
    return equivalence.gold_gate(slots, gold)


def _triage(spark, sf_dir: str) -> DataFrame:
    s = V.scored(spark, sf_dir).filter("condition = 'P0'")
    return triage.consensus_triage(
        V.examples(spark, sf_dir).select("example_id"), s.filter("run = 'run_a'"), s.filter("run = 'run_b'"))


def consensus_triage(spark, sf_dir: str) -> DataFrame:
    """Status per candidate, with the two verdicts spelled out."""
    word = lambda c: F.when(F.col(c).isNull(), "missing").when(F.col(c), "equal").otherwise("different")
    return _triage(spark, sf_dir).withColumns({c: word(c) for c in ["first_ok", "second_ok"]})


def triage_summary(spark, sf_dir: str) -> DataFrame:
    return triage.triage_summary(_triage(spark, sf_dir))


def final_silver(spark, sf_dir: str) -> DataFrame:
    """Consensus rows, even reviewed ones approved, and a few rejected."""
    docs = V.examples(spark, sf_dir).select("example_id", "doc_id")
    return triage.finalise(
        _triage(spark, sf_dir), docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 89 = 0"))


def plan_family_check(spark, sf_dir: str) -> DataFrame:
    return triage.family_sizes(V.plan(spark, sf_dir))


def plan_candidate_mismatches(spark, sf_dir: str) -> DataFrame:
    return triage.plan_mismatches(
        V.plan(spark, sf_dir), V.candidates(spark, sf_dir),
        ["split", "difficulty", "axis_structure", "axis_time", "axis_terminology"])


def slots_to_regenerate(spark, sf_dir: str) -> DataFrame:
    return triage.slots_to_regenerate(
        V.plan(spark, sf_dir).select("slot_id"), V.candidates(spark, sf_dir),
        V.gold_report(spark, sf_dir), V.attempts(spark, sf_dir), max_attempts=30)


def pending_grid(spark, sf_dir: str) -> DataFrame:
    done = V.scored(spark, sf_dir).filter("run = 'run_a'")
    return grid.pending(V.examples(spark, sf_dir).select("example_id"), done, CONDITIONS)


def completeness(spark, sf_dir: str) -> DataFrame:
    done = V.scored(spark, sf_dir).filter("run = 'run_a'")
    labelled = V.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("example_id"))
    return grid.completeness(labelled, done, CONDITIONS)


def run_manifest(spark, sf_dir: str) -> DataFrame:
    done = V.scored(spark, sf_dir).filter("run = 'run_a'")
    labelled = V.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("example_id"))
    return grid.run_manifest(done, labelled, ["P0", "P1"], "run_a", "model_a").drop("conditions")


def shard_by_offset(spark, sf_dir: str) -> DataFrame:
    """The second shard of fifty examples in file order."""
    rows = V.examples(spark, sf_dir).select("example_id", "line_number")
    return grid.slice_shard(rows, offset=50, limit=50)


def first_records(spark, sf_dir: str) -> DataFrame:
    """The record limit of a training run, in file order."""
    return grid.first_records(V.train(spark, sf_dir).select("example_id", "line_number"), 64)


def appended_records(spark, sf_dir: str) -> DataFrame:
    """A run's records after its first condition was appended, then all of them, twice: each stands once."""
    made, store = V.scored(spark, sf_dir).filter("run = 'run_a'"), shared_folder(spark, "records")
    for batch in (made.filter("condition = 'P0'"), made, made):
        records.append_records(batch, store, ["P0", "P1"])
    return records.read_records(spark, store).select("condition", "example_id", "result_equivalent")


def _run_store(spark, sf_dir: str) -> tuple[str, DataFrame]:
    """Runs of both conditions in a store, and a registry that knows one of them."""
    store = shared_folder(spark, "runs")
    runs.save_runs(V.scored(spark, sf_dir).withColumns(
        {"scope": F.lit("eval"), "file_condition": F.col("condition")}), store)
    known = {"ord": F.lit(1), "scope": F.lit("eval"), "run": F.lit("run_a"), "label": F.lit("A"), "grp": F.lit("base")}
    return store, kept(spark.range(1).select(*[c.alias(name) for name, c in known.items()]), "registry")


def run_store_accuracy(spark, sf_dir: str) -> DataFrame:
    """Accuracy of the registered runs' P0 records, read from their folders alone."""
    store, registry = _run_store(spark, sf_dir)
    scored = runs.open_runs(spark, store, registry.filter("grp = 'base'"), ["P0"])
    return runs.with_run_labels(scoring.accuracy_by_run(scored, ["scope", "run"]), registry).select(
        "label", "accuracy_p0", "hard_accuracy_p0")


def unregistered_runs(spark, sf_dir: str) -> DataFrame:
    store, registry = _run_store(spark, sf_dir)
    return runs.unregistered_runs(runs.open_runs(spark, store), registry)


def resume_integrity(spark, sf_dir: str) -> DataFrame:
    """Both runs read as one results file: every P0 key is there twice, P1 was not selected."""
    return grid.resume_violations(V.scored(spark, sf_dir), ["P0"])


def _bundle_examples(spark, sf_dir: str) -> DataFrame:
    contexts = F.create_map(*[F.lit(x) for pair in CONTEXTS.items() for x in pair])
    split = F.when(F.col("doc_id") % 4 == 0, "ood").otherwise("iid")
    return V.examples(spark, sf_dir).select(
        "example_id", "question_de", split.alias("split"), "difficulty", contexts.alias("contexts"),
        F.lit(TEMPLATE).alias("prompt_template"), F.lit("v1").alias("prompt_version"),
        F.lit("eval_v2").alias("eval_version"))


def prompt_grid(spark, sf_dir: str) -> DataFrame:
    cells = grid.prompt_grid(_bundle_examples(spark, sf_dir), CONDITIONS)
    return cells.select("condition", "example_id", F.sha2("prompt", 256).alias("prompt_sha256"))


def generation_records(spark, sf_dir: str) -> DataFrame:
    cells = grid.grid(_bundle_examples(spark, sf_dir).drop("contexts", "question_de"), CONDITIONS)
    outputs = grid.grid(V.model_outputs(spark, sf_dir), ["P0", "P1"]).select(
        "condition", "example_id", "generated_text", F.col("doc_id").alias("latency_ms"),
        F.lit(0).alias("thinking_tokens"), F.char_length("generated_text").alias("generated_tokens"))
    return grid.generation_records(cells, outputs, "run_a", "model_a", "base_a").drop("adapter_path")


def streaming_accuracy(spark, sf_dir: str) -> DataFrame:
    """The labels read as a file stream into running accuracy per run and condition.

    The pattern matches a single file as well as a folder of part files.
    """
    labels = spark.readStream.schema("doc_id bigint, quality int, toxic int").parquet(
        f"{sf_dir}/labels.parque[t]")
    scored = V.scored_from(labels, V.table(spark, sf_dir, "documents"))
    out, checkpoint = shared_folder(spark, "accuracy"), shared_folder(spark, "checkpoint")
    keep_verdicts(scored, out, checkpoint, RUN).awaitTermination()
    return latest_accuracy(spark, out, RUN)


_AXES = ["axis_terminology", "axis_structure", "axis_time", "difficulty"]
_JOINED = """
    j AS (SELECT s.run, s.condition, s.verdict, e.axis_terminology, e.axis_structure, e.axis_time, e.difficulty
          FROM fx_scored s JOIN fx_axis_eval e USING (example_id))"""
_ACC = """count(*) FILTER (verdict) AS correct, count(*) AS total,
          round(count(*) FILTER (verdict) / count(*), 6) AS accuracy"""
_RANK = lambda f: f"list_sort(list(latency_ms))[CAST(round_even((count(*) - 1) * {f}, 0) AS BIGINT) + 1]"
_TRIAGED = """
    v AS (SELECT example_id, coalesce(bool_and(verdict) FILTER (run = 'run_a'), false) AS a,
                 coalesce(bool_and(verdict) FILTER (run = 'run_b'), false) AS b
          FROM (SELECT run, example_id, coalesce(verdict, false) AS verdict FROM fx_scored WHERE condition = 'P0')
          GROUP BY example_id),
    t AS (SELECT example_id, doc_id, CASE WHEN a IS NULL THEN 'missing' WHEN a THEN 'equal' ELSE 'different' END AS first_ok,
                 CASE WHEN b IS NULL THEN 'missing' WHEN b THEN 'equal' ELSE 'different' END AS second_ok,
                 CASE WHEN a AND b THEN 'accepted' ELSE 'review' END AS status
          FROM fx_examples LEFT JOIN v USING (example_id))"""
_BY_RUN = """
    c AS (SELECT run, count(*) FILTER (condition = 'P0') AS total,
                 count(*) FILTER (condition = 'P0' AND verdict) / count(*) FILTER (condition = 'P0') AS a0,
                 count(*) FILTER (condition = 'P1' AND verdict) / count(*) FILTER (condition = 'P1') AS a1,
                 count(*) FILTER (condition = 'P0' AND difficulty = 'hard') AS hard_total,
                 count(*) FILTER (condition = 'P0' AND difficulty = 'hard' AND verdict) / hard_total AS h0
          FROM fx_scored GROUP BY run)"""
_PROMPT = f"""sha256(replace(replace({_sql(TEMPLATE)}, '{{{{schema_context}}}}', context),
                       '{{{{question_de}}}}', question_de))"""

QUERIES = {
    "accuracy_by_axis": (accuracy_by_axis, with_views(f"""
        WITH {_JOINED}
        SELECT run, condition, axis_structure AS axis_value, {_ACC} FROM j GROUP BY ALL
        UNION ALL SELECT run, condition, 'ALL', {_ACC} FROM j GROUP BY ALL""", "fx_scored", "fx_axis_eval")),
    "accuracy_all_axes": (accuracy_all_axes, with_views(
        f"WITH {_JOINED} " + " UNION ALL ".join(
            f"SELECT run, condition, '{a}' AS axis, {a} AS axis_value, {_ACC} FROM j GROUP BY ALL" for a in _AXES)
        + f" UNION ALL SELECT run, condition, 'ALL', 'ALL', {_ACC} FROM j GROUP BY ALL",
        "fx_scored", "fx_axis_eval")),
    "accuracy_by_run_condition": (accuracy_by_run_condition, with_views(f"""
        WITH {_BY_RUN}
        SELECT run, total, round(a0, 6) AS accuracy_p0, round(a1, 6) AS accuracy_p1,
               round(a1 - a0, 6) AS condition_delta, round(h0, 6) AS hard_accuracy_p0, hard_total FROM c""",
        "fx_scored")),
    "hard_accuracy_gap": (hard_accuracy_gap, with_views(f"""
        WITH {_BY_RUN}
        SELECT max(round(h0, 6)) FILTER (run = 'run_b') AS better, max(round(h0, 6)) FILTER (run = 'run_a') AS base,
               round(better - base, 6) AS gap FROM c""", "fx_scored")),
    "denominator_check": (denominator_check, with_views("""
        WITH f AS (SELECT run, condition, count(*) AS n, count(*) FILTER (difficulty = 'hard') AS h
                   FROM fx_scored GROUP BY ALL)
        SELECT count(DISTINCT run) AS runs, count(*) AS files, min(n) AS min_rows, max(n) AS max_rows, min(h) AS min_hard_rows,
               count(*) = 4 AND min(n) = max(n) AND min(h) > 0 AS comparable FROM f""", "fx_scored")),
    "wrong_examples": (wrong_examples, with_views("""
        SELECT s.run, s.condition, s.example_id, coalesce(e.axis_terminology, '?') AS axis_terminology,
               coalesce(e.axis_structure, '?') AS axis_structure, coalesce(e.axis_time, '?') AS axis_time,
               coalesce(e.difficulty, '?') AS difficulty, sha256(coalesce(e.question_de, '?')) AS question_de,
               ['syntax', 'wrong_rows', 'timeout'][s.doc_id % 3 + 1] AS error_class
        FROM fx_scored s LEFT JOIN fx_axis_eval e USING (example_id)
        WHERE verdict IS NOT TRUE""", "fx_scored", "fx_axis_eval")),
    "latency_summary": (latency_summary, f"""
        WITH g AS (SELECT event_type AS model, 'P' || (user_id % 3) AS condition,
                          CAST(floor(value * 10 + 0.5) AS BIGINT) AS latency_ms,
                          CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)
        SELECT model, condition, count(*) AS records,
               round(CAST(sum(latency_ms) AS DOUBLE) / count(*), 4) AS avg_latency_ms, {_RANK(0.5)} AS p50,
               {_RANK(0.95)} AS p95, max(latency_ms) AS max_latency_ms, CAST(sum(k) AS BIGINT) AS generated_tokens
        FROM g GROUP BY model, condition"""),
    "result_equivalence": (result_equivalence, """
        WITH g AS (SELECT o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m') AS example_id, o_orderkey,
                          o_custkey, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders),
        p AS (SELECT example_id, o_custkey, CASE WHEN o_orderkey % 997 = 0 THEN cents + 1 ELSE cents END AS cents FROM g
              UNION ALL
              SELECT example_id, o_custkey, CASE WHEN o_orderkey % 997 = 0 THEN cents + 1 ELSE cents END FROM g
              WHERE o_orderkey % 1499 = 0),
        bad AS (SELECT example_id FROM (SELECT example_id, o_custkey, cents FROM g EXCEPT ALL
                                        SELECT example_id, o_custkey, cents FROM p)
                UNION SELECT example_id FROM (SELECT example_id, o_custkey, cents FROM p EXCEPT ALL
                                              SELECT example_id, o_custkey, cents FROM g)),
        gc AS (SELECT example_id, count(*) AS gold_rows FROM g GROUP BY 1),
        pc AS (SELECT example_id, count(*) AS predicted_rows FROM p GROUP BY 1)
        SELECT example_id, gold_rows, predicted_rows, example_id NOT IN (SELECT example_id FROM bad) AS result_equivalent
        FROM gc JOIN pc USING (example_id)"""),
    "result_row_diff": (result_row_diff, """
        WITH g AS (SELECT o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m') AS example_id, o_orderkey AS k,
                          o_custkey AS customer, CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS cents FROM orders),
        p AS (SELECT example_id, customer, CASE WHEN k % 997 = 0 THEN cents + 1 ELSE cents END AS cents FROM g
              UNION ALL
              SELECT example_id, customer, CASE WHEN k % 997 = 0 THEN cents + 1 ELSE cents END FROM g WHERE k % 1499 = 0)
        SELECT 'left' AS side, * FROM (SELECT example_id, customer, cents FROM g EXCEPT ALL SELECT * FROM p)
        UNION ALL
        SELECT 'right', * FROM (SELECT * FROM p EXCEPT ALL SELECT example_id, customer, cents FROM g)"""),
    "run_manifest": (run_manifest, with_views("""
        WITH n AS (SELECT count(DISTINCT (condition, example_id)) AS records FROM fx_scored WHERE run = 'run_a')
        SELECT 'run_a' AS run_id, 'model_a' AS model, records, records = 2 * (SELECT count(*) FROM labels) AS complete
        FROM n""", "fx_scored")),
    "shard_by_offset": (shard_by_offset, with_views(
        "SELECT example_id, line_number FROM fx_examples ORDER BY line_number LIMIT 50 OFFSET 50", "fx_examples")),
    "first_records": (first_records, with_views(
        "SELECT example_id, line_number FROM fx_train ORDER BY line_number LIMIT 64", "fx_train")),
    "gold_nonempty_gate": (gold_nonempty_gate, """
        SELECT o_orderstatus || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS example_id,
               count(*) FILTER (o_orderpriority = '1-URGENT') AS "rows",
               CASE WHEN "rows" > 0 THEN 'ok' ELSE 'replace' END AS status
        FROM orders GROUP BY 1"""),
    "consensus_triage": (consensus_triage, with_views(
        f"WITH {_TRIAGED} SELECT example_id, first_ok, second_ok, status FROM t", "fx_scored", "fx_examples")),
    "triage_summary": (triage_summary, with_views(
        f"WITH {_TRIAGED} SELECT status, count(*) AS examples FROM t GROUP BY status", "fx_scored", "fx_examples")),
    "final_silver": (final_silver, with_views(f"""
        WITH {_TRIAGED}
        SELECT example_id, CASE status WHEN 'accepted' THEN 'consensus' ELSE 'review' END AS accepted_by
        FROM t WHERE (status = 'accepted' OR doc_id % 2 = 0) AND doc_id % 89 <> 0""", "fx_scored", "fx_examples")),
    "plan_family_check": (plan_family_check, with_views(
        "SELECT family, count(*) AS slots FROM fx_plan GROUP BY family HAVING count(*) <> 3", "fx_plan")),
    "plan_candidate_mismatches": (plan_candidate_mismatches, with_views("""
        SELECT slot_id, 'difficulty' AS field FROM fx_plan
        WHERE slot_id % 7 <> 0 AND slot_id % 11 = 0 AND difficulty <> 'hard'
        UNION ALL SELECT slot_id, 'axis_time' FROM fx_plan WHERE slot_id % 7 <> 0 AND slot_id % 13 = 0""",
        "fx_plan")),
    "slots_to_regenerate": (slots_to_regenerate, with_views("""
        SELECT slot_id, CASE WHEN slot_id % 7 = 0 THEN 'missing' ELSE 'failed' END AS reason FROM fx_plan
        WHERE (slot_id % 7 = 0 OR slot_id % 17 = 0) AND slot_id NOT IN (
            SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(*) >= 30)""",
        "fx_plan")),
    "pending_grid": (pending_grid, with_views("""
        SELECT example_id, condition FROM fx_examples, (VALUES ('P0'), ('P1'), ('P2')) c(condition)
        EXCEPT SELECT example_id, condition FROM fx_scored WHERE run = 'run_a'""", "fx_examples", "fx_scored")),
    "completeness": (completeness, with_views("""
        SELECT condition, count(DISTINCT s.example_id) AS records, (SELECT count(*) FROM labels) AS expected,
               count(DISTINCT s.example_id) = (SELECT count(*) FROM labels) AS complete
        FROM (VALUES ('P0'), ('P1'), ('P2')) c(condition)
        LEFT JOIN (SELECT * FROM fx_scored WHERE run = 'run_a') s USING (condition) GROUP BY condition""", "fx_scored")),
    "appended_records": (appended_records, with_views(
        "SELECT condition, example_id, verdict AS result_equivalent FROM fx_scored WHERE run = 'run_a'", "fx_scored")),
    "run_store_accuracy": (run_store_accuracy, with_views("""
        SELECT 'A' AS label, round(count(*) FILTER (verdict) / count(*), 6) AS accuracy_p0,
               round(coalesce(count(*) FILTER (verdict AND difficulty = 'hard')
                   / nullif(count(*) FILTER (difficulty = 'hard'), 0), 0), 6) AS hard_accuracy_p0
        FROM fx_scored WHERE run = 'run_a' AND condition = 'P0'""", "fx_scored")),
    "unregistered_runs": (unregistered_runs, with_views("""
        SELECT 'eval' AS scope, run, condition AS file_condition, count(*) AS records
        FROM fx_scored WHERE run = 'run_b' GROUP BY run, condition""", "fx_scored")),
    "resume_integrity": (resume_integrity, with_views("""
        SELECT condition, example_id, count(*) AS copies,
               CASE WHEN condition <> 'P0' THEN 'unexpected condition' ELSE 'duplicate' END AS problem
        FROM fx_scored GROUP BY condition, example_id HAVING condition <> 'P0' OR count(*) > 1""", "fx_scored")),
    "prompt_grid": (prompt_grid, with_views(f"""
        SELECT condition, example_id, {_PROMPT} AS prompt_sha256
        FROM fx_examples, (VALUES ('P0', 'bare schema'), ('P1', 'schema and glossary'),
                                   ('P2', {_sql(CONTEXT)})) c(condition, context)""", "fx_examples")),
    "generation_records": (generation_records, with_views("""
        WITH o AS (SELECT *, trim(text, e' \\t\\n\\r') AS body, 'SELECT ' || n_chars || ' FROM ecom_v1.orders' AS q
                   FROM fx_examples)
        SELECT 'run_a' AS run_id, 'eval_v2' AS eval_version, 'ecom-v1' AS schema,
               CASE WHEN doc_id % 4 = 0 THEN 'ood' ELSE 'iid' END AS split, difficulty, example_id,
               'model_a' AS model, 'base_a' AS base_model, 'base' AS model_mode, 'v1' AS prompt_version,
               'ecom-v1-' || lower(condition) AS schema_context_version, condition,
               CASE doc_id % 8 WHEN 4 THEN '``` ' || q WHEN 5 THEN body WHEN 6 THEN body ELSE q END AS generated_sql,
               doc_id AS latency_ms, 1536 AS max_new_tokens, 'nf4-4bit' AS quantization, false AS thinking,
               0 AS thinking_budget, 0 AS thinking_tokens,
               CAST(CASE doc_id % 8 WHEN 0 THEN length(q) WHEN 1 THEN length(q) + 11
                    WHEN 2 THEN length(text) + length(q) + 28 WHEN 3 THEN length(text) + length(q) + 25
                    WHEN 4 THEN length(q) + 7 WHEN 5 THEN length(text) + 4 WHEN 6 THEN length(text) + 4
                    ELSE length(q) + 4 END AS INTEGER) AS generated_tokens
        FROM o, (VALUES ('P0'), ('P1')) c(condition)""", "fx_examples")),
    "streaming_accuracy": (streaming_accuracy, with_views(f"""
        SELECT run, condition, total, correct, accuracy
        FROM (SELECT run, condition, {_ACC} FROM fx_scored GROUP BY ALL)""", "fx_scored")),
}
