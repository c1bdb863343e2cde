"""Command-line jobs over files: `spark-submit ... querykiln/jobs.py <job> ...` or `python -m`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querykiln.functions.numeric import ratio, three_decimals, whole_percent
from querykiln.operators import chat, curation, grid, lengths, scoring, triage, validation
from querykiln.operators.lint import lint
from querykiln.schemas import AXES, CHAT_RECORD, CONDITIONS, RUN_REGISTRY, SCORED_RECORD, SFT_CANDIDATE
from querykiln.session import build_session, kept
from querykiln.sources import jsonl, records, runs, sinks, warehouse
from querykiln.streaming.scoring import keep_verdicts, latest_accuracy, scored_stream


def selected_conditions(text: str) -> list[str]:
    """Conditions of a comma-separated list: known, at least one, none twice."""
    chosen = [c.strip().upper() for c in text.split(",") if c.strip()]
    if not chosen or len(set(chosen)) != len(chosen) or not set(chosen) <= set(CONDITIONS):
        raise ValueError("conditions must be a duplicate-free subset of P0, P1, P2")
    return chosen


def validate(spark: SparkSession, data: str, evaluation: str, known: list[str] = (),
             require_ready: bool = False, ingested: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """Numbered violations of a candidate file, and the quota lines that are not met.

    With `ingested` all paths are Parquet copies made by the ingest job.
    """
    if ingested:
        read = spark.read.parquet
        held_out = read(evaluation)
        batches = validation.prepend_known(read(data), [read(k) for k in known])
        rows = validation.union_batches(batches)
        found = validation.violations(rows, _with_keys(held_out), "position")
        # Lines count on over the batches, as if the files were one.
        batch, shift = validation.batch_of(F.col("position")), F.lit(0)
        before = [b.count() for b in batches[:-1]]
        for i in range(1, len(batches)):
            shift = F.when(batch >= i, F.lit(sum(before[:i]))).otherwise(shift)
        numbered = found.select(
            (validation.line_of(F.col("position")) + shift).alias("line_number"), "rule", "detail")
    else:
        rows = jsonl.read_sft_batches(spark, data, list(known))
        found = validation.violations(rows, _with_keys(jsonl.read_sft(spark, evaluation)), "ordinal")
        numbered = jsonl.line_numbers(found, rows).select("line_number", "rule", "detail")
    quota = validation.quota_report(rows).filter(~F.col("met")) if require_ready else None
    return numbered, quota


def _with_keys(evaluation: DataFrame) -> DataFrame:
    """Held-out rows; one without the fields that leakage is judged by stops the job."""
    return validation.require_keys(evaluation, ["seed_id", "question_de", "gold_sql"], "a held-out row")


def build_chat(spark: SparkSession, data: str, template: str, context: str) -> DataFrame:
    """Chat records of a reviewed candidate file; a row without a field they need stops the job."""
    read = lambda path: jsonl.read_text(spark, path).first()["text"]
    rows = validation.require_keys(jsonl.read_sft(spark, data), chat.CHAT_FIELDS, "a candidate")
    return chat.chat_records(rows, read(template), read(context))


def eval_set(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Eval examples, the last copy of an id counting."""
    return scoring.latest_eval(jsonl.read_jsonl(spark, path, SFT_CANDIDATE), "ordinal", columns)


def scored_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Scored records with their file and the condition of the file's first record."""
    rows = jsonl.read_jsonl(spark, paths, SCORED_RECORD).drop("difficulty")
    rows = rows.withColumn("file", F.col("ordinal.file"))
    first = rows.groupBy("file").agg(F.min_by("condition", "ordinal").alias("condition"))
    return rows.drop("condition").join(first, "file")


def analyze(spark: SparkSession, evaluation: str, results: list[str], axis: str | None) -> DataFrame:
    """Accuracy per file by one axis, or by all axes when none is given."""
    scored, examples, keys = scored_files(spark, results), eval_set(spark, evaluation, AXES), ["file", "condition"]
    table = (scoring.accuracy_by_axis(scored, examples, axis, keys) if axis
             else scoring.accuracy_all_axes(scored, examples, keys))
    # A file of which nothing matches has its line of zeros.
    nothing = {"axis": "ALL", "axis_value": "ALL", "correct": 0, "total": 0, "accuracy": 0.0}
    empty = scored.select(*keys).distinct().join(table.select("file"), "file", "left_anti")
    return table.unionByName(empty.withColumns({
        f.name: F.lit(nothing[f.name]).cast(f.dataType) for f in table.schema if f.name in nothing}))


def errors_only(spark: SparkSession, evaluation: str, results: list[str]) -> DataFrame:
    return scoring.wrong_examples(
        scored_files(spark, results), eval_set(spark, evaluation, scoring.WRONG_LABELS), ["file", "condition"])


def compare_runs(spark: SparkSession, root: str, registry: str | None) -> tuple[DataFrame, DataFrame]:
    """P0/P1 and hard accuracy of all runs below a folder, and the equal-denominator check.

    With a registry only its runs count, in its order, and each must have both files.
    """
    scored = runs.read_scored(spark, root).withColumn("condition", F.col("file_condition"))
    if not registry:
        return scoring.accuracy_by_run(scored, ["scope", "run"]), scoring.denominator_check(scored, ["scope", "run"])
    dim = spark.read.schema(RUN_REGISTRY).option("header", True).csv(registry)
    absent = runs.missing_files(scored, dim, ["P0", "P1"]).first()
    if absent is not None:
        raise ValueError(f"no scored rows for {absent['scope']}/{absent['run']}/{absent['file_condition']}")
    scored = scored.join(dim.select("scope", "run"), ["scope", "run"], "left_semi")
    per_run = runs.with_run_labels(scoring.accuracy_by_run(scored, ["scope", "run"]), dim).orderBy("ord")
    return per_run, scoring.denominator_check(scored, ["scope", "run"])


def length_report(spark: SparkSession, data: str, limit: int, counter=lengths.word_count) -> DataFrame:
    """Token lengths of a chat-record file."""
    records = jsonl.read_jsonl(spark, data, CHAT_RECORD)
    rendered = records.select(chat.render_chat(F.col("messages")).alias("text"))
    return lengths.token_length_report(lengths.token_lengths(rendered, counter=counter), limit)


def chat_problems(spark: SparkSession, data: str) -> DataFrame:
    """Broken chat records of a file, which must hold at least one record."""
    records = jsonl.read_jsonl(spark, data, CHAT_RECORD)
    if records.isEmpty():
        raise ValueError(f"no chat records in {data}")
    return chat.chat_contract_violations(records)


def manifest(spark: SparkSession, data: str, version: str, base: str | None = None,
             curriculum: str | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Manifest row of a candidate file, and how its ids differ from those of `base`, an earlier version.

    The row has the digest of the file and one of its lines in any order; with a base also its name and
    the ids removed, added and fixed, unless there are too many for one row.
    """
    def candidates(path):
        lines = jsonl.read_lines(spark, path)
        return lines.select("raw", jsonl.parse_json(F.col("raw"), SFT_CANDIDATE).alias("r")).select("raw", "r.*")

    rows, changes, ids = candidates(data), None, {}
    if base:
        # A line is the same if its fields are: their order and spacing are no change.
        fields = F.to_json(F.try_parse_json("raw"))
        changes = kept(curation.version_changes(
            candidates(base).withColumn("fields", fields), rows.withColumn("fields", fields), ["fields"]), "changes")
        ids = curation.change_lists(changes)
    row = curation.dataset_manifest(rows, version, F.col("raw"), ids=ids).withColumnRenamed(
        "candidate_sha256", "content_fingerprint").withColumns(
        {"base": F.lit(base).cast("string"), "curriculum": F.lit(curriculum).cast("string")})
    files = curation.file_sha256(spark, data).agg(
        F.when(F.count(F.lit(1)) == 1, F.first("sha256")).alias("candidate_sha256"))
    return row.join(files), changes


def triage_candidates(spark: SparkSession, candidates: str, first: str, second: str) -> tuple[DataFrame, DataFrame]:
    """Lines of candidates that both models answer equivalently, and of the queue for manual review.

    The lines are kept as they are, with fields that the triage does not know.
    """
    rows = jsonl.read_lines(spark, candidates).select(
        "raw", jsonl.parse_json(F.col("raw"), "example_id string").alias("r")).select("raw", "r.*")
    verdicts = lambda path: jsonl.read_jsonl(spark, path, SCORED_RECORD)
    judged = kept(triage.consensus_triage(rows, verdicts(first), verdicts(second)).select("status", "raw"), "triage")
    pick = lambda status: judged.filter(F.col("status") == status).select("raw")
    return pick("accepted"), pick("review")


def lint_file(spark: SparkSession, data: str) -> DataFrame:
    return lint(jsonl.read_jsonl(spark, data, SFT_CANDIDATE))


def shard_examples(spark: SparkSession, bundle: str, offset: int = 0, limit: int = 0, shard: int = 0,
                   shards: int = 1) -> DataFrame:
    """Examples of a bundle's shard: by position, where an empty shard stops the job, or by hash, where some may be empty.

    The bundle is one document, so its examples are spread out.
    """
    examples = jsonl.bundle_examples(jsonl.read_bundle(spark, bundle)).repartition("example_id")
    part = grid.slice_shard(examples, offset, limit, "position") if offset or limit else examples
    return grid.hash_shard(part, shard, shards) if shards > 1 else part


def pending_prompts(spark: SparkSession, bundle: str, done: str | None, conditions: list[str],
                    offset: int = 0, limit: int = 0, shard: int = 0, shards: int = 1) -> DataFrame:
    """Prompts of a bundle's shard that have no record yet.

    `done` is the store that `collect-answers` appends to; records of other conditions or present twice
    stop the job.
    """
    cells = grid.prompt_grid(shard_examples(spark, bundle, offset, limit, shard, shards), conditions)
    finished = records.read_records(spark, done) if done else None
    if finished is not None:
        records.check(finished, conditions)
        cells = cells.join(finished.select(*grid.KEY), grid.KEY, "left_anti")
    return cells


OUTPUT_RECORD = ("condition string, example_id string, generated_text string, latency_ms bigint, "
                 "thinking_tokens int, generated_tokens int")


def collect_answers(spark: SparkSession, bundle: str, answers: str, store: str, conditions: list[str], run_id: str,
                    model: str, base_model: str, adapter_path: str | None = None, stopped: bool = False,
                    max_new_tokens: int = 1536, quantization: str = "nf4-4bit", thinking: bool = False,
                    thinking_budget: int = 1536, max_runtime_seconds: int = 0, offset: int = 0, limit: int = 0,
                    shard: int = 0, shards: int = 1, require_adapter: bool = False) -> DataFrame:
    """Append the records of a model's answers (JSONL); the manifest of the run as it then stands.

    Answers to cells that have a record are left out, so a job can be run again. Whether the run is
    complete is judged by the examples of its shard.
    """
    if require_adapter and not adapter_path:
        raise ValueError("an adapter is required, and none is given")
    examples = shard_examples(spark, bundle, offset, limit, shard, shards)
    outputs = spark.read.schema(OUTPUT_RECORD).option("mode", "FAILFAST").json(answers)
    made = grid.generation_records(
        grid.grid(examples, conditions), outputs, run_id, model, base_model, adapter_path, max_new_tokens,
        quantization, thinking, thinking_budget)
    records.append_records(made, store, conditions)
    done = records.read_records(spark, store)
    digest = curation.file_sha256(spark, bundle).first()["sha256"]
    return grid.run_manifest(done if done is not None else made.limit(0), examples, conditions, run_id, model, stopped, {
        "base_model": base_model, "result_file": store, "bundle_sha256": digest, "adapter_path": adapter_path,
        "model_mode": "adapter" if adapter_path else "base", "adapter_required": require_adapter,
        "max_new_tokens": max_new_tokens, "record_limit": limit, "record_offset": offset, "quantization": quantization,
        "thinking": thinking, "thinking_budget": thinking_budget if thinking else 0,
        "max_runtime_seconds": max_runtime_seconds})


def show_all(rows: DataFrame) -> None:
    """Every row of a report on the console."""
    found = rows.collect()
    rows.sparkSession.createDataFrame(found, rows.schema).show(max(1, len(found)), truncate=False)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="querykiln")
    parser.add_argument("--shuffle-partitions", type=int,
                        help="about the shuffled bytes divided by 200 MB; AQE merges what is too small")
    job = parser.add_subparsers(dest="job", required=True)

    p = job.add_parser("validate", help="check candidates against the held-out set")
    p.add_argument("data")
    p.add_argument("--eval", required=True)
    p.add_argument("--known", action="append", default=[])
    p.add_argument("--require-ready", action="store_true")
    p.add_argument("--ingested", action="store_true", help="all files are Parquet copies from the ingest job")
    p.add_argument("--out", required=True, help="folder for the violations")

    p = job.add_parser("ingest", help="Parquet copy of candidates with line numbers")
    p.add_argument("data")
    p.add_argument("output")

    p = job.add_parser("build", help="write chat records")
    p.add_argument("data")
    p.add_argument("output")
    p.add_argument("--template", required=True)
    p.add_argument("--context", required=True)

    p = job.add_parser("analyze", help="accuracy by axis")
    p.add_argument("eval")
    p.add_argument("results", nargs="+")
    p.add_argument("--axis", choices=AXES, help="one axis; all of them if left out")
    p.add_argument("--errors-only", action="store_true")
    p.add_argument("--out")

    p = job.add_parser("compare", help="accuracy of all runs below a folder")
    p.add_argument("root")
    p.add_argument("--registry", help="CSV: ord,scope,run,label,grp")
    p.add_argument("--out")

    p = job.add_parser("lengths", help="token length report of chat records")
    p.add_argument("data")
    p.add_argument("--limit", type=int, default=2048)
    p.add_argument("--out")

    p = job.add_parser("check-chat", help="chat contract of records; writes the broken ones")
    p.add_argument("data")
    p.add_argument("output")

    p = job.add_parser("lint", help="SQL conventions of candidates")
    p.add_argument("data")
    p.add_argument("output")

    p = job.add_parser("triage", help="split candidates by the agreement of two models with the gold result")
    p.add_argument("candidates")
    p.add_argument("first")
    p.add_argument("second")
    p.add_argument("--accepted-out", required=True)
    p.add_argument("--review-out", required=True)

    p = job.add_parser("manifest", help="dataset manifest")
    p.add_argument("data")
    p.add_argument("version")
    p.add_argument("output")
    p.add_argument("--base", help="the version before: the manifest lists removed, added and fixed ids")
    p.add_argument("--changes-out", help="folder for the changed ids, of which there may be any number")
    p.add_argument("--curriculum")

    p = job.add_parser("prompts", help="prompts of the unfinished grid cells")
    p.add_argument("bundle")
    p.add_argument("output")
    p.add_argument("--done", help="records that collect-answers appended")
    p.add_argument("--conditions", default=",".join(CONDITIONS))
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--shard", type=int, default=0)
    p.add_argument("--shards", type=int, default=1, help="more than 1: split by hash instead of by position")

    p = job.add_parser("collect-answers", help="append a model's answers as records; write the run manifest")
    p.add_argument("bundle")
    p.add_argument("answers", help="JSONL: condition, example_id, generated_text, latency_ms, token counts")
    p.add_argument("records")
    p.add_argument("manifest")
    p.add_argument("--run-id", required=True)
    p.add_argument("--model", required=True)
    p.add_argument("--base-model", required=True)
    p.add_argument("--adapter-path")
    p.add_argument("--conditions", default=",".join(CONDITIONS))
    p.add_argument("--stopped", action="store_true", help="the run ended early")
    p.add_argument("--max-new-tokens", type=int, default=1536)
    p.add_argument("--quantization", default="nf4-4bit")
    p.add_argument("--thinking", action="store_true")
    p.add_argument("--thinking-budget", type=int, default=1536)
    p.add_argument("--max-runtime-seconds", type=int, default=0)
    p.add_argument("--offset", type=int, default=0)
    p.add_argument("--limit", type=int, default=0)
    p.add_argument("--shard", type=int, default=0)
    p.add_argument("--shards", type=int, default=1)
    p.add_argument("--require-adapter", action="store_true")

    p = job.add_parser("load-seed", help="replace the warehouse tables by the CSV files")
    p.add_argument("csv_dir")
    p.add_argument("out_dir")
    p.add_argument("--tables", nargs="*")

    p = job.add_parser("score-stream", help="update running accuracy with new scored files")
    p.add_argument("source")
    p.add_argument("output")
    p.add_argument("checkpoint")
    p.add_argument("--files-per-batch", type=int)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or build_session(shuffle_partitions=args.shuffle_partitions)
    if args.job == "validate":
        found, quota = validate(
            spark, args.data, args.eval, args.known, args.require_ready, args.ingested)
        validation.error_messages(found, keep=["rule", "detail"]).write.mode("errorifexists").parquet(args.out)
        # The folder has every message; the console has their number per rule.
        by_rule = spark.read.parquet(args.out).groupBy("rule").count().orderBy("rule").collect()
        lines = [f"{r['rule']}: {r['count']}" for r in by_rule]
        if quota is not None and not quota.isEmpty():
            lines.append("difficulty quota not met")
        print("\n".join(lines) if lines else f"{args.data}: no violations")
        return 1 if lines else 0
    if args.job == "ingest":
        jsonl.ingest_sft(spark, args.data, args.output)
    elif args.job == "build":
        sinks.write_jsonl(build_chat(spark, args.data, args.template, args.context), args.output)
    elif args.job == "analyze" and args.errors_only:
        wrong = errors_only(spark, args.eval, args.results)
        if not args.out:
            raise ValueError("--errors-only needs --out: there may be any number of wrong examples")
        sinks.write_jsonl(wrong, args.out)
    elif args.job == "analyze":
        table = analyze(spark, args.eval, args.results, args.axis)
        if args.out:
            sinks.write_jsonl(table, args.out)
        else:
            order = [c for c in ("file", "axis", "axis_value") if c in table.columns]
            show_all(table.withColumn("accuracy", three_decimals(ratio(F.col("correct"), F.col("total")))).orderBy(*order))
    elif args.job == "compare":
        per_run, check = compare_runs(spark, args.root, args.registry)
        if not check.first()["comparable"]:
            raise ValueError("runs do not have the same, non-empty set of rows and hard rows")
        shares = ["accuracy_p0", "accuracy_p1", "hard_accuracy_p0"]
        if args.out:
            sinks.write_jsonl(per_run, args.out)
        else:
            show_all(per_run.withColumns({c: whole_percent(F.col(c)) for c in shares}))
    elif args.job == "lengths":
        report = length_report(spark, args.data, args.limit)
        if args.out:
            sinks.write_jsonl(report, args.out)
        else:
            show_all(report)
    elif args.job == "check-chat":
        sinks.write_jsonl(chat_problems(spark, args.data), args.output)
    elif args.job == "lint":
        sinks.write_jsonl(lint_file(spark, args.data), args.output)
    elif args.job == "triage":
        accepted, review = triage_candidates(spark, args.candidates, args.first, args.second)
        accepted.write.mode("errorifexists").text(args.accepted_out)
        review.write.mode("errorifexists").text(args.review_out)
    elif args.job == "manifest":
        row, changes = manifest(spark, args.data, args.version, args.base, args.curriculum)
        if args.changes_out and changes is not None:
            sinks.write_jsonl(changes, args.changes_out)
        sinks.write_manifest(row, args.output)
    elif args.job == "prompts":
        chosen = selected_conditions(args.conditions)
        sinks.write_jsonl(
            pending_prompts(spark, args.bundle, args.done, chosen, args.offset, args.limit, args.shard, args.shards),
            args.output)
    elif args.job == "collect-answers":
        sinks.write_manifest(collect_answers(
            spark, args.bundle, args.answers, args.records, selected_conditions(args.conditions), args.run_id,
            args.model, args.base_model, args.adapter_path, args.stopped, args.max_new_tokens, args.quantization,
            args.thinking, args.thinking_budget, args.max_runtime_seconds, args.offset, args.limit, args.shard,
            args.shards, args.require_adapter), args.manifest)
    elif args.job == "load-seed":
        warehouse.load_seed(spark, args.csv_dir, args.out_dir, args.tables)
    elif args.job == "score-stream":
        keep_verdicts(scored_stream(spark, args.source, args.files_per_batch), args.output,
                      args.checkpoint).awaitTermination()
        show_all(latest_accuracy(spark, args.output).orderBy("condition"))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
