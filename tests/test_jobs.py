import hashlib
import json
from types import SimpleNamespace

import pytest

from querykiln import jobs
from querykiln.operators import curation
from querykiln.schemas import WAREHOUSE
from querykiln.session import shared_folder
from querykiln.sources import jsonl, records, runs, warehouse
from querykiln.streaming.scoring import keep_verdicts, latest_accuracy, running_accuracy, scored_stream
from tests.test_validation import example, write


def read_json(folder):
    return [json.loads(line) for part in sorted(folder.glob("part-*")) for line in part.read_text("utf-8").splitlines()]


@pytest.fixture
def files(tmp_path):
    return {
        "data": write(tmp_path / "d.jsonl", [example(1), example(2, question_de="Größe?"), example(3, question_de="frage 1?")]),
        "eval": write(tmp_path / "e.jsonl", [example(9), example(9, axis_time="window_abs"), example(8)]),
        "dir": tmp_path,
    }


def test_validate(spark, files, capsys):
    out = str(files["dir"] / "found")
    assert jobs.main(["validate", files["data"], "--eval", files["eval"], "--require-ready", "--out", out], spark) == 1
    assert capsys.readouterr().out.splitlines() == ["duplicate question: 1", "difficulty quota not met"]
    assert [r.message for r in spark.read.parquet(out).collect()] == ["line 3: duplicate question"]
    clean = write(files["dir"] / "clean.jsonl", [example(1)])
    assert jobs.main(["validate", clean, "--eval", files["eval"], "--out", out + "2"], spark) == 0


def without(row, key):
    return {k: v for k, v in row.items() if k != key}


def test_validate_reports_every_violation(spark, files, capsys):
    data = write(files["dir"] / "many.jsonl", [example(i, difficulty="odd") for i in range(1500)])
    out = str(files["dir"] / "many")
    assert jobs.main(["validate", data, "--eval", files["eval"], "--out", out], spark) == 1
    assert spark.read.parquet(out).filter("rule = 'invalid difficulty'").count() == 1500
    assert "invalid difficulty: 1500" in capsys.readouterr().out


def test_held_out_row_without_keys_stops(spark, files):
    bad = write(files["dir"] / "bad.jsonl", [without(example(9), "seed_id")])
    with pytest.raises(Exception, match="seed_id"):
        jobs.main(["validate", files["data"], "--eval", bad, "--out", str(files["dir"] / "x")], spark)


def test_build_stops_at_a_needed_field_only(spark, files):
    text = files["dir"] / "t.txt"
    text.write_text("{{question_de}}", "utf-8")
    good = write(files["dir"] / "good.jsonl", [example(1), without(example(2), "axis_time")])
    assert jobs.build_chat(spark, good, str(text), str(text)).count() == 2
    bad = write(files["dir"] / "bad.jsonl", [example(1), without(example(2), "gold_sql")])
    with pytest.raises(Exception, match="gold_sql"):
        jobs.build_chat(spark, bad, str(text), str(text)).collect()


def test_validate_ingested_copies(spark, files, rows):
    known = write(files["dir"] / "k.jsonl", [example(1), "", example(7)])
    second = write(files["dir"] / "k2.jsonl", [example(5)])
    paths = {"data": files["data"], "eval": files["eval"], "known": known, "second": second}
    for name, path in paths.items():
        jobs.main(["ingest", path, str(files["dir"] / f"{name}.parquet")], spark)
    copy = {n: str(files["dir"] / f"{n}.parquet") for n in paths}
    plain, _ = jobs.validate(spark, files["data"], files["eval"], [known, second])
    fast, _ = jobs.validate(spark, copy["data"], copy["eval"], [copy["known"], copy["second"]], ingested=True)
    assert rows(fast) == rows(plain)
    assert {r.line_number for r in fast.collect()} == {4, 6}


def test_build_refuses_to_overwrite(spark, files):
    template, context = files["dir"] / "t.txt", files["dir"] / "c.md"
    template.write_text("{{schema_context}}\nFrage: {{question_de}}", "utf-8")
    context.write_text("Zeile 1\nZeile 2", "utf-8")
    out = files["dir"] / "chat"
    args = ["build", files["data"], str(out), "--template", str(template), "--context", str(context)]
    jobs.main(args, spark)
    records = read_json(out)
    assert records[1]["messages"][0] == {"role": "user", "content": "Zeile 1\nZeile 2\nFrage: Größe?"}
    assert "Größe" in next(out.glob("part-*")).read_text("utf-8")
    with pytest.raises(Exception):
        jobs.main(args, spark)
    assert jobs.chat_problems(spark, str(out)).count() == 0
    assert jobs.length_report(spark, str(out), 5).first()["records"] == 3


def scored(i, ok, cond="P0", diff="hard"):
    return dict(example_id=f"e{i}", condition=cond, difficulty=diff, result_equivalent=ok, error_class=None, generated_sql="x")


def test_analyze_and_errors(spark, files, rows):
    res = [write(files["dir"] / f"{c}.jsonl", [scored(9, True, c), scored(8, ok, c), scored(7, True, c)])
           for c, ok in (("P0", False), ("P1", None))]
    got = rows(jobs.analyze(spark, files["eval"], res, "axis_time").select("condition", "axis_value", "correct", "total"))
    assert got == [("P0", "ALL", 1, 2), ("P0", "none", 0, 1), ("P0", "window_abs", 1, 1),
                   ("P1", "ALL", 1, 2), ("P1", "none", 0, 1), ("P1", "window_abs", 1, 1)]
    wrong = rows(jobs.errors_only(spark, files["eval"], res).select("condition", "example_id"))
    assert wrong == [("P0", "e8"), ("P1", "e8")]
    assert jobs.main(["analyze", files["eval"], *res], spark) == 0


def test_compare_runs(spark, files, rows):
    for run, ok in (("m-a", True), ("m-b", False)):
        folder = files["dir"] / "runs" / "offline" / run
        folder.mkdir(parents=True)
        for cond in ("p0", "p1"):
            write(folder / f"{cond}.jsonl", [scored(1, ok, cond.upper()), scored(2, True, cond.upper(), "easy")])
    registry = files["dir"] / "registry.csv"
    registry.write_text("ord,scope,run,label,grp\n2,offline,m-a,Model A,small\n1,offline,m-b,Model B,large\n")
    table, check = jobs.compare_runs(spark, str(files["dir"] / "runs"), str(registry))
    assert [(r.label, r.accuracy_p0, r.hard_accuracy_p0) for r in table.collect()] == [("Model B", 0.5, 0.0), ("Model A", 1.0, 1.0)]
    assert check.first()["comparable"]
    assert jobs.main(["compare", str(files["dir"] / "runs"), "--registry", str(registry)], spark) == 0


def test_triage_job(spark, files):
    files["data"] = write(files["dir"] / "c.jsonl", [example(i, split="iid", origin={"by": "hand"}) for i in (1, 2, 3)])
    first = write(files["dir"] / "m1.jsonl", [scored(1, True), scored(2, True)])
    second = write(files["dir"] / "m2.jsonl", [scored(1, True), scored(2, False), scored(3, True)])
    out = {n: files["dir"] / n for n in ("accepted", "review")}
    jobs.main(["triage", files["data"], first, second, "--accepted-out", str(out["accepted"]),
               "--review-out", str(out["review"])], spark)
    read_lines = lambda path: [json.loads(x) for p in path.glob("part-*") for x in p.read_text("utf-8").splitlines()]
    ids = {n: sorted(r["example_id"] for r in read_lines(path)) for n, path in out.items()}
    assert ids == {"accepted": ["e1"], "review": ["e2", "e3"]}
    assert read_lines(out["accepted"])[0] == example(1, split="iid", origin={"by": "hand"})


def test_missing_run_file_is_an_error(spark, files):
    folder = files["dir"] / "runs" / "offline" / "m"
    folder.mkdir(parents=True)
    write(folder / "p0.jsonl", [scored(1, True)])
    registry = files["dir"] / "registry.csv"
    registry.write_text("ord,scope,run,label,grp\n1,offline,m,M,g\n")
    with pytest.raises(ValueError, match="offline/m/P1"):
        jobs.compare_runs(spark, str(files["dir"] / "runs"), str(registry))
    _, check = jobs.compare_runs(spark, str(files["dir"] / "runs"), None)
    assert not check.first()["comparable"]


def test_empty_chat_file_is_an_error(spark, files):
    with pytest.raises(ValueError, match="no chat records"):
        jobs.chat_problems(spark, write(files["dir"] / "none.jsonl", ["", " "]))


def test_file_digest(spark, files):
    row = curation.file_sha256(spark, files["data"]).first()
    assert row["sha256"] == hashlib.sha256(open(files["data"], "rb").read()).hexdigest()


def test_manifest_and_lint(spark, files):
    out = files["dir"] / "manifest"
    jobs.main(["manifest", files["data"], "v9", str(out)], spark)
    (row,) = read_json(out)
    assert row["selected_candidates"] == 3 and row["difficulty"] == {"easy": 3} and len(row["content_fingerprint"]) == 64
    assert row["candidate_sha256"] == hashlib.sha256(open(files["data"], "rb").read()).hexdigest()
    jobs.main(["lint", files["data"], str(files["dir"] / "lint")], spark)
    assert read_json(files["dir"] / "lint") == []


def test_manifest_lists_what_changed(spark, files):
    old = [example(i) for i in range(6)]
    new = [dict(reversed(old[0].items())), dict(old[1], axis_time="window_rel"), old[3], dict(old[4], note="n"), example(10), example(11)]
    paths = [write(files["dir"] / f"v{i}.jsonl", v) for i, v in enumerate((old, new))]
    out, changes = files["dir"] / "manifest", files["dir"] / "changes"
    jobs.main(["manifest", paths[1], "v2", str(out), "--base", paths[0], "--changes-out", str(changes), "--curriculum", "c"], spark)
    (row,) = read_json(out)
    ids = lambda *numbers: sorted(example(i)["example_id"] for i in numbers)
    assert row["fixed_ids"] == ids(1, 4) and row["added_ids"] == ids(10, 11) and row["removed_repetition_ids"] == ids(2, 5)
    assert row["base"] == paths[0] and row["curriculum"] == "c" and len(read_json(changes)) == 6


def bundle(files, contexts=("P0", "P1", "P2")):
    path = files["dir"] / "bundle.json"
    path.write_text(json.dumps(dict(
        examples=[dict(example_id=f"e{i}", question_de=f"q{i}", split="iid") for i in range(4)],
        contexts={c: f"ctx {c}" for c in contexts}, prompt_template="{{schema_context}}/{{question_de}}",
        prompt_version="p", eval_version="v"), indent=1), "utf-8")
    return str(path)


def test_pending_prompts(spark, files, rows):
    done = str(files["dir"] / "done")
    records.append_records(
        spark.createDataFrame([("P0", "e1", "x")], "condition string, example_id string, generated_sql string"), done, ["P0"])
    out = files["dir"] / "prompts"
    jobs.main(["prompts", bundle(files), str(out), "--done", done, "--conditions", "p0,P2", "--offset", "1", "--limit", "2"], spark)
    assert sorted((r["condition"], r["prompt"]) for r in read_json(out)) == [
        ("P0", "ctx P0/q2"), ("P2", "ctx P2/q1"), ("P2", "ctx P2/q2")]
    with pytest.raises(Exception, match="P0, P1 and P2"):
        jsonl.read_bundle(spark, bundle(files, ("P0",))).collect()


@pytest.mark.parametrize("text", ["", "P3", "P0,p0"])
def test_bad_conditions(text):
    with pytest.raises(ValueError):
        jobs.selected_conditions(text)


def test_seed_load_replaces(spark, files):
    folder = files["dir"] / "seed"
    folder.mkdir()
    (folder / "categories.csv").write_text("category_id,category_name,parent_category_id\n1,Top,\n2,Leaf,1\n")
    out = str(files["dir"] / "wh")
    for _ in range(2):
        jobs.main(["load-seed", str(folder), out, "--tables", "categories"], spark)
    number, versions = warehouse.current_versions(spark, out)
    assert number == 2 and [tuple(r) for r in warehouse.open_table(
        spark, out, "categories", versions).orderBy("category_id").collect()] == [(1, "Top", None), (2, "Leaf", 1)]
    (folder / "categories.csv").write_text("category_id,category_name,parent_category_id\nx,Top,\n")
    with pytest.raises(Exception):
        warehouse.read_seed_csv(spark, "categories", str(folder / "categories.csv")).collect()


def test_seed_load_replaces_all_tables_or_none(spark, files):
    folder, out = files["dir"] / "seeds", str(files["dir"] / "whole")
    folder.mkdir()

    def seed(name):
        for table in WAREHOUSE:
            fields = [(f.name, f.dataType.simpleString())
                      for f in warehouse.read_seed_csv(spark, table, str(folder)).schema]
            cell = {"bigint": "1", "string": name, "date": "2024-01-01", "boolean": "true", "timestamp": "2024-01-01 00:00:00"}
            (folder / f"{table}.csv").write_text("\n".join([
                ",".join(n for n, _ in fields), ",".join(cell.get(kind, "1") for _, kind in fields)]) + "\n")

    seed("old")
    warehouse.load_seed(spark, str(folder), out)
    first = warehouse.open_warehouse(spark, out)
    assert first.channels.first()["channel_name"] == "old"
    seed("new")
    broken = list(WAREHOUSE)[4]
    whole = (folder / f"{broken}.csv").read_text()
    (folder / f"{broken}.csv").write_text(whole + "x" * 9 + "\n")
    with pytest.raises(Exception):
        warehouse.load_seed(spark, str(folder), out)
    # The first tables of the failed load are written, and nobody reads them.
    assert warehouse.current_versions(spark, out)[0] == 1
    for table in WAREHOUSE:
        assert "new" not in map(str, getattr(warehouse.open_warehouse(spark, out), table).first())
    (folder / f"{broken}.csv").write_text(whole)
    warehouse.load_seed(spark, str(folder), out)
    assert warehouse.open_warehouse(spark, out).channels.first()["channel_name"] == "new"
    # An earlier commit stays readable, and a load of one table keeps the others.
    assert warehouse.open_warehouse(spark, out, 1).channels.first()["channel_name"] == "old"
    seed("third")
    warehouse.load_seed(spark, str(folder), out, ["products"])
    wh = warehouse.open_warehouse(spark, out)
    assert wh.products.first()["product_name"] == "third" and wh.channels.first()["channel_name"] == "new"
    with pytest.raises(ValueError, match="no commit 9"):
        warehouse.open_warehouse(spark, out, 9)
    spark.createDataFrame([(3, "products", "x")], "number bigint, table_name string, version string").write.mode(
        "append").parquet(f"{out}/commits")
    with pytest.raises(ValueError, match="made twice"):
        warehouse.open_warehouse(spark, out)


def test_appended_records_stand_once(spark, files, rows):
    out, both = str(files["dir"] / "records"), ["P0", "P1"]
    part = lambda *v: spark.createDataFrame(list(v), "condition string, example_id string")
    seen = lambda: rows(records.read_records(spark, out).select("condition", "example_id"))
    assert records.read_records(spark, out) is None and records.append_records(part(), out, both) == 0
    # A job that was killed before its commit has left files, and perhaps a folder for its entry.
    lost = records.stage(part(("P0", "a"), ("P0", "z")), out)
    (files["dir"] / "records" / "commits" / f"batch={lost}").mkdir(parents=True)
    assert records.read_records(spark, out) is None
    assert records.append_records(part(("P0", "a")), out, both) == 1
    for expected in (2, 0, 0):
        assert records.append_records(part(("P1", "a"), ("P0", "b"), ("P0", "a")), out, both) == expected
        assert seen() == [("P0", "a"), ("P0", "b"), ("P1", "a")]
    with pytest.raises(ValueError, match="P0/c: duplicate"):
        records.append_records(part(("P0", "c"), ("P0", "c")), out, both)
    with pytest.raises(ValueError, match="P2/c: unexpected"):
        records.append_records(part(("P2", "c")), out, both)
    assert seen() == [("P0", "a"), ("P0", "b"), ("P1", "a")]
    records.commit(spark, out, lost, 2)  # as by a second writer at the same time
    with pytest.raises(ValueError, match="P0/a: duplicate"):
        records.append_records(part(("P0", "d")), out, both)
    plan = records.read_records(spark, out).where("condition = 'P1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(condition" in plan


def test_run_store_opens_only_what_is_asked_for(spark, files, rows):
    store = str(files["dir"] / "store")
    data = [(s, r, c, f"e{i}", i % 2 == 0) for s in ("eval", "ood") for r in ("a", "b") for c in ("P0", "P1") for i in range(3)]
    runs.save_runs(spark.createDataFrame(data, "scope string, run string, file_condition string, example_id string, ok boolean"), store)
    registry = write_registry(spark, files["dir"] / "runs.csv")
    got = runs.open_runs(spark, store, registry.where("grp = 'x'"), ["P0"])
    assert rows(got.select("scope", "run", "file_condition").distinct()) == [("eval", "a", "P0")]
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    filters = [x.split("PartitionFilters: ")[1].split("PushedFilters")[0] for x in plan.splitlines() if "FileScan parquet" in x]
    assert "file_condition" in filters[0] and "dynamicpruning" in filters[0], plan
    assert rows(runs.unregistered_runs(runs.open_runs(spark, store), registry)) == [
        ("eval", "b", "P0", 3), ("eval", "b", "P1", 3), ("ood", "a", "P0", 3), ("ood", "a", "P1", 3)]


def write_registry(spark, path):
    path.write_text("ord,scope,run,label,grp\n1,eval,a,A,x\n2,ood,b,B,y\n")
    return spark.read.option("header", True).csv(str(path))


def test_stream_counts_each_key_once_and_resumes(spark, files, rows):
    source, out, mark = files["dir"] / "in", str(files["dir"] / "acc"), str(files["dir"] / "cp")
    source.mkdir()
    run = lambda: keep_verdicts(scored_stream(spark, str(source), 1), out, mark).awaitTermination()
    write(source / "a.jsonl", [scored(1, True), scored(2, None)])
    write(source / "b.jsonl", [scored(1, True), scored(1, False, "P1")])
    run()
    assert rows(latest_accuracy(spark, out)) == [("P0", 2, 1, 0.5), ("P1", 1, 0, 0.0)]
    write(source / "c.jsonl", [scored(2, None), scored(3, True)])
    run()
    assert rows(latest_accuracy(spark, out)) == [("P0", 3, 2, 0.666667), ("P1", 1, 0, 0.0)]
    assert spark.read.parquet(out).count() == 4


@pytest.mark.parametrize("order", ["abc", "cab", "bca"])
def test_stream_does_not_depend_on_the_order_of_disagreeing_copies(spark, files, rows, order):
    batches = {"a": [scored(1, True), scored(1, False), scored(2, True)], "b": [scored(1, True), scored(2, True)],
               "c": [scored(2, False), scored(3, True)]}
    source, out, mark = files["dir"] / "in", str(files["dir"] / "acc"), str(files["dir"] / "cp")
    source.mkdir()
    for name in order:
        write(source / f"{name}.jsonl", batches[name])
        keep_verdicts(scored_stream(spark, str(source), 1), out, mark).awaitTermination()
    assert rows(latest_accuracy(spark, out)) == [("P0", 3, 1, 0.333333)]


def test_repeats_count_once(spark, rows):
    data = [("P0", "hot", True)] * 500 + [("P0", "a", None), ("P1", "hot", False)]
    frame = spark.createDataFrame(data, "condition string, example_id string, result_equivalent boolean")
    assert rows(running_accuracy(frame)) == [("P0", 2, 1, 0.5), ("P1", 1, 0, 0.0)]


def test_generation_cycle_closes(spark, files):
    path, store = bundle(files), str(files["dir"] / "records")
    answer = lambda c, i: dict(condition=c, example_id=f"e{i}", generated_text=f"SELECT {i}", latency_ms=5,
                               thinking_tokens=0, generated_tokens=3)
    done = []
    for turn, cells in enumerate([[("P0", 0), ("P0", 1)], [("P0", 2), ("P0", 3), ("P1", 0), ("P1", 1), ("P1", 2), ("P1", 3)]]):
        answers = write(files["dir"] / f"a{turn}.jsonl", [answer(*cell) for cell in cells])
        out = files["dir"] / f"m{turn}"
        jobs.main(["collect-answers", path, answers, store, str(out), "--run-id", "r", "--model", "m", "--base-model", "b",
                   "--conditions", "P0,P1", "--adapter-path", "ad", "--require-adapter"], spark)
        (row,) = read_json(out)
        done += cells
        assert row["records"] == len(done) and row["complete"] is (turn == 1) and row["adapter_required"] is True
        assert row["bundle_sha256"] == hashlib.sha256(open(path, "rb").read()).hexdigest() and row["result_file"] == store
        left = jobs.pending_prompts(spark, path, store, ["P0", "P1"])
        assert left.count() == 8 - len(done)
    again = jobs.collect_answers(spark, path, answers, store, ["P0", "P1"], "r", "m", "b").first()
    assert again.records == 8 and again.complete and records.read_records(spark, store).count() == 8
    part = jobs.collect_answers(spark, path, answers, store, ["P0", "P1"], "r", "m", "b", offset=1, limit=2, max_runtime_seconds=60).first()
    assert (part.records, part.complete, part.record_offset, part.record_limit, part.max_runtime_seconds) == (4, True, 1, 2, 60)
    with pytest.raises(ValueError, match="empty"):
        jobs.pending_prompts(spark, path, None, ["P0"], offset=4)
    with pytest.raises(ValueError, match="adapter"):
        jobs.collect_answers(spark, path, answers, store, ["P0"], "r", "m", "b", require_adapter=True)
    parts = [jobs.pending_prompts(spark, path, None, ["P0", "P1"], shard=i, shards=3).count() for i in range(3)]
    assert sum(parts) == 8
    with pytest.raises(ValueError, match="unexpected condition"):
        jobs.pending_prompts(spark, path, store, ["P0"])
    batch = records.stage(records.read_records(spark, store).filter("example_id = 'e1' and condition = 'P0'"), store)
    records.commit(spark, store, batch, 1)
    with pytest.raises(ValueError, match="P0/e1: duplicate"):
        jobs.pending_prompts(spark, path, store, ["P0", "P1"])


def session_with(master, **conf):
    return SimpleNamespace(conf=conf_reader(conf), sparkContext=SimpleNamespace(master=master))


def conf_reader(conf):
    return SimpleNamespace(get=lambda key, default=None: conf.get(key.replace(".", "_"), default))


def test_shared_folder_follows_the_session(spark):
    named = session_with("yarn", spark_checkpoint_dir="hdfs:///shared/")
    assert shared_folder(named, "x").startswith("hdfs:///shared/querykiln/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session_with("yarn"), "x")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
