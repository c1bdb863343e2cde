"""Queries over question/SQL examples: validation, lint, curation, chat records, lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querykiln.fixtures import views as V
from querykiln.fixtures.oracle_views import with_views
from querykiln.functions.text import (
    drop_prefix, last_subsequence_index, normalize, strip_sql_fences, through_marker,
)
from querykiln.operators import chat, curation, lengths, triage, validation
from querykiln.operators.lint import lint, passes_lint
from querykiln.session import kept
from querykiln.sources.jsonl import missing_keys, parse_json
from querykiln.schemas import AXES, QUALITY_GATES, SFT_CANDIDATE, SFT_REQUIRED_KEYS

# Short texts in the place of the prompt files, which a job reads from its arguments.
TEMPLATE = "Answer with one SQL query.\n# Schema\n{{schema_context}}\n# Question\n{{question_de}}\n# SQL\n"
CONTEXT = "Tables of ecom_v1: orders, order_items, products, customers."
GENERATOR_TEMPLATE = (
    "Write a new example.\nNovelty: {{novelty_directive}}\nFamily: {{family_metadata}}\n"
    "Question: {{source_question_de}}\nSQL: {{source_gold_sql}}\nSchema: {{schema}}\n"
    "Glossary: {{glossary}}\n")
GLOSSARY = "Net revenue excludes VAT and cancelled orders."
TOKEN_LIMIT = 512


def _sql(text: str) -> str:
    """A Python string as a DuckDB literal."""
    return "e'" + text.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n") + "'"


def required_keys(spark, sf_dir: str) -> DataFrame:
    """Missing keys of raw JSON lines (an absent key, not a null, is missing)."""
    rows = V.train(spark, sf_dir)
    present = lambda k: F.when(~F.array_contains("missing_keys", k), F.col(k)).alias(k)
    raw = F.to_json(F.struct(*[present(k) for k in SFT_REQUIRED_KEYS]))
    found = rows.select("line_number", raw.alias("raw")).select(
        "line_number", missing_keys(F.col("raw"), SFT_REQUIRED_KEYS).alias("m"),
        parse_json(F.col("raw"), SFT_CANDIDATE).alias("r"))
    return found.select("line_number", F.array_join("m", ",").alias("missing"),
                        F.char_length("r.question_de").cast("bigint").alias("question_chars"))


def sft_violations(spark, sf_dir: str) -> DataFrame:
    return validation.violations(V.train(spark, sf_dir), V.evaluation(spark, sf_dir))


def violation_counts(spark, sf_dir: str) -> DataFrame:
    return sft_violations(spark, sf_dir).groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_values(spark, sf_dir: str) -> DataFrame:
    return curation.duplicate_values(V.train(spark, sf_dir))


def cross_dataset_dedup(spark, sf_dir: str) -> DataFrame:
    """Surviving row per question text over all sets: eval rows first, then by line."""
    rows = V.examples(spark, sf_dir).withColumn(
        "set_order", F.when(F.col("source").isin(V.EVAL_SOURCES), 0).otherwise(1))
    return curation.dedup_gate(rows, normalize(F.col("question_de")), ["set_order", "line_number"])


def leakage_hits(spark, sf_dir: str) -> DataFrame:
    return curation.leakage_hits(V.train(spark, sf_dir), V.evaluation(spark, sf_dir))


def held_out_guard(spark, sf_dir: str) -> DataFrame:
    """Training inputs that are in fact held-out examples (here: the Spanish ones)."""
    held_out = V.examples(spark, sf_dir).filter("lang = 'es'")
    return triage.held_out_violations(V.train(spark, sf_dir).select("example_id", "source"), held_out)


def known_batch_duplicates(spark, sf_dir: str) -> DataFrame:
    """Duplicates in the train set once known batches are put in front of it."""
    batches = validation.prepend_known(V.train(spark, sf_dir).filter(~F.col("source").isin("src0", "src1")),
                                       [V.known(spark, sf_dir), V.evaluation(spark, sf_dir)])
    rows = validation.complete(validation.union_batches(batches))
    found = validation.key_violations(rows, None, "position")
    at = F.col("position")
    return found.select(validation.batch_of(at).alias("batch"), validation.line_of(at).alias("line_number"), "rule")


def quota_gap(spark, sf_dir: str) -> DataFrame:
    return validation.quota_report(V.train(spark, sf_dir))


def house_term_share(spark, sf_dir: str) -> DataFrame:
    return curation.house_term_share(V.train(spark, sf_dir))


def candidate_budget(spark, sf_dir: str) -> DataFrame:
    return curation.budget_check(V.train(spark, sf_dir))


def axis_vocabulary_drift(spark, sf_dir: str) -> DataFrame:
    return validation.vocabulary_drift(V.train(spark, sf_dir))


def prohibited_inputs(spark, sf_dir: str) -> DataFrame:
    """Train rows whose lineage names a prohibited source."""
    lineage = V.train(spark, sf_dir).select("example_id", F.col("source").alias("source_file"))
    return validation.prohibited_inputs(lineage, V.PROHIBITED)


def disallowed_contexts(spark, sf_dir: str) -> DataFrame:
    """Train rows whose schema context is not one of the allowed files."""
    lineage = V.train(spark, sf_dir).select("example_id", F.concat("lang", F.lit(".md")).alias("context_file"))
    return validation.disallowed_contexts(lineage, ["en.md", "de.md"])


def sql_lint(spark, sf_dir: str) -> DataFrame:
    return lint(V.sql_texts(spark, sf_dir))


def gate_funnel(spark, sf_dir: str) -> DataFrame:
    """Survivors of the six quality gates over the train set."""
    rows = V.train(spark, sf_dir)
    first = curation.dedup_gate(rows, normalize(F.col("question_de")), ["line_number"])
    marked = rows.join(first.select("example_id", F.lit(True).alias("is_first")), "example_id", "left")
    return triage.gate_funnel(marked, dict(zip(QUALITY_GATES, [
        F.size("missing_keys") == 0, passes_lint(F.col("gold_sql")), F.col("doc_id") % 5 != 0, F.col("n_chars") > 300,
        F.col("doc_id") % 11 != 0, F.col("is_first")], strict=True)))


def dataset_version_diff(spark, sf_dir: str) -> DataFrame:
    """Axis counts of the base set and its successor: some removed, corrected and added rows."""
    base, every = V.train(spark, sf_dir), V.every
    removed = base.filter(every(9))
    fixed = base.filter(F.col("doc_id") % 50 == 1).withColumn("axis_structure", F.lit("flat"))
    added = V.evaluation(spark, sf_dir).filter(every(3))
    return curation.version_diff(base, curation.next_version(base, removed, added, fixed))


def _versions(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    base, every = V.train(spark, sf_dir), V.every
    fixed = base.filter(F.col("doc_id") % 50 == 1).withColumn("axis_structure", F.lit("flat"))
    return base, curation.next_version(base, base.filter(every(9)), V.evaluation(spark, sf_dir).filter(every(3)), fixed)


def dataset_change_sets(spark, sf_dir: str) -> DataFrame:
    """Ids removed, added and fixed between two versions, found from the versions alone."""
    base, new = _versions(spark, sf_dir)
    return curation.version_changes(base, new, [c for c in base.columns if c != "example_id"])


def dataset_manifest_row(spark, sf_dir: str) -> DataFrame:
    """The manifest of a version, its maps as text, with the digests of its change lists."""
    base, new = _versions(spark, sf_dir)
    changes = kept(curation.version_changes(base, new, [c for c in base.columns if c != "example_id"]), "changes")
    row = curation.dataset_manifest(new, "v4.1", F.col("example_id"))
    joined = lambda a: F.array_join(F.transform(F.map_entries(a), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",").alias(a)
    both = row.select("version", "selected_candidates", *[joined(a.removeprefix("axis_")) for a in AXES]).unionByName(
        curation.change_digests(changes), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])  # of two single rows, each column is in one


def ablation_subsets(spark, sf_dir: str) -> DataFrame:
    return curation.ablation_subsets(V.train(spark, sf_dir), seed="7")


def dataset_manifest(spark, sf_dir: str) -> DataFrame:
    """Axis counts of the manifest in long form."""
    return curation.axis_counts(V.train(spark, sf_dir))


def step_plan(spark, sf_dir: str) -> DataFrame:
    """Training steps that a set of this size leads to."""
    return curation.step_plan(V.train(spark, sf_dir))


def dataset_fingerprint(spark, sf_dir: str) -> DataFrame:
    text = F.concat_ws("|", "doc_id", "lang", "source", "text")
    return curation.fingerprint(V.table(spark, sf_dir, "documents"), text)


def chat_records(spark, sf_dir: str) -> DataFrame:
    """The two messages of each chat record, flattened."""
    records = chat.chat_records(V.train(spark, sf_dir), TEMPLATE, CONTEXT)
    return records.select(
        "example_id", "seed_id", "schema", "difficulty",
        F.col("messages")[0]["role"].alias("first_role"), F.col("messages")[0]["content"].alias("prompt"),
        F.col("messages")[1]["role"].alias("second_role"), F.col("messages")[1]["content"].alias("answer"))


def typed_messages(spark, sf_dir: str) -> DataFrame:
    """One row per typed content part."""
    records = chat.typed_messages(chat.chat_records(V.train(spark, sf_dir), TEMPLATE, CONTEXT))
    return (
        records.select("example_id", F.explode("messages").alias("m"))
        .select("example_id", "m.role", F.explode("m.content").alias("part"))
        .select("example_id", "role", "part.type", F.sha2("part.text", 256).alias("text_sha256"))
    )


def generator_prompts(spark, sf_dir: str) -> DataFrame:
    plan = V.plan(spark, sf_dir).select(
        "slot_id", F.concat(F.lit("vary "), "p_name").alias("novelty_directive"),
        F.concat_ws(";", "family", "split", "difficulty", "axis_structure").alias("family_metadata"),
        F.concat(F.lit("Umsatz von "), "p_type", F.lit("?")).alias("source_question_de"),
        F.concat(F.lit("SELECT 1 -- "), "p_brand").alias("source_gold_sql"))
    return chat.generator_prompts(plan, GENERATOR_TEMPLATE, CONTEXT, GLOSSARY).select("slot_id", "prompt")


def chat_contract_violations(spark, sf_dir: str) -> DataFrame:
    turns = V.table(spark, sf_dir, "conversations")
    return chat.turn_contract(turns).filter("problem is not null").select("conv_id", "turns", "problem")


def _rendered(spark, sf_dir: str) -> DataFrame:
    text = F.concat(
        F.lit("<|im_start|>user\n"), F.col("question_de"), F.lit("<|im_end|>\n<|im_start|>assistant\n"),
        F.col("gold_sql"), F.lit("<|im_end|>\n"))
    return V.examples(spark, sf_dir).select("example_id", text.alias("text"))


def token_length_report(spark, sf_dir: str) -> DataFrame:
    report = lengths.token_length_report(lengths.token_lengths(_rendered(spark, sf_dir)), TOKEN_LIMIT)
    return report


def supervised_tokens(spark, sf_dir: str) -> DataFrame:
    """Tokens of the answers of all conversations that meet the chat contract."""
    records = chat.records_from_turns(V.table(spark, sf_dir, "conversations"))
    rendered = records.select("example_id", chat.render_chat(F.col("messages")).alias("text"))
    return lengths.token_lengths(rendered).select(
        "example_id", "tokens", "prefix_tokens", "supervised_tokens")


def response_prefix(spark, sf_dir: str) -> DataFrame:
    """Rendered conversations without a leading marker, and their text up to the answer."""
    text = drop_prefix(F.concat(F.lit("<bos>"), "text"))
    return _rendered(spark, sf_dir).select(
        "example_id", F.char_length(text).cast("bigint").alias("chars"),
        F.sha2(through_marker(text, lengths.ASSISTANT_MARKER), 256).alias("prefix_sha256"))


def clean_outputs(spark, sf_dir: str) -> DataFrame:
    """Answers without fences, with and without the reasoning step."""
    return V.model_outputs(spark, sf_dir).select(
        "example_id", strip_sql_fences(F.col("generated_text")).alias("sql"),
        strip_sql_fences(F.col("generated_text"), strip_think=False).alias("sql_keep_think"))


def normalize_text(spark, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "documents").select("doc_id", normalize(F.col("text")).alias("normalized"))


def last_subsequence(spark, sf_dir: str) -> DataFrame:
    """Last place where the first two words of a document stand next to each other."""
    tokens = V.table(spark, sf_dir, "documents").select(
        "doc_id", F.split(normalize(F.col("text")), " ").alias("t"))
    return tokens.select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"),
        last_subsequence_index(F.col("t"), F.slice("t", 1, 2)).cast("bigint").alias("last_index"))


_KEYS = """
    keys AS (
        SELECT line_number, is_train, k.label, k.value FROM (
            SELECT line_number, is_train, unnest([
                {'label': 'example_id', 'value': example_id}, {'label': 'seed_id', 'value': seed_id},
                {'label': 'question', 'value': norm_question}, {'label': 'gold_sql', 'value': lower(gold_sql)}
            ]) AS k FROM fx_examples WHERE is_complete OR NOT is_train)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY label, value ORDER BY line_number) AS rn
        FROM keys WHERE is_train),
    held AS (SELECT DISTINCT label, value FROM keys WHERE NOT is_train)"""

_VIOLATIONS = f"""
    WITH {_KEYS},
    found AS (
        SELECT line_number, 'missing keys' AS rule,
               CASE WHEN doc_id % 122 = 0 THEN 'axis_time,gold_sql' ELSE 'axis_time' END AS detail
        FROM fx_train WHERE NOT is_complete
        UNION ALL SELECT line_number, 'unexpected schema', schema FROM fx_train
            WHERE is_complete AND schema <> 'ecom-v1'
        UNION ALL SELECT line_number, 'invalid difficulty', difficulty FROM fx_train
            WHERE is_complete AND difficulty NOT IN ('easy', 'medium', 'hard')
        UNION ALL SELECT line_number, 'seed_id must start with train_', seed_id FROM fx_train
            WHERE is_complete AND NOT starts_with(seed_id, 'train_')
        UNION ALL SELECT line_number, 'dynamic time function is forbidden', '' FROM fx_train
            WHERE is_complete AND doc_id % 59 = 0
        UNION ALL SELECT line_number, 'duplicate ' || label, '' FROM ranked WHERE rn > 1
        UNION ALL SELECT line_number, CASE label WHEN 'seed_id' THEN 'eval seed leakage'
            WHEN 'question' THEN 'eval question leakage' ELSE 'eval SQL leakage' END, ''
            FROM ranked SEMI JOIN held USING (label, value) WHERE label <> 'example_id')"""

_TOKENS = lambda text: f"len(regexp_extract_all({text}, '\\S+'))"
_RENDERED = f"""
    rendered AS (
        SELECT {_TOKENS("'<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || gold_sql || '<|im_end|>'")} AS n,
               {_TOKENS("'<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant'")} AS p
        FROM fx_examples)"""
_RANK = lambda f: f"list_sort(list(n))[CAST(round_even((count(*) - 1) * {f}, 0) AS BIGINT) + 1]"

_CHANGED = ("fx_train", "fx_evaluation")
_CHANGES = """WITH new AS (
    SELECT * REPLACE (CASE WHEN doc_id % 50 = 1 THEN 'flat' ELSE axis_structure END AS axis_structure)
    FROM fx_train WHERE doc_id % 9 <> 0
    UNION ALL SELECT * FROM fx_evaluation WHERE doc_id % 3 = 0),
    changes AS (
        SELECT * FROM (
            SELECT example_id, CASE WHEN n.example_id IS NULL THEN 'removed' WHEN b.example_id IS NULL THEN 'added'
                                    WHEN n.axis_structure <> b.axis_structure THEN 'fixed' END AS change
            FROM fx_train b FULL JOIN new n USING (example_id)) WHERE change IS NOT NULL)"""

QUERIES = {
    "required_keys": (required_keys, with_views("""
        SELECT line_number, CASE WHEN doc_id % 122 = 0 THEN 'axis_time,gold_sql'
                                 WHEN doc_id % 61 = 0 THEN 'axis_time' ELSE '' END AS missing,
               length(question_de) AS question_chars
        FROM fx_train""", "fx_train")),
    "sft_violations": (sft_violations, with_views(
        f"{_VIOLATIONS} SELECT line_number, rule, detail FROM found", "fx_train")),
    "violation_counts": (violation_counts, with_views(
        f'{_VIOLATIONS} SELECT rule, count(*) AS "rows" FROM found GROUP BY rule', "fx_train")),
    "duplicate_values": (duplicate_values, with_views("""
        WITH keys AS (
            SELECT unnest([{'l': 'example_id', 'v': example_id}, {'l': 'seed_id', 'v': seed_id},
                           {'l': 'question', 'v': norm_question}, {'l': 'gold_sql', 'v': lower(gold_sql)}]) AS k
            FROM fx_train),
        counted AS (SELECT k.l AS label, k.v, count(*) AS n FROM keys GROUP BY ALL HAVING count(*) > 1)
        SELECT label, count(*) AS "values", CAST(sum(n - 1) AS BIGINT) AS extra_copies
        FROM counted GROUP BY label""", "fx_train")),
    "cross_dataset_dedup": (cross_dataset_dedup, with_views("""
        SELECT set_order, line_number, example_id FROM (
            SELECT *, CASE WHEN is_train THEN 1 ELSE 0 END AS set_order,
                   row_number() OVER (PARTITION BY norm_question ORDER BY is_train, line_number) AS rn
            FROM fx_examples) WHERE rn = 1""", "fx_examples")),
    "leakage_hits": (leakage_hits, with_views(f"""
        WITH {_KEYS.replace("WHERE is_complete OR NOT is_train", "")}
        SELECT line_number, label FROM ranked SEMI JOIN held USING (label, value) WHERE label <> 'example_id'""",
        "fx_examples")),
    "held_out_guard": (held_out_guard, with_views(
        "SELECT example_id, source FROM fx_train WHERE lang = 'es'", "fx_train")),
    "known_batch_duplicates": (known_batch_duplicates, with_views("""
        WITH tagged AS (
            SELECT *, CASE WHEN NOT is_train THEN 0 WHEN is_known THEN 1 ELSE 2 END AS batch
            FROM fx_examples WHERE is_complete),
        keys AS (
            SELECT batch, line_number, unnest([
                {'l': 'example_id', 'v': example_id}, {'l': 'seed_id', 'v': seed_id},
                {'l': 'question', 'v': norm_question}, {'l': 'gold_sql', 'v': lower(gold_sql)}]) AS k FROM tagged),
        ranked AS (SELECT batch, line_number, 'duplicate ' || k.l AS rule,
                   row_number() OVER (PARTITION BY k.l, k.v ORDER BY batch, line_number) AS rn FROM keys)
        SELECT batch, line_number, rule FROM ranked WHERE rn > 1""", "fx_examples")),
    "quota_gap": (quota_gap, with_views("""
        WITH c AS (
            SELECT 'total' AS difficulty, count(*) AS actual, CAST(1000 AS BIGINT) AS target FROM fx_train
            UNION ALL SELECT 'easy', count(*) FILTER (difficulty = 'easy'), 334 FROM fx_train
            UNION ALL SELECT 'medium', count(*) FILTER (difficulty = 'medium'), 333 FROM fx_train
            UNION ALL SELECT 'hard', count(*) FILTER (difficulty = 'hard'), 333 FROM fx_train)
        SELECT difficulty, actual, target, actual - target AS gap, actual = target AS met FROM c""", "fx_train")),
    "house_term_share": (house_term_share, with_views("""
        WITH c AS (SELECT count(*) AS total, count(*) FILTER (axis_terminology = 'house_term') AS house_terms
                   FROM fx_train)
        SELECT total, house_terms, round(house_terms / total, 6) AS share,
               house_terms / total BETWEEN 0.4 AND 0.5 AS within_band FROM c""", "fx_train")),
    "candidate_budget": (candidate_budget, with_views("""
        SELECT count(*) AS candidates, count(*) BETWEEN 1500 AND 2000 AS within_budget FROM fx_train""",
        "fx_train")),
    "axis_vocabulary_drift": (axis_vocabulary_drift, with_views("""
        SELECT 'axis_structure' AS axis, axis_structure AS value, count(*) AS "rows" FROM fx_train
        WHERE axis_structure NOT IN ('flat', 'join_group', 'cte_window_set') GROUP BY axis_structure
        UNION ALL SELECT 'axis_time', axis_time, count(*) FROM fx_train
        WHERE axis_time NOT IN ('none', 'window_abs', 'window_rel', 'period_compare') GROUP BY axis_time
        UNION ALL SELECT 'axis_terminology', axis_terminology, count(*) FROM fx_train
        WHERE axis_terminology NOT IN ('literal', 'house_term') GROUP BY axis_terminology""", "fx_train")),
    "prohibited_inputs": (prohibited_inputs, with_views("""
        SELECT example_id, source AS source_file FROM fx_train WHERE source IN ('src3', 'src7', 'src11')""",
        "fx_train")),
    "disallowed_contexts": (disallowed_contexts, with_views("""
        SELECT example_id, lang || '.md' AS context_file FROM fx_train
        WHERE lang IS NULL OR lang NOT IN ('en', 'de')""", "fx_train")),
    "sql_lint": (sql_lint, """
        SELECT CAST(doc_id AS VARCHAR) AS example_id, rule FROM documents, (VALUES
            (1, 'table_prefix'), (2, 'table_prefix'), (3, 'dynamic_time'), (4, 'dynamic_time'),
            (5, 'markdown_fence'), (5, 'query_start'), (6, 'comment'), (7, 'single_query'),
            (8, 'query_start'), (16, 'comment')) expected(form, rule)
        WHERE doc_id % 18 = form"""),
    "gate_funnel": (gate_funnel, with_views("""
        WITH f AS (
            SELECT is_complete AS a, a AND doc_id % 59 <> 0 AS b, b AND doc_id % 5 <> 0 AS c,
                   c AND n_chars > 300 AS d, d AND doc_id % 11 <> 0 AS e,
                   e AND row_number() OVER (PARTITION BY norm_question ORDER BY line_number) = 1 AS g
            FROM fx_train),
        t AS (SELECT count(*) AS n, count(*) FILTER (a) AS a, count(*) FILTER (b) AS b, count(*) FILTER (c) AS c,
                     count(*) FILTER (d) AS d, count(*) FILTER (e) AS e, count(*) FILTER (g) AS g FROM f)
        SELECT 1 AS step, 'json_schema' AS gate, a AS survivors, n - a AS dropped FROM t
        UNION ALL SELECT 2, 'static_sql', b, a - b FROM t
        UNION ALL SELECT 3, 'execution', c, b - c FROM t
        UNION ALL SELECT 4, 'nonempty_result', d, c - d FROM t
        UNION ALL SELECT 5, 'semantic_review', e, d - e FROM t
        UNION ALL SELECT 6, 'cross_dataset_dedup', g, e - g FROM t""", "fx_train")),
    "dataset_version_diff": (dataset_version_diff, with_views("""
        WITH both_versions AS (
            SELECT 0 AS v, axis_terminology, axis_structure, axis_time, difficulty FROM fx_train
            UNION ALL
            SELECT 1, axis_terminology, CASE WHEN doc_id % 50 = 1 THEN 'flat' ELSE axis_structure END,
                   axis_time, difficulty FROM fx_train WHERE doc_id % 9 <> 0
            UNION ALL
            SELECT 1, axis_terminology, axis_structure, axis_time, difficulty FROM fx_evaluation
            WHERE doc_id % 3 = 0),
        long AS (UNPIVOT both_versions ON axis_terminology, axis_structure, axis_time, difficulty
                 INTO NAME axis VALUE value),
        counted AS (SELECT axis, value, count(*) FILTER (v = 0) AS base_rows, count(*) FILTER (v = 1) AS new_rows
                    FROM long GROUP BY axis, value)
        SELECT axis, value, base_rows, new_rows, new_rows - base_rows AS change FROM counted""",
        "fx_train", "fx_evaluation")),
    "dataset_change_sets": (dataset_change_sets, with_views(f"{_CHANGES} SELECT example_id, change FROM changes", *_CHANGED)),
    "dataset_manifest_row": (dataset_manifest_row, with_views(f"""
        {_CHANGES},
        cells AS (UNPIVOT (SELECT axis_terminology, axis_structure, axis_time, difficulty FROM new)
                  ON axis_terminology, axis_structure, axis_time, difficulty INTO NAME axis VALUE value),
        counted AS (SELECT axis, value, count(*) AS n FROM cells GROUP BY axis, value),
        named AS (SELECT axis, string_agg(value || '=' || n, ',' ORDER BY value) AS text FROM counted GROUP BY axis)
        SELECT 'v4.1' AS version, (SELECT count(*) FROM new) AS selected_candidates,
               {", ".join(f"(SELECT text FROM named WHERE axis = '{a}') AS {a.removeprefix('axis_')}" for a in AXES)},
               {", ".join(f"(SELECT sha256(coalesce(string_agg(example_id, ',' ORDER BY example_id), '')) FROM changes WHERE change = '{c}') AS {name}"
                          for c, name in (("fixed", "fixed_ids"), ("added", "added_ids"), ("removed", "removed_repetition_ids")))}""",
        *_CHANGED)),
    "ablation_subsets": (ablation_subsets, with_views("""
        WITH ranked AS (
            SELECT example_id, difficulty, row_number() OVER (
                PARTITION BY difficulty ORDER BY sha256('7' || example_id), example_id) AS r
            FROM fx_train WHERE difficulty IN ('easy', 'medium', 'hard')),
        quota(difficulty, size, n) AS (VALUES
            ('easy', 100, 34), ('medium', 100, 33), ('hard', 100, 33),
            ('easy', 250, 84), ('medium', 250, 83), ('hard', 250, 83),
            ('easy', 500, 167), ('medium', 500, 167), ('hard', 500, 166),
            ('easy', 1000, 334), ('medium', 1000, 333), ('hard', 1000, 333))
        SELECT example_id, difficulty, min(size) AS smallest_subset
        FROM ranked JOIN quota USING (difficulty) WHERE r <= n GROUP BY example_id, difficulty""", "fx_train")),
    "dataset_manifest": (dataset_manifest, with_views("""
        WITH long AS (
            UNPIVOT (SELECT axis_terminology, axis_structure, axis_time, difficulty FROM fx_train)
            ON axis_terminology, axis_structure, axis_time, difficulty INTO NAME axis VALUE value)
        SELECT axis, value, count(*) AS "rows" FROM long GROUP BY axis, value""", "fx_train")),
    "step_plan": (step_plan, with_views("""
        WITH n AS (SELECT count(*) AS records FROM fx_train),
        p AS (SELECT records, CAST(ceil(ceil(records / 8) * 3.0) AS BIGINT) AS planned_steps FROM n)
        SELECT records, planned_steps,
               CAST(CASE WHEN planned_steps < 20 THEN 0
                    ELSE greatest(1, round_even(planned_steps * CAST(0.03 AS DOUBLE), 0)) END AS BIGINT)
                    AS warmup_steps FROM p""", "fx_train")),
    "dataset_fingerprint": (dataset_fingerprint, """
        WITH h AS (SELECT sha256(concat_ws('|', doc_id, lang, source, text)) AS x FROM documents),
        s AS (SELECT count(*) AS records, """ + ", ".join(
        f"sum(CAST(CAST('0x' || substr(x, {8 * i + 1}, 8) AS BIGINT) AS HUGEINT)) AS w{i}" for i in range(8)) + """
              FROM h)
        SELECT records, sha256(concat_ws(':', records, """ + ", ".join(f"w{i}" for i in range(8)) + """)) AS fingerprint
        FROM s"""),
    "chat_records": (chat_records, with_views(f"""
        SELECT example_id, seed_id, schema, difficulty, 'user' AS first_role,
               replace(replace({_sql(TEMPLATE)}, '{{{{schema_context}}}}', {_sql(CONTEXT)}),
                       '{{{{question_de}}}}', question_de) AS prompt,
               'assistant' AS second_role, gold_sql AS answer
        FROM fx_train""", "fx_train")),
    "typed_messages": (typed_messages, with_views(f"""
        SELECT example_id, 'user' AS role, 'text' AS type,
               sha256(replace(replace({_sql(TEMPLATE)}, '{{{{schema_context}}}}', {_sql(CONTEXT)}),
                       '{{{{question_de}}}}', question_de)) AS text_sha256 FROM fx_train
        UNION ALL SELECT example_id, 'assistant', 'text', sha256(gold_sql) FROM fx_train""", "fx_train")),
    "generator_prompts": (generator_prompts, with_views(f"""
        SELECT slot_id,
               e'Write a new example.\\nNovelty: vary ' || p_name || e'\\nFamily: ' || family || ';' || split
               || ';' || difficulty || ';' || axis_structure || e'\\nQuestion: Umsatz von ' || p_type
               || e'?\\nSQL: SELECT 1 -- ' || p_brand || e'\\nSchema: ' || {_sql(CONTEXT)} || e'\\nGlossary: '
               || {_sql(GLOSSARY)} || e'\\n' AS prompt
        FROM fx_plan""", "fx_plan")),
    "chat_contract_violations": (chat_contract_violations, """
        WITH c AS (SELECT conv_id, count(*) AS turns, list(role ORDER BY turn) AS roles,
                          count(*) FILTER (trim(text) = '') AS blank FROM conversations GROUP BY conv_id)
        SELECT conv_id, turns, CASE WHEN roles <> ['user', 'assistant'] THEN 'roles' ELSE 'empty content' END AS problem
        FROM c WHERE roles <> ['user', 'assistant'] OR blank > 0"""),
    "token_length_report": (token_length_report, with_views(f"""
        WITH {_RENDERED}
        SELECT count(*) AS records, min(n) AS min, {_RANK(0.5)} AS p50, {_RANK(0.9)} AS p90, {_RANK(0.95)} AS p95,
               {_RANK(0.99)} AS p99, max(n) AS max, count(*) FILTER (n > {TOKEN_LIMIT}) AS over_limit,
               count(*) FILTER (n > {TOKEN_LIMIT}) AS response_truncated,
               count(*) FILTER (p >= {TOKEN_LIMIT}) AS no_response_tokens
        FROM rendered""", "fx_examples")),
    "response_prefix": (response_prefix, with_views("""
        WITH r AS (SELECT example_id, e'<|im_start|>user\n' || text || e'<|im_end|>\n<|im_start|>assistant\n' AS p,
                          gold_sql || e'<|im_end|>\n' AS q FROM fx_examples)
        SELECT example_id, length(p) + length(q) AS chars, sha256(p) AS prefix_sha256 FROM r""", "fx_examples")),
    "supervised_tokens": (supervised_tokens, f"""
        WITH c AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts
                   FROM conversations GROUP BY conv_id HAVING roles = ['user', 'assistant']),
        r AS (SELECT CAST(conv_id AS VARCHAR) AS example_id,
                     '<|im_start|>user' || chr(10) || texts[1] || '<|im_end|>' || chr(10) || '<|im_start|>assistant' AS p,
                     p || chr(10) || texts[2] || '<|im_end|>' AS t FROM c)
        SELECT example_id, {_TOKENS('t')} AS tokens, {_TOKENS('p')} AS prefix_tokens,
               {_TOKENS('t')} - {_TOKENS('p')} AS supervised_tokens FROM r"""),
    "strip_sql_fences": (clean_outputs, """
        WITH o AS (SELECT doc_id, trim(text, e' \\t\\n\\r') AS body, 'SELECT ' || n_chars || ' FROM ecom_v1.orders' AS q
                   FROM documents)
        SELECT CAST(doc_id AS VARCHAR) AS example_id,
               CASE doc_id % 8 WHEN 4 THEN '``` ' || q WHEN 5 THEN body WHEN 6 THEN body ELSE q END AS sql,
               CASE doc_id % 8 WHEN 2 THEN '<think>' || t.text || e'</think>\\n```sql\\n' || q
                    WHEN 3 THEN '<think>a</think>' || t.text || '</think> ' || q
                    WHEN 4 THEN '``` ' || q WHEN 5 THEN body WHEN 6 THEN body ELSE q END AS sql_keep_think
        FROM o JOIN documents t USING (doc_id)"""),
    "normalize_text": (normalize_text, """
        SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS normalized FROM documents"""),
    "last_subsequence": (last_subsequence, """
        WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS t
                   FROM documents)
        SELECT doc_id, len(t) AS tokens,
               CASE WHEN len(t) = 1 THEN 0 ELSE coalesce(list_max(list_filter(range(1, len(t)),
                    lambda i: t[i] = t[1] AND t[i + 1] = t[2])) - 1, -1) END AS last_index
        FROM w"""),
}
