"""Chat records, prompts and their contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions.text import fill_template, strip

ROLES = ["user", "assistant"]


def render_prompt(template: Column, context: Column, question: Column) -> Column:
    """Context first, question second: placeholders inside the context are filled as well."""
    return fill_template(template, {"schema_context": context, "question_de": question})


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


# What a chat record is made of; a candidate may lack everything else.
CHAT_FIELDS = ["example_id", "seed_id", "schema", "difficulty", "question_de", "gold_sql"]


def chat_records(rows: DataFrame, template: str, context: str) -> DataFrame:
    """User prompt and gold SQL as a two-message conversation.

    Template and context are literals, so their substitution is folded once per plan.
    """
    prompt = render_prompt(F.lit(template), F.lit(context), F.col("question_de"))
    return rows.select(
        "example_id", "seed_id", "schema", "difficulty",
        F.array(_message("user", prompt), _message("assistant", F.col("gold_sql"))).alias("messages"),
    )


def typed_messages(records: DataFrame) -> DataFrame:
    """Each content string as a list of one text part."""
    part = lambda m: F.array(F.struct(F.lit("text").alias("type"), m["content"].alias("text")))
    return records.withColumn(
        "messages",
        F.transform("messages", lambda m: F.struct(m["role"].alias("role"), part(m).alias("content"))),
    )


def message_problem(messages: Column) -> Column:
    """First broken part of the chat contract, NULL for a good record."""
    roles = F.transform(messages, lambda m: m["role"])
    filled = F.forall(messages, lambda m: F.coalesce(strip(m["content"]) != "", F.lit(False)))
    return (
        F.when(messages.isNull(), "missing messages")
        .when(~F.coalesce(roles == F.array(*[F.lit(r) for r in ROLES]), F.lit(False)), "roles")
        .when(~filled, "empty content")
    )


def chat_contract_violations(records: DataFrame) -> DataFrame:
    """Records without id or messages, with other roles than user/assistant, or blank contents."""
    problem = F.when(F.col("example_id").isNull(), F.lit("missing example_id")).otherwise(
        message_problem(F.col("messages")))
    return records.select("example_id", problem.alias("problem")).filter("problem is not null")


def turn_contract(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Chat contract over one row per turn, by aggregation alone.

    A conversation is never collected: counts and the first and last role are enough, so one
    with very many turns costs no more memory than a short one.
    """
    # Small numbers only, so the aggregation hashes instead of sorting the texts.
    facts = turns.select(
        id_col, F.col(turn_col).alias("_turn"),
        F.when(F.col(role_col) == ROLES[0], 0).when(F.col(role_col) == ROLES[1], 1).otherwise(2).alias("_role"),
        F.coalesce(strip(F.col(text_col)) == "", F.lit(True)).alias("_blank"))
    stats = facts.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("turns"), F.min_by("_role", "_turn").alias("first_role"),
        F.max_by("_role", "_turn").alias("last_role"), F.count_if("_blank").alias("blank_turns"))
    roles_ok = (F.col("turns") == 2) & (F.col("first_role") == 0) & (F.col("last_role") == 1)
    return stats.select(
        id_col, "turns", "blank_turns",
        F.when(~F.coalesce(roles_ok, F.lit(False)), "roles").when(F.col("blank_turns") > 0, "empty content")
        .alias("problem"))


def records_from_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                       role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Chat records of the conversations that are one user turn and one assistant turn."""
    pair = lambda pick: pick(F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("content")),
                             F.col(turn_col))
    good = turn_contract(turns, id_col, turn_col, role_col, text_col).filter("problem is null")
    return (
        turns.join(good.select(id_col), id_col, "left_semi")
        .groupBy(id_col)
        .agg(F.array(pair(F.min_by), pair(F.max_by)).alias("messages"))
        .select(F.col(id_col).cast("string").alias("example_id"), "messages")
    )


def generator_prompts(plan: DataFrame, template: str, schema: str, glossary: str,
                      prompt_col: str = "prompt") -> DataFrame:
    """Prompt of each plan slot: novelty directive, family data, source pair, schema, glossary."""
    prompt = fill_template(F.lit(template), {
        "novelty_directive": F.col("novelty_directive"),
        "family_metadata": F.col("family_metadata"),
        "source_question_de": F.col("source_question_de"),
        "source_gold_sql": F.col("source_gold_sql"),
        "schema": F.lit(schema),
        "glossary": F.lit(glossary),
    })
    return plan.withColumn(prompt_col, prompt)


def render_chat(messages: Column, start: str = "<|im_start|>", end: str = "<|im_end|>") -> Column:
    """Plain text of a conversation with role markers."""
    turns = F.transform(
        messages,
        lambda m: F.concat(F.lit(start), m["role"], F.lit("\n"), m["content"], F.lit(end + "\n")),
    )
    return F.array_join(turns, "")
