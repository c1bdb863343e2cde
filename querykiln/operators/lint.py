"""String-level SQL conventions: schema prefix, fixed time, no markup, a single query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querykiln.functions.text import strip
from querykiln.schemas import TABLE_PREFIX, WAREHOUSE

# Patterns of the conventions.
# Quoted text, triple quotes first; a backslash takes the next character's meaning. Possessive, so that
# long texts need no stack.
LITERAL = (
    r'(?s)"{3}[^"\\]*+(?:(?:\\.|"(?!""))[^"\\]*+)*+"{3}'
    r"|'{3}[^'\\]*+(?:(?:\\.|'(?!''))[^'\\]*+)*+'{3}"
    r'|"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
)
# FROM that names no table: of a date part, and of IS [NOT] DISTINCT FROM.
EXTRACT_FROM = r"(?i)\bEXTRACT\s*\(\s*\w+(?:\s*\(\s*\w+\s*\))?\s+FROM\b"
DISTINCT_FROM = r"(?i)\bIS\s+(NOT\s+)?DISTINCT\s+FROM\b"
TABLE_LIST = (
    r"(?i)\b(?:FROM|JOIN)\s+([^();]*?)(?=[();]|\z|\b(?:WHERE|GROUP|ORDER|HAVING|LIMIT|QUALIFY|WINDOW|UNION"
    r"|INTERSECT|EXCEPT|ON|USING|JOIN|INNER|LEFT|RIGHT|FULL|CROSS)\b)"
)
TABLE_NAME = r"^\s*([\w.`-]+)"
CTE_NAME = r"(?i)(?:\bWITH(?:\s+RECURSIVE)?|,)\s*([A-Za-z_]\w*)\s+AS\s*\("
DYNAMIC_TIME = r"(?i)\bCURRENT_(?:DATE|TIMESTAMP|DATETIME|TIME)\b"
COMMENT = r"--|/\*|#"
QUERY_START = r"(?i)^(?:SELECT|WITH)\b"
TRAILING_SEMICOLON = r";\s*\z"


def bare_sql(sql: Column) -> Column:
    """SQL without string contents, so that their text cannot trigger a rule."""
    return F.regexp_replace(sql, LITERAL, "''")


def table_refs(sql: Column) -> Column:
    """Distinct lower-case tables after FROM or JOIN, without names the query itself defines."""
    text = F.regexp_replace(F.regexp_replace(bare_sql(sql), EXTRACT_FROM, "EXTRACT("), DISTINCT_FROM, "=")
    plain = lambda names: F.transform(names, lambda t: F.replace(F.lower(t), F.lit("`"), F.lit("")))
    lists = F.regexp_extract_all(text, F.lit(TABLE_LIST), F.lit(1))
    items = F.flatten(F.transform(lists, lambda part: F.split(part, ",")))
    refs = plain(F.transform(items, lambda item: F.regexp_extract(item, TABLE_NAME, 1)))
    ctes = plain(F.regexp_extract_all(text, F.lit(CTE_NAME), F.lit(1)))
    return F.filter(F.array_except(refs, ctes), lambda t: ~t.isin("", "unnest"))


def unknown_tables(sql: Column, tables: list[str] = list(WAREHOUSE),
                   prefix: str = TABLE_PREFIX) -> Column:
    known = F.array(*[F.lit(f"{prefix}.{t}") for t in tables])
    return F.array_except(table_refs(sql), known)


def broken_rules(sql: Column, bare: Column) -> dict[str, Column]:
    """Each convention with the condition that breaks it."""
    body = F.regexp_replace(bare, TRAILING_SEMICOLON, "")
    return {
        "table_prefix": F.size(unknown_tables(sql)) > 0,
        "dynamic_time": bare.rlike(DYNAMIC_TIME),
        "markdown_fence": F.contains(sql, F.lit("```")),
        "comment": bare.rlike(COMMENT),
        "single_query": F.contains(body, F.lit(";")),
        "query_start": ~strip(bare).rlike(QUERY_START),
    }


def lint(rows: DataFrame, sql_col: str = "gold_sql", id_col: str = "example_id") -> DataFrame:
    """One `(id, rule)` row per broken convention."""
    sql = F.col(sql_col)
    rules = broken_rules(sql, F.col("bare"))
    broken = F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in rules.items()]))
    return (
        rows.select(id_col, sql_col, bare_sql(sql).alias("bare"))
        .select(id_col, F.explode(broken).alias("rule"))
    )


def passes_lint(sql: Column) -> Column:
    """Gate form: no convention is broken."""
    good = F.lit(True)
    for bad in broken_rules(sql, bare_sql(sql)).values():
        good = good & ~bad
    return good
