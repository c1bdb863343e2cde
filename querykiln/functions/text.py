"""Text expressions. All are built-in Spark functions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() treats as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
_WORD = r"(?U)[^\s\x1c-\x1f]+"
FENCE = "```"
THINK_END = "</think>"


def strip(c: Column) -> Column:
    """Strip Unicode whitespace at both ends, in linear time (no regex backtracking)."""
    return F.trim(c, F.lit(WHITESPACE))


def normalize(c: Column) -> Column:
    """Lower-case, one space for any whitespace run, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), _SPACE_RUN, " "))


def word_count(c: Column) -> Column:
    """Default token count: whitespace-separated words."""
    return F.regexp_count(c, F.lit(_WORD)).cast("bigint")


def strip_sql_fences(c: Column, strip_think: bool = True) -> Column:
    """SQL text of a model answer without reasoning block and markdown fences."""
    text = strip(c)
    if strip_think:
        text = F.when(
            F.contains(c, F.lit(THINK_END)), strip(F.substring_index(c, THINK_END, -1))
        ).otherwise(text)
    newline = F.locate("\n", text)
    body = F.when(
        F.startswith(text, F.lit(FENCE)) & (newline > 0), F.substr(text, newline + 1)
    ).otherwise(text)
    body = F.when(
        F.endswith(body, F.lit(FENCE)), F.left(body, F.char_length(body) - len(FENCE))
    ).otherwise(body)
    return strip(body)


def drop_prefix(c: Column, prefix: str = "<bos>") -> Column:
    """Remove one leading marker."""
    return F.when(
        F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1))
    ).otherwise(c)


def through_marker(c: Column, marker: str) -> Column:
    """Text up to and including the first marker; NULL where the marker is missing."""
    at = F.locate(marker, c)
    return F.when(at > 0, F.left(c, at + (len(marker) - 1)))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace `{{name}}` placeholders in the order given."""
    return reduce(
        lambda text, item: F.replace(text, F.lit("{{%s}}" % item[0]), item[1]),
        values.items(), template,
    )


def last_subsequence_index(tokens: Column, marker: Column, separator: str = " ") -> Column:
    """0-based start of the last occurrence of `marker` in a token array, -1 if there is none.

    Both arrays are compared in delimited form, which is one linear search per row; tokens (ids
    or words) must not contain the separator.
    """
    sep = F.lit(separator)
    wrap = lambda a: F.concat(sep, F.array_join(a.cast("array<string>"), separator), sep)
    text, wanted = wrap(tokens), wrap(marker)
    # Every token of the tail is followed by one separator.
    tail = F.call_function("substring_index", text, wanted, F.lit(-1))
    after = F.char_length(tail) - F.char_length(F.replace(tail, sep, F.lit("")))
    found = (F.size(tokens) >= F.size(marker)) & F.contains(text, wanted)
    return F.when(
        F.size(marker) == 0, F.raise_error(F.lit("marker tokens must not be empty")).cast("int")
    ).when(found, F.size(tokens) - F.size(marker) - after).otherwise(F.lit(-1))


def digest(c: Column) -> Column:
    """32-byte key standing in for a long text, so that shuffles never carry the text."""
    return F.unhex(F.sha2(c, 256))
