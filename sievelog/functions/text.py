"""Tokens of a line: maximal runs of alphanumeric characters and `_`, lower-cased one character at a time.

Splitting comes before lower-casing, as some letters grow a combining mark when lowered. Characters are judged by the
JVM's Unicode tables; the query parser asks the same tables (see plans.query), so queries and lines always agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A character of a token, and the separator between tokens. The ASCII ranges say nothing new, but are tested first.
TOKEN_CLASS = r"[a-zA-Z0-9_\p{IsAlphabetic}\p{N}]"
SEPARATOR = r"[^a-zA-Z0-9_\p{IsAlphabetic}\p{N}]+"


def _text(line: Column | str) -> Column:
    return F.coalesce(F.col(line) if isinstance(line, str) else line, F.lit(""))


def normalize_token(token: Column) -> Column:
    """Lower case without regard to the neighbours: a capital sigma at a word's end becomes a plain small one."""
    return F.lower(F.translate(token, "Σ", "σ"))


def is_token_char(char: Column) -> Column:
    return char.rlike(f"^{TOKEN_CLASS}$")


def _spaced(line: Column | str) -> Column:
    """The tokens, one space between."""
    return F.trim(F.regexp_replace(_text(line), SEPARATOR, " "))


def folded(line: Column | str) -> Column:
    """The normalized tokens with one space before, between and behind, so that a line holds a term if this contains it
    between spaces."""
    return F.concat(F.lit(" "), normalize_token(_spaced(line)), F.lit(" "))


def tokenize(line: Column | str) -> Column:
    """All tokens in order, case and repeats kept. Null has none."""
    return F.array_remove(F.split(_spaced(line), " "), "")


def token_list(line: Column | str) -> Column:
    """All normalized tokens in order, with repeats."""
    return F.array_remove(F.split(normalize_token(_spaced(line)), " "), "")


def tokens(line: Column | str) -> Column:
    """The distinct normalized tokens: never null, and without nulls, so that NOT keeps its meaning."""
    return F.array_distinct(token_list(line))


def first_token(line: Column | str) -> Column:
    """The first normalized token, or the empty string."""
    return F.coalesce(F.try_element_at(token_list(line), F.lit(1)), F.lit(""))
