"""Small text helpers with the whitespace and line rules the trace grammar expects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as blanks, and the line terminators.
BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    "           "
    "    　"
)
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove every kind of blank at both ends."""
    return F.btrim(col(c), F.lit(BLANKS))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def empty_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def extract(c: Column | str, pattern: str, group: int = 1) -> Column:
    """First match of ``group``, or null (never the empty string)."""
    return F.nullif(F.regexp_extract(col(c), pattern, group), F.lit(""))


def lines_of(c: Column | str) -> Column:
    """Lines of a text; a terminator at the very end opens no further line."""
    parts = F.split(col(c), LINE_BREAK)
    last_is_empty = F.element_at(parts, -1) == ""
    return F.when(last_is_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def words_of(c: Column | str) -> Column:
    """Blank-separated words, none of them empty."""
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def join_clauses(sep: str, *clauses: Column) -> Column:
    """Join the clauses that apply (non-null) with ``sep``."""
    return F.concat_ws(sep, *clauses)


def quote_regex(c: Column | str) -> Column:
    """Escape a column so that it matches literally inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(col(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def occurrences(text: Column | str, needle: Column | str) -> Column:
    """Non-overlapping literal occurrences of ``needle`` in ``text``."""
    t, n = col(text), col(needle)
    gone = F.length(F.replace(t, n, F.lit("")))
    return ((F.length(t) - gone) / F.length(n)).cast("bigint")
