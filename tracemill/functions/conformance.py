"""Expressions that compare a field value with its expected type and length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, col, extract, join_clauses, strip


def expected_length(attributes: Column | str) -> Column:
    return extract(attributes, fv.EXPECTED_TYPE, 1).try_cast("int")


def expected_type(attributes: Column | str) -> Column:
    return extract(attributes, fv.EXPECTED_TYPE, 2)


def type_text(text: Column | str) -> Column:
    """``<length> <type>`` found in a running text, else null."""
    size, kind = extract(text, fv.EXPECTED_TYPE, 1), extract(text, fv.EXPECTED_TYPE, 2)
    return F.when(kind.isNotNull(), F.concat_ws(" ", size, kind))


def is_exempt(key: Column | str, kind: Column | str) -> Column:
    return (col(key) == fv.NOT_STRICTLY_NUMERIC) & (col(kind) == "N")


def type_label(kind: Column | str) -> Column:
    k = col(kind)
    out = None
    for row in fv.TYPE_LABELS.strip().splitlines():
        code, label = row.split("|")
        out = F.when(k == code, label) if out is None else out.when(k == code, label)
    return out.otherwise(k)


def is_missing(value: Column | str) -> Column:
    return blank_to_null(value).isNull() | (strip(value) == fv.EMPTY_VALUE)


def observed(value: Column | str) -> Column:
    return F.when(is_missing(value), fv.EMPTY_VALUE).otherwise(col(value))


def unmasked(value: Column | str) -> Column:
    return F.translate(col(value), "*", "")


def matches_type(value: Column | str, kind: Column | str) -> Column:
    """A fully masked value matches anything; only N and A are strict."""
    clean, k = unmasked(value), col(kind)
    return (
        F.when(clean == "", True)
        .when(k == "N", F.rlike(clean, F.lit(r"^\p{Nd}+$")))
        .when(k == "A", F.rlike(clean, F.lit(r"^\p{L}+$")))
        .otherwise(True)
    )


def violates(value: Column | str, kind: Column | str, max_length: Column | str) -> Column:
    """Whether :func:`reasons` has anything to say (no text is built)."""
    too_long = F.coalesce((col(max_length) > 0) & (F.length(unmasked(value)) > col(max_length)), F.lit(False))
    return is_missing(value) | ~matches_type(value, kind) | too_long


def reasons(value: Column | str, kind: Column | str, max_length: Column | str) -> Column:
    """Why a value does not conform, or null."""
    k, limit = col(kind), col(max_length)
    size = F.length(unmasked(value))
    wrong = ~matches_type(value, kind)
    found = join_clauses(
        " et ",
        F.when(wrong & (k == "N"), fv.REASON_NOT_NUMERIC).when(wrong & (k == "A"), fv.REASON_NOT_ALPHABETIC),
        F.when((limit > 0) & (size > limit), F.format_string(fv.REASON_TOO_LONG, size, limit)),
    )
    return F.when(is_missing(value), fv.REASON_MISSING).otherwise(F.nullif(found, F.lit("")))


def message() -> Column:
    return F.format_string(
        fv.MSG_VIOLATION,
        F.col("field_name"),
        F.col("field_number"),
        F.col("attributes"),
        F.col("source"),
        F.col("observed_value"),
        F.col("non_conformity_type"),
    )
