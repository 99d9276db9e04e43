"""Expressions of the report: match keys, chronology steps, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, col, empty_to_null


def match_key(rrn: Column | str = "rrn", stan: Column | str = "stan", transaction_id: Column | str = "transaction_id") -> Column:
    """First known identifier with its kind, or null."""
    named = (("rrn:", rrn), ("stan:", stan), ("transaction_id:", transaction_id))
    return F.coalesce(*[F.concat(F.lit(kind), blank_to_null(c)) for kind, c in named])


def is_error_step(step: Column | str) -> Column:
    return F.rlike(col(step), F.lit(fv.STEP_ERROR))


def step_function(step: Column | str) -> Column:
    """Function a chronology step is about, or null."""
    return F.coalesce(*[empty_to_null(F.regexp_extract(col(step), fv.STEP_FUNCTION, i)) for i in (1, 2, 3)])


def failed_in_step(step: Column | str) -> Column:
    return F.when(is_error_step(step), step_function(step))


def step_status(step: Column | str, failed: Column | str) -> Column:
    """error when a failed function is named in the step, success on a success word, else neutral."""
    low = F.lower(col(step))
    named = F.exists(col(failed), lambda f: (f != "") & F.contains(low, F.lower(f)))
    return F.when(named, "error").when(F.rlike(low, F.lit(fv.STEP_SUCCESS)), "success").otherwise("neutral")


def title(rrn: Column | str, stan: Column | str, number: Column | str) -> Column:
    return F.coalesce(
        F.concat(F.lit("RRN : "), empty_to_null(rrn)),
        F.concat(F.lit("STAN : "), empty_to_null(stan)),
        F.concat(F.lit("Transaction #"), col(number).cast("string")),
    )
