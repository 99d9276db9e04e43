"""Function results on one trace line: documented failures, successes, undocumented failures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import col, empty_to_null, quote_regex, strip


def mentions(line: Column | str, names: Column) -> Column:
    """Names (an array) that occur in the line, in the order given."""
    return F.filter(names, lambda n: F.contains(col(line), n))


def strict_failure(line: Column | str, name: Column) -> Column:
    """Failure token right after the whole function name, else null."""
    pattern = F.concat(F.lit(r"(?iuU)\b"), quote_regex(name), F.lit(rf"\b{fv.CALL_GAP}({fv.FAIL_TOKEN})"))
    return empty_to_null(F.call_function("regexp_extract", col(line), pattern, F.lit(1)))


def near_failure(line: Column | str, name: Column) -> Column:
    """Failure token, else a signed code, close behind the function name, else null."""
    text = col(line)
    window = F.substring(text, F.instr(text, name), F.length(name) + fv.NEAR_WINDOW)
    token = empty_to_null(F.regexp_extract(window, f"(?iuU){fv.FAIL_TOKEN}", 0))
    code = empty_to_null(F.regexp_extract(window, fv.SIGNED_CODE, 1))
    return F.coalesce(token, F.concat(F.lit("-"), code))


def has_success_marker(line: Column | str) -> Column:
    found = F.lit(False)
    for marker in fv.SUCCESS_MARKERS:
        found = found | F.contains(col(line), F.lit(marker))
    return found


def success_result(line: Column | str, name: Column) -> Column:
    """Text between the parentheses behind the name, else ``OK``."""
    pattern = F.concat(quote_regex(name), F.lit(r"(?U)\s*\(\s*([^)]*)\)"))
    raw = F.call_function("regexp_extract", col(line), pattern, F.lit(1))
    return F.when(raw != "", strip(raw)).otherwise("OK")


def documented_results(line: Column | str, names: Column) -> Column:
    """Array of ``(name, code, result)`` for the documented functions on the line.

    ``code`` is the failure, ``result`` the success text; a function with neither is left out.
    """
    text = col(line)

    def result(name: Column) -> Column:
        code = F.coalesce(strict_failure(text, name), near_failure(text, name))
        return F.struct(
            name.alias("name"),
            code.alias("code"),
            F.when(code.isNull() & has_success_marker(text), success_result(text, name)).alias("result"),
        )

    seen = F.transform(mentions(text, names), result)
    return F.filter(seen, lambda r: r["code"].isNotNull() | r["result"].isNotNull())


def generic_failures(line: Column | str) -> Column:
    """Array of ``(name, code)`` for every ``name … failure token`` on the line, reserved words left out."""
    text = col(line)
    names = F.regexp_extract_all(text, F.lit(fv.GENERIC_FAILURE), F.lit(1))
    codes = F.regexp_extract_all(text, F.lit(fv.GENERIC_FAILURE), F.lit(2))
    pairs = F.zip_with(names, codes, lambda n, c: F.struct(n.alias("name"), c.alias("code")))
    return F.filter(pairs, lambda p: ~F.upper(p["name"]).isin(*fv.NOT_FUNCTIONS))


def failure_text(name: Column, code: Column, documented: Column, spec_label: str) -> Column:
    return F.when(documented, F.format_string(fv.MSG_FAILED, name, code)).otherwise(
        F.format_string(fv.MSG_FAILED_UNDOCUMENTED, name, code, F.lit(spec_label))
    )
