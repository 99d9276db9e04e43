"""Expressions over one trace line (no grouping, no joins)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, col, empty_to_null, extract, strip


def split_line(lines: DataFrame, text: str = "line") -> DataFrame:
    """Add ``session_id, ts_text, level, message``; keep only lines with a session.

    The session is the last word directly in front of the first ``|`` and needs at
    least one word before it.  Blank lines and lines without a session go away, and so
    do bytes that are not valid UTF-8.
    """
    raw = F.col(text)
    repaired = F.replace(F.make_valid_utf8(raw), F.lit("\ufffd"), F.lit(""))
    line = strip(F.when(F.is_valid_utf8(raw), raw).otherwise(repaired))
    prefix = F.substring_index(F.col("__line"), "|", 1)
    words = F.split(prefix, r"(?U)\s+")
    parts = F.split(F.col("__line"), r"\|", 3)
    first, second, last = F.get("__words", F.lit(0)), F.get("__words", F.lit(1)), F.element_at("__words", -1)
    dated = first.contains("-") | first.contains("/")
    timed = first.contains(":") | second.contains(":")
    kept = [c for c in lines.columns if c != text]
    return (
        lines.filter(F.contains(raw, F.lit("|")) & F.rlike(raw, F.lit(fv.HAS_SESSION)))
        .select(*kept, line.alias("__line"))
        .select(*kept, "__line", words.alias("__words"), parts.alias("__parts"))
        .select(
            *kept,
            F.col("__line").alias(text),
            last.alias("session_id"),
            F.when(timed & dated, F.concat_ws(" ", first, second)).when(timed, first).alias("ts_text"),
            strip(F.get("__parts", F.lit(1))).alias("level"),
            strip(F.element_at("__parts", -1)).alias("message"),
        )
    )


def start_mti(line: Column | str) -> Column:
    """Message type of a line that opens a transaction (leading dash), else null."""
    return extract(line, fv.MTI_START)


def any_mti(line: Column | str) -> Column:
    return extract(line, fv.MTI)


def is_response_start(line: Column | str) -> Column:
    return F.rlike(col(line), F.lit(fv.MTI_1110))


def is_heartbeat_mti(mti: Column | str) -> Column:
    """Network-management message: digits whose second digit, padded to four, is 8."""
    m = col(mti)
    padded = F.when(F.length(m) < 4, F.lpad(m, 4, "0")).otherwise(m)
    return F.coalesce(F.rlike(m, F.lit(r"^\d+$")) & (F.substring(padded, 2, 1) == "8"), F.lit(False))


def is_heartbeat_field(line: Column | str) -> Column:
    return F.contains(col(line), F.lit(fv.HEARTBEAT_FIELD)) & F.contains(col(line), F.lit(fv.HEARTBEAT_VALUE))


def looks_like_trace(line: Column | str) -> Column:
    return F.rlike(col(line), F.lit(fv.TRACE_HINT))


def identifiers(line: Column | str) -> dict[str, Column]:
    return {
        "transaction_id": extract(line, fv.TRANSACTION_ID),
        "stan": extract(line, fv.STAN),
        "pan": F.coalesce(extract(line, fv.PAN), extract(line, fv.CARD_NUMBER)),
        "rrn": extract(line, fv.DUMP_037),
        "response_code": extract(line, fv.DUMP_039),
    }


def dump_011(line: Column | str) -> Column:
    return extract(line, fv.DUMP_011)


def field_number(line: Column | str) -> Column:
    return extract(line, fv.FIELD, 1)


def field_value(line: Column | str) -> Column:
    """Value between brackets; may be empty, so read it only where a field number was found."""
    return F.regexp_extract(col(line), fv.FIELD, 3)


def field_declared_length(line: Column | str) -> Column:
    return extract(line, fv.FIELD, 2)


def field_prefix(line: Column | str) -> Column:
    return F.coalesce(F.upper(extract(line, fv.FIELD_PREFIX)), F.lit("FLD"))


def hsm_command(line: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(line), fv.TO_HSM, 1))


def hsm_reply(line: Column | str) -> Column:
    return blank_to_null(F.regexp_extract(col(line), fv.FROM_HSM, 1))


def hsm_result(line: Column | str) -> Column:
    return extract(line, fv.HSM_RESULT)


def hsm_alert(result: Column | str) -> Column:
    """Alert text when a security-module result is not one of the accepted codes."""
    r = col(result)
    return F.when(r.isNotNull() & ~r.isin(*fv.HSM_OK), F.format_string(fv.MSG_HSM_ALERT, r))


def approval(code: Column | str) -> Column:
    """Label of a response code; null stays unknown."""
    c = empty_to_null(code)
    return (
        F.when(c.isNull(), fv.LABEL_UNKNOWN)
        .when(c.isin(*fv.APPROVED_CODES), fv.LABEL_APPROVED)
        .otherwise(F.format_string(fv.LABEL_DECLINED, c))
    )


def milestones(line: Column | str, message: Column | str) -> list[Column]:
    ends = F.startswith(col(message), F.lit("End"))
    steps = (
        ("IsoToTlv", fv.MSG_ISO_TO_TLV),
        ("ValidateTlvData", fv.MSG_VALIDATE_TLV),
        ("LoadIssuerInfo", fv.MSG_LOAD_ISSUER),
    )
    return [F.when(ends & F.contains(col(line), F.lit(word)), text) for word, text in steps]


def event_prefix(mode: str, line_no: Column | str = "line_no", ts: Column | str = "ts_text", level: Column | str = "level") -> Column:
    """``(Ligne n) [time | level] `` in full mode, empty in compact mode."""
    if mode != "full":
        return F.lit("")
    stamp = F.when(col(ts).isNotNull(), F.format_string("[%s | %s] ", col(ts), col(level))).otherwise(
        F.format_string("[%s] ", col(level))
    )
    return F.concat(F.format_string("(Ligne %d) ", col(line_no)), stamp)


def mask_pan(pan: Column | str) -> Column:
    """All but the last four characters replaced by ``*``."""
    p = col(pan)
    hidden = F.greatest(F.length(p) - 4, F.lit(0))
    return F.concat(F.repeat(F.lit("*"), hidden), F.right(p, F.lit(4)))
