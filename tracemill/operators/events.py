"""Chronology of transactions as a long table: one row per event, never one giant string."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import failures as fl
from tracemill.functions import trace_line as tl
from tracemill.operators.containment import contained, literal_array, needle_lists
from tracemill.operators.ordered import ordered_distinct
from tracemill.operators.transactions import TX, in_segments, line_facts, response_event, segments
from tracemill.session import bounded_rows
from tracemill.sources.refdata import lookup

SPEC_LABEL = "la spécification"
AFTER_LINES = 1 << 62
#: Documented names up to this many are tried on every line.
LITERAL_NAMES = 64


def with_documented_names(lines: DataFrame, specs: DataFrame | None) -> DataFrame:
    """Add ``names``: documented functions to try on each line, in specification order.

    A few names are one literal array, tried on every line.  More are searched for all at once, so that each line
    carries only the names it contains.
    """
    if specs is None:
        return lines.withColumn("names", literal_array([]))
    named = specs.filter("function != ''").select("function", "spec_no")
    rows = bounded_rows(named, LITERAL_NAMES)
    if rows is not None:
        ordered = [r["function"] for r in sorted(rows, key=lambda r: (r["spec_no"], r["function"]))]
        return lines.withColumn("names", literal_array(ordered))
    return lines.withColumn("names", contained(F.col("line"), needle_lists(named, "spec_no")))


def _event(kind: str, text: Column, name: Column | None = None, alert: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.when(
        text.isNotNull(),
        F.struct(
            F.lit(kind).alias("kind"),
            text.alias("text"),
            (name if name is not None else null).alias("name"),
            (alert if alert is not None else null).alias("alert"),
        ),
    )


def found_events(named: DataFrame, mode: str = "compact", spec_label: str = SPEC_LABEL) -> DataFrame:
    """Add ``events`` to every line: an array of ``kind, text, name, alert``, without the prefix of the text.

    ``kind`` is one of mti, rrn, response, field, to_hsm, from_hsm, hsm_result, step,
    failed, succeeded, undocumented, line.
    """
    line = F.col("line")
    has = lambda needle: F.contains(line, F.lit(needle))
    bracket = has("[")
    number = F.when(bracket & has("("), tl.field_number(line))
    command = F.when(has(":"), tl.hsm_command(line))
    reply = F.when(has("<--"), tl.hsm_reply(line))
    result = tl.hsm_result(line)
    padded = F.when(F.length("__no") < 3, F.lpad("__no", 3, "0")).otherwise(F.col("__no"))
    field_name = F.coalesce(
        lookup(fv.ISO_FIELDS, padded, 1), lookup(fv.ISO_FIELDS, F.col("__no"), 1), F.concat_ws(" ", tl.field_prefix(line), "__no")
    )
    field_text = F.coalesce(
        lookup(fv.ISO_FIELDS, padded, 2), lookup(fv.ISO_FIELDS, F.col("__no"), 2), F.lit(fv.FIELD_UNKNOWN)
    )
    mti_text = F.coalesce(lookup(fv.MESSAGE_TYPES, F.col("mti"), 1), F.lit(fv.MTI_UNKNOWN))
    noted = F.col("__no").isNotNull() & ~F.col("__no").isin("037", "039")

    single = [
        _event("rrn", F.format_string(fv.MSG_RRN, F.col("rrn")), F.col("rrn")),
        _event("response", F.format_string(fv.MSG_RESPONSE, F.col("response_code"), tl.approval("response_code")), F.col("response_code")),
        _event("field", F.format_string(fv.MSG_FIELD, tl.field_prefix(line), F.col("__no"), field_name, field_text, tl.field_value(line)), F.col("__no")),
        _event("to_hsm", F.format_string(fv.MSG_TO_HSM, F.col("__cmd")), F.col("__cmd")),
        _event("from_hsm", F.format_string(fv.MSG_FROM_HSM, F.col("__reply")), F.col("__reply")),
        _event("hsm_result", F.format_string(fv.MSG_HSM_RESULT, F.col("__res")), F.col("__res"), tl.hsm_alert("__res")),
    ]
    present = [F.col("rrn").isNotNull(), F.col("response_code").isNotNull(), noted, F.col("__cmd").isNotNull(), F.col("__reply").isNotNull(), F.col("__res").isNotNull()]
    single = [F.when(p, e) for p, e in zip(present, single)]
    steps = [_event("step", t) for t in tl.milestones(line, "message")]

    def documented(r: Column) -> Column:
        alert = F.format_string(fv.MSG_FAILED, r["name"], r["code"])
        failed = _event("failed", F.format_string(fv.MSG_ALERT, alert), r["name"], alert)
        done = _event("succeeded", F.format_string(fv.MSG_SUCCEEDED, r["name"], r["result"]), r["name"])
        return F.when(r["code"].isNotNull(), failed).otherwise(done)

    def generic(p: Column) -> Column:
        known = F.array_contains(F.col("names"), p["name"])
        alert = fl.failure_text(p["name"], p["code"], known, spec_label)
        text = F.format_string(fv.MSG_ALERT, alert)
        return F.when(known, _event("failed", text, p["name"], alert)).otherwise(_event("undocumented", text, p["name"], alert))

    already = F.transform(F.filter("__doc", lambda r: r["code"].isNotNull()), lambda r: r["name"])
    found = F.concat(
        F.array_compact(F.array(*single, *steps)),
        F.transform("__doc", documented),
        F.transform(F.filter("__gen", lambda p: ~F.array_contains(F.col("__already"), p["name"])), generic),
    )
    rest = F.array_compact(F.array(F.when(F.col("message") != "", _event("line", F.col("message")))))
    opening = F.array(_event("mti", F.format_string(fv.MSG_MTI, F.col("mti"), mti_text), F.col("mti")))
    everything = F.when(F.col("is_start"), opening).otherwise(
        F.when(F.size("__found") > 0, F.col("__found")).otherwise(rest) if mode == "full" else F.col("__found")
    )

    speaks = F.rlike(line, F.lit(r"(?i)NOK|\(\s*-|!=|ERROR|-\s*[1-9]"))
    empty_doc = F.lit(None).cast("array<struct<name:string,code:string,result:string>>")
    empty_gen = F.lit(None).cast("array<struct<name:string,code:string>>")
    may_report = speaks | fl.has_success_marker(line)
    return (
        named.withColumns({"__no": number, "__cmd": command, "__reply": reply, "__res": result})
        .withColumns(
            {
                "__doc": F.coalesce(F.when(may_report & ~F.col("is_start"), fl.documented_results(line, F.col("names"))), empty_doc, F.array()),
                "__gen": F.coalesce(F.when(speaks & ~F.col("is_start"), fl.generic_failures(line)), empty_gen, F.array()),
            }
        )
        .withColumn("__already", already)
        .withColumn("__found", found)
        .withColumn("events", F.array_distinct(everything))
        .drop("__no", "__cmd", "__reply", "__res", "__doc", "__gen", "__already", "__found")
    )


def told_events(lines: DataFrame, mode: str = "compact", numbers: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Events of lines with ``events``, one row each: key columns, ``line_no, rank, kind, text, name, alert``.

    ``rank`` orders the events of one line.  ``numbers`` turns places into line numbers before they are printed.
    """
    keys = [c for c in TX if c in lines.columns]
    # Of a bare column the optimizer infers a filter, for which all events would be found a second time.
    each = F.posexplode(F.filter("events", lambda e: e["kind"].isNotNull()))
    rows = lines.select(*keys, "line_no", "ts_text", "level", each.alias("rank", "e"))
    prefixed = (numbers(rows) if numbers else rows).withColumn("__prefix", tl.event_prefix(mode))
    return prefixed.select(*keys, "line_no", "rank", "e.kind", F.concat("__prefix", "e.text").alias("text"), "e.name", "e.alert")


def line_events(named: DataFrame, mode: str = "compact", spec_label: str = SPEC_LABEL) -> DataFrame:
    """Events of every line: key columns, ``line_no, rank, kind, text, name, alert``."""
    return told_events(found_events(named, mode, spec_label), mode)


def chronology(lines: DataFrame, specs: DataFrame | None, mode: str = "compact", spec_label: str = SPEC_LABEL) -> DataFrame:
    """Events of ``file_id, line_no, line`` with the segment of each: :func:`line_events` plus ``seg``."""
    facts = line_facts(lines)
    return in_segments(line_events(with_documented_names(facts, specs), mode, spec_label), segments(facts))


def closing_events(tx: DataFrame, violations: DataFrame | None = None) -> DataFrame:
    """Events added when a transaction closes: the network response, then format alerts."""
    null = F.lit(None).cast("string")
    at = F.lit(AFTER_LINES).alias("line_no")
    sent = tx.withColumn("text", response_event()).filter(F.col("text").isNotNull())
    out = sent.select(*TX, at, F.lit(0).alias("rank"), F.lit("network").alias("kind"), "text", null.alias("name"), null.alias("alert"))
    if violations is not None:
        out = out.unionByName(
            violations.select(
                *TX,
                at,
                F.col("field_rank").alias("rank"),
                F.lit("format").alias("kind"),
                F.format_string(fv.MSG_FORMAT_ALERT, F.col("message")).alias("text"),
                F.col("field_number").alias("name"),
                F.col("message").alias("alert"),
            )
        )
    return out


FAILED_KINDS = ("failed", "undocumented")


def place_in_root(events: DataFrame, places: DataFrame) -> DataFrame:
    """Events under the transaction they were merged into, with their place in the fold."""
    return events.join(places, TX).select(
        "file_id",
        F.col("root_session_id").alias("session_id"),
        F.col("root_seg").alias("seg"),
        F.struct("place", "line_no", "rank").alias("at"),
        "kind",
        "text",
        "name",
        "alert",
    )


def at_line(events: DataFrame) -> DataFrame:
    """Events of unmerged transactions in the same shape as :func:`place_in_root`."""
    return events.withColumn("at", F.struct("line_no", "rank")).drop("line_no", "rank")


def failed_functions(placed: DataFrame) -> DataFrame:
    return ordered_distinct(placed.filter(F.col("kind").isin(*FAILED_KINDS)), TX, "name", ["at"])


def successful_functions(placed: DataFrame) -> DataFrame:
    return ordered_distinct(placed.filter("kind = 'succeeded'"), TX, "name", ["at"])


def hsm_calls(placed: DataFrame) -> DataFrame:
    return ordered_distinct(placed.filter("kind = 'to_hsm'"), TX, "name", ["at"])


def alerts(placed: DataFrame) -> DataFrame:
    return ordered_distinct(placed, TX, "alert", ["at"])


def list_sizes(placed: DataFrame) -> DataFrame:
    """Distinct failed functions, alerts and HSM calls per transaction, in two combinable steps."""
    value = F.explode(
        F.array_compact(
            F.array(
                F.when(F.col("kind").isin(*FAILED_KINDS), F.struct(F.lit("f").alias("list"), F.col("name").alias("v"))),
                F.when(F.col("alert").isNotNull(), F.struct(F.lit("a").alias("list"), F.col("alert").alias("v"))),
                F.when(F.col("kind") == "to_hsm", F.struct(F.lit("h").alias("list"), F.col("name").alias("v"))),
            )
        )
    )
    entries = placed.select(*TX, value.alias("x")).select(*TX, "x.list", "x.v").distinct()
    count = lambda which: F.count_if(F.col("list") == which)
    return entries.groupBy(*TX).agg(count("f").alias("n_failed"), count("a").alias("n_alerts"), count("h").alias("n_hsm"))


def with_list_sizes(tx: DataFrame, sizes: DataFrame) -> DataFrame:
    names = ["n_failed", "n_alerts", "n_hsm"]
    return tx.join(sizes, TX, "left").withColumns({n: F.coalesce(F.col(n), F.lit(0).cast("bigint")) for n in names})
