"""Summaries and reports over transactions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import report as rp
from tracemill.functions.text import strip
from tracemill.functions.trace_line import mask_pan
from tracemill.operators.ordered import ordered_distinct, ordered_union, top_per_group
from tracemill.operators.scan import position_block, ranked
from tracemill.operators.transactions import TX

#: Lines of a text that one task joins.
PART_LINES = 10_000


def trace_summary(tx: DataFrame, hsm: DataFrame, merged: DataFrame) -> DataFrame:
    """Per file: kept transactions, heartbeats found, HSM calls, distinct commands, alerts.

    ``tx``: kept transactions with ``n_hsm, n_alerts``; ``merged``: the same before
    heartbeats were left out; ``hsm``: one row per transaction and command (``name``).
    """
    kept = tx.groupBy("file_id").agg(
        F.count("*").alias("transactions"), F.sum("n_hsm").alias("hsm_calls"), F.sum("n_alerts").alias("alerts")
    )
    beats = merged.groupBy("file_id").agg(F.count_if("is_heartbeat").alias("heartbeats"))
    commands = hsm_commands(tx, hsm).groupBy("file_id").agg(F.count("*").alias("hsm_commands"))
    out = beats.join(kept, "file_id", "left").join(commands, "file_id", "left")
    counts = ["transactions", "hsm_calls", "hsm_commands", "alerts"]
    return out.select(
        "file_id", "heartbeats", *[F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in counts]
    )


def hsm_commands(tx: DataFrame, hsm: DataFrame) -> DataFrame:
    """Distinct HSM commands per file with the number of kept transactions that sent each."""
    sent = hsm.join(tx.select(*TX), TX, "left_semi")
    return sent.groupBy("file_id", F.col("name").alias("command")).agg(F.count("*").alias("transactions"))


def report_summary(tx: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Totals of business transactions: all, suspicious (with alerts), approved, declined."""
    approved = F.col("response_code").isin(*fv.APPROVED_CODES)
    return tx.groupBy(*keys).agg(
        F.count("*").alias("total_transactions"),
        F.count_if(F.col("n_alerts") > 0).alias("suspicious_count"),
        F.count_if(approved).alias("approved_count"),
        F.count_if(F.col("response_code").isNotNull() & ~approved).alias("declined_count"),
    )


def report_top(tx: DataFrame, n: int = fv.REPORT_ROWS) -> DataFrame:
    """Transactions shown in the report of each file: those with alerts first, then file order."""
    order = [(F.col("n_alerts") > 0).desc(), F.col("close_key"), F.col("session_first")]
    return top_per_group(tx, ["file_id"], order, n, "report_no")


def distinct_failed(failed: DataFrame, keys: Sequence[str] = ("file_id",)) -> DataFrame:
    """Failed functions of a file in the order they are first seen (``place`` orders them)."""
    return ordered_distinct(failed, list(keys), "name", ["first_seen"], "place")


def alert_badge(tx: DataFrame) -> DataFrame:
    return tx.withColumn("badge", F.greatest("n_alerts", "n_failed"))


def step_functions(steps: DataFrame, keys: Sequence[str], position: str = "step_no", text: str = "step") -> DataFrame:
    """Functions that failed according to chronology steps; first spelling kept per lower-case name."""
    named = steps.withColumn("__f", rp.failed_in_step(text)).filter(F.col("__f").isNotNull())
    first = named.groupBy(*keys, F.lower("__f").alias("__k")).agg(
        F.min_by("__f", position).alias("function"), F.min(position).alias("first_step")
    )
    return first.drop("__k")


def enrich_report(report: DataFrame, parsed: DataFrame) -> DataFrame:
    """Report rows completed with what the parser knows about the same transaction.

    Both have ``file_id, idx, rrn, stan, transaction_id, failed_functions, alerts,
    processing_code``; the report also ``steps`` (array) and ``hint``.  Rows meet on
    the first known identifier (of several parser rows the last), else on position.
    """
    facts = F.struct("failed_functions", "alerts", "processing_code")
    source = parsed.select("file_id", "idx", rp.match_key().alias("__key"), facts.alias("__p"))
    by_key = (
        source.filter(F.col("__key").isNotNull()).groupBy("file_id", "__key").agg(F.max_by("__p", "idx").alias("__by_key"))
    )
    by_place = source.select("file_id", "idx", F.col("__p").alias("__by_place"))
    met = (
        report.withColumn("__key", rp.match_key())
        .join(by_key, ["file_id", "__key"], "left")
        .join(by_place, ["file_id", "idx"], "left")
        .withColumn("__p", F.coalesce("__by_key", "__by_place"))
    )
    told = F.array_compact(F.transform("steps", lambda s: rp.failed_in_step(s)))
    lowered = F.transform(told, lambda f: F.lower(f))
    from_steps = F.filter(told, lambda f, i: F.array_position(lowered, F.lower(f)) == i + 1)
    met = met.withColumn("failed_functions", ordered_union(F.col("__p.failed_functions"), from_steps, F.col("failed_functions")))
    alerts = ordered_union(F.col("__p.alerts"), F.col("alerts"))
    unnamed = F.filter(
        "failed_functions", lambda f: ~F.exists("__alerts", lambda a: F.contains(F.lower(a), F.lower(f)))
    )
    added = F.transform(unnamed, lambda f: F.format_string(fv.MSG_FUNCTION_FAILED, f))
    hint = F.format_string(fv.MSG_HINT, F.array_join("failed_functions", ", "))
    return (
        met.withColumn("__alerts", alerts)
        .withColumns(
            {
                "alerts": F.array_union("__alerts", added),
                "processing_code": F.coalesce(F.nullif("processing_code", F.lit("")), "__p.processing_code"),
                "hint": F.when((F.coalesce(strip("hint"), F.lit("")) == "") & (F.size("failed_functions") > 0), hint).otherwise(F.col("hint")),
            }
        )
        .drop("__key", "__by_key", "__by_place", "__p", "__alerts")
        .select(*report.columns)
    )


def transaction_lines(tx: DataFrame, placed: DataFrame, mode: str = "compact", mask: bool = True) -> DataFrame:
    """Text of each transaction as ordered lines (``file_id, tx_no, section, at, text``).

    Sections: 0 title, 1 identifiers, 2 response, 3 chronology head, 4 chronology,
    5 alerts, 6 successful functions.  A transaction may have any number of lines; a
    file is written by sorting on ``(file_id, tx_no, section, at)``.  Card numbers are
    masked unless ``mask`` is off.
    """
    if mask:
        tx = tx.withColumn("pan", mask_pan("pan"))
    shown = lambda c: F.coalesce(F.col(c), F.lit(fv.NOT_AVAILABLE))
    mti = F.when(F.col("mti").isNotNull(), F.format_string("MTI %s (%s)", F.col("mti"), F.col("mti_description"))).otherwise("MTI non spécifié")
    kind = "synthétique" if mode == "compact" else "exhaustive"
    head = F.array(
        F.format_string("=== Transaction %d [%s] ===", F.col("tx_no"), mti),
        F.format_string("STAN: %s | PAN: %s | ID: %s", shown("stan"), shown("pan"), shown("transaction_id")),
        F.format_string("RRN [FLD 037]: %s | Code Réponse [FLD 039]: %s (%s)", shown("rrn"), shown("response_code"), F.col("approval")),
        F.lit(f"Chronologie ({kind}):"),
    )
    null_at = F.lit(None).cast(placed.schema["at"].dataType)
    heads = tx.select("file_id", "tx_no", F.posexplode(head).alias("section", "text")).withColumn("at", null_at)
    numbered = placed.join(tx.select(*TX, "tx_no"), TX)
    steps = numbered.select("file_id", "tx_no", F.lit(4).alias("section"), "at", F.concat(F.lit("- "), "text").alias("text"))

    def listing(rows: DataFrame, section: int, title: str) -> DataFrame:
        entries = rows.select("file_id", "tx_no", F.lit(section).alias("section"), F.col("first_seen.at").alias("at"), F.concat(F.lit(title), "value").alias("text"))
        none = tx.join(rows.select("file_id", "tx_no").distinct(), ["file_id", "tx_no"], "left_anti").select(
            "file_id", "tx_no", F.lit(section).alias("section"), null_at.alias("at"), F.lit(title + fv.NONE_FEMININE).alias("text")
        )
        return entries.unionByName(none)

    alerts = ordered_distinct(numbered, ["file_id", "tx_no"], "alert", ["at"]).withColumnRenamed("alert", "value")
    done = ordered_distinct(numbered.filter("kind = 'succeeded'"), ["file_id", "tx_no"], "name", ["at"]).withColumnRenamed("name", "value")
    return (
        heads.select("file_id", "tx_no", "section", "at", "text")
        .unionByName(steps)
        .unionByName(listing(alerts, 5, "Alertes: "))
        .unionByName(listing(done, 6, "Fonctions OK: "))
    )


def reassemble(lines: DataFrame, keys: Sequence[str], order: Sequence[str], text: str = "text", size: int = PART_LINES) -> DataFrame:
    """Lines of each group joined back to text, in order, as parts of at most ``size`` lines: ``part, first_line, line_count``.

    ``part`` counts from 0, ``first_line`` from 1; a group of up to ``size`` lines is one part.  A longer one, of any length,
    is several rows that different tasks make; its text is that of its parts in order, joined by a line feed.  The first
    column of ``order`` is a whole number.
    """
    placed = ranked(lines.select(*keys, *order, text), keys, order, position_block(order[0]), "__no")
    placed = placed.withColumn("part", F.floor((F.col("__no") - 1) / size).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__no", text))), lambda x: x[text]), "\n")
    return placed.groupBy(*keys, "part").agg(F.min("__no").alias("first_line"), F.count("*").alias("line_count"), body.alias(text))
