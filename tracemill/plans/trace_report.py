"""Lines to finished report tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.operators import events as ev
from tracemill.operators import report as rp
from tracemill.operators import transactions as tr
from tracemill.operators.fields import conformance, field_said, fold_fields, merge_fields
from tracemill.operators.scan import BLOCK
from tracemill.operators.transactions import TX
from tracemill.session import stage
from tracemill.sources.refdata import field_reference
from tracemill.sources.traces import TraceScan


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysis; transactions are keyed by ``file_id, session_id, seg``.

    ``merged`` holds every transaction after merging, ``transactions`` those kept.
    ``events`` is the chronology of the merged transactions, ``violations`` the format
    alerts of the transactions that became roots.
    """

    merged: DataFrame
    transactions: DataFrame
    events: DataFrame
    fields: DataFrame
    violations: DataFrame

    def failed_functions(self) -> DataFrame:
        return ev.failed_functions(self.events)

    def alerts(self) -> DataFrame:
        return ev.alerts(self.events)

    def hsm_calls(self) -> DataFrame:
        return ev.hsm_calls(self.events)

    def summary(self) -> DataFrame:
        return rp.trace_summary(self.transactions, self.hsm_calls(), self.merged)

    def report(self, n: int = 20) -> DataFrame:
        return rp.report_top(tr.business_only(self.transactions), n)

    def text(self, mode: str = "compact") -> DataFrame:
        return rp.transaction_lines(tr.file_order(self.transactions), self.events, mode)


def analyze(
    lines: DataFrame | TraceScan,
    specs: DataFrame | None = None,
    reference: DataFrame | None = None,
    chunks: DataFrame | None = None,
    doc_session: str | None = None,
    mode: str = "compact",
    keep_heartbeats: bool = False,
    asof: bool = True,
    split_heartbeats: bool = False,
    spec_label: str = ev.SPEC_LABEL,
    block: int = BLOCK,
) -> Analysis:
    """Run the whole trace path over ``file_id, line_no, line`` or over a scan of files.

    Lines are read and parsed once.  What they state is written without their text: slim facts for the scans over
    sessions, and the events and fields found, which are moved to their transaction at the end.  In a scan ``line_no``
    is a place that only grows; results get line numbers last.
    """
    scan = lines if isinstance(lines, TraceScan) else None
    lines = scan.lines if scan else lines
    spark = lines.sparkSession
    reference = field_reference(spark) if reference is None else reference
    facts = tr.line_facts(lines)
    found = ev.found_events(ev.with_documented_names(facts, specs), mode, spec_label).withColumn("said", field_said())
    told = stage(tr.slim_facts(found, "ts_text", "level", "events", "said"), "facts")
    segmented = stage(tr.segments(told, responses=True, block=block), "lines")
    closed = stage(tr.describe(tr.drop_ghosts(tr.assemble(segmented))), "transactions")
    tx = tr.response_as_of(closed, tr.response_pairs(segmented), asof, block)

    stated = told.filter(F.col("said").isNotNull()).select("file_id", "session_id", "line_no", "said")
    fields = fold_fields(tr.in_segments(stated, segmented)).join(closed.select(*TX), TX, "left_semi")
    violations = conformance(fields, reference, chunks, doc_session).withColumn("field_rank", F.col("first_line"))
    speaking = tr.in_segments(told.filter(F.size("events") > 0), segmented)
    own = ev.told_events(speaking, mode, (lambda rows: scan.number(rows, "line_no")) if scan and mode == "full" else None)
    events = own.unionByName(ev.closing_events(tx, violations))

    rooted = stage(tr.merge_roots(closed, split_heartbeats, block), "roots")
    places = tr.merge_places(rooted)
    placed = stage(ev.place_in_root(events, places), "events")
    merged = ev.with_list_sizes(tr.describe(tr.fold_merged(rooted)), ev.list_sizes(placed))
    fields, violations = merge_fields(fields, places), violations.join(merged.select(*TX), TX, "left_semi")
    if scan:
        merged = scan.number(merged, "first_line", "close_line")
        fields, violations = scan.number(fields, "first_line", "last_line"), scan.number(violations, "first_line", "last_line")
    return Analysis(merged=merged, transactions=tr.drop_heartbeats(merged, keep_heartbeats), events=placed, fields=fields, violations=violations)
