"""Trace lines to transactions.

Every group key starts with ``file_id``: files are read together but never mixed.
A transaction is identified by ``(file_id, session_id, seg)`` and its place in the
file by ``(close_key, session_first)``; ``close_key`` is the line that closed it, or
``END_OF_FILE`` when nothing did.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import trace_line as tl
from tracemill.operators.scan import BLOCK, Running, Total, block_scan, position_block, ranked
from tracemill.session import stage
from tracemill.sources.refdata import lookup

END_OF_FILE = 1 << 62
TX = ["file_id", "session_id", "seg"]
IDS = ["transaction_id", "stan", "pan", "rrn", "response_code"]


def line_facts(lines: DataFrame) -> DataFrame:
    """Lines with a session plus what each line states (``file_id, line_no, line`` in).

    A line that opens a transaction states its message type only.
    """
    line = F.col("line")

    def where(needle: str, expr):
        return F.when(~F.col("is_start") & F.contains(line, F.lit(needle)), expr)

    found = tl.identifiers(line)
    has_colon = F.contains(line, F.lit(":"))
    return (
        tl.split_line(lines)
        .withColumn("__start_mti", F.when(has_colon, tl.start_mti(line)))
        .withColumn("is_start", F.col("__start_mti").isNotNull())
        .withColumns(
            {
                "mti": F.coalesce(F.col("__start_mti"), F.when(has_colon, tl.any_mti(line))),
                "transaction_id": where("TRANSACTION_IDENTIFIER}", found["transaction_id"]),
                "stan": where("INTERNAL STAN}", found["stan"]),
                "pan": where("}", found["pan"]),
                "rrn": where("(037)", found["rrn"]),
                "response_code": where("(039)", found["response_code"]),
            }
        )
        .withColumn("is_heartbeat", tl.is_heartbeat_mti("mti") | (~F.col("is_start") & tl.is_heartbeat_field(line)))
        .drop("__start_mti")
    )


#: What the scans over sessions carry of a line; never its text.
SLIM = ["file_id", "session_id", "line_no", "is_start", "mti", *IDS, "is_heartbeat", "opens", "said_011", "said_039"]


def slim_facts(facts: DataFrame, *more: str) -> DataFrame:
    """What each line states, without its text: the rows every scan over a session works on (and the columns ``more``).

    ``opens`` marks lines with message type 1110; ``said_011`` and ``said_039`` are the dumps of fields 011 and 039.
    """
    if "opens" in facts.columns:
        return facts.select(*SLIM, *more)
    line = F.col("line")
    told = facts.withColumn("opens", tl.is_response_start(line) & F.contains(line, F.lit("1110")))
    return told.withColumns(
        {
            "said_011": F.when(~F.col("opens") & F.contains(line, F.lit("(011)")), tl.dump_011(line)),
            "said_039": F.when(~F.col("opens") & F.contains(line, F.lit("(039)")), tl.identifiers(line)["response_code"]),
        }
    ).select(*SLIM, *more)


def segments(facts: DataFrame, responses: bool = False, block: int = BLOCK) -> DataFrame:
    """Slim facts with ``seg`` (0 before the first start of a session) and ``session_first``.

    With ``responses`` also ``open_line`` (last line with message type 1110) and the
    last lines that dumped fields 011 and 039, for :func:`response_pairs`.  Facts that still
    have their text are reduced and written first, so that lines are parsed once.
    """
    slim = slim_facts(facts) if "opens" in facts.columns else stage(slim_facts(facts), "facts")
    measures = [Running("seg", "sum", "__start"), Total("session_first", "min", "line_no")]
    work = slim.withColumn("__start", F.col("is_start").cast("bigint"))
    if responses:
        at = F.col("line_no")
        work = work.withColumns(
            {
                "__open": F.when(F.col("opens"), at),
                "__011": F.when(F.col("said_011").isNotNull(), at),
                "__039": F.when(F.col("said_039").isNotNull(), at),
            }
        )
        measures += [
            Running("open_line", "max", "__open"),
            Running("line_011", "max", "__011"),
            Running("line_039", "max", "__039"),
        ]
    out = block_scan(work, ["file_id", "session_id"], ["line_no"], position_block("line_no", block), measures)
    return out.drop("__start", "__open", "__011", "__039")


def in_segments(rows: DataFrame, segmented: DataFrame) -> DataFrame:
    """Add ``seg`` to rows of lines (``file_id, line_no``): only what was found in a line is moved to its segment.

    The segments of all lines pack so well in files that Spark would broadcast them; both sides are shuffled instead.
    """
    return rows.join(segmented.select("file_id", "line_no", "seg").hint("merge"), ["file_id", "line_no"])


def response_pairs(segmented: DataFrame) -> DataFrame:
    """One row per completed response: ``file_id, session_id, open_line, done_line, stan, response_code``.

    A 1110 line opens an episode in its session; the first later line by which both
    field 011 and field 039 were seen completes it.
    """
    dumps = segmented.filter(
        (F.col("line_no") == F.col("line_011")) | (F.col("line_no") == F.col("line_039"))
    )
    both = (F.col("line_011") > F.col("open_line")) & (F.col("line_039") > F.col("open_line"))
    done = (
        dumps.filter(both)
        .groupBy("file_id", "session_id", "open_line")
        .agg(F.min(F.struct("line_no", "line_011", "line_039")).alias("__at"))
        .select(
            "file_id",
            "session_id",
            "open_line",
            F.col("__at.line_no").alias("done_line"),
            F.col("__at.line_011").alias("line_011"),
            F.col("__at.line_039").alias("line_039"),
        )
    )
    stans = dumps.filter("line_no = line_011").select("file_id", F.col("line_no").alias("line_011"), F.col("said_011").alias("stan"))
    codes = dumps.filter("line_no = line_039").select("file_id", F.col("line_no").alias("line_039"), F.col("said_039").alias("response_code"))
    return (
        done.join(stans, ["file_id", "line_011"])
        .join(codes, ["file_id", "line_039"])
        .select("file_id", "session_id", "open_line", "done_line", "stan", "response_code")
    )


def assemble(segmented: DataFrame) -> DataFrame:
    """Fold the lines of each segment into one transaction row.

    Only lines that state something are shuffled.  A start line also reports itself
    to the segment it closes, so the close line needs no join.
    """
    at = F.col("line_no")
    states = F.col("mti").isNotNull() | F.col("is_heartbeat")
    for name in IDS:
        states = states | F.col(name).isNotNull()
    own = F.struct(F.col("seg").alias("seg"), F.lit(False).alias("closing"))
    closed = F.struct((F.col("seg") - 1).alias("seg"), F.lit(True).alias("closing"))
    told = (
        segmented.filter(states)
        .withColumn("__to", F.explode(F.when(F.col("is_start"), F.array(own, closed)).otherwise(F.array(own))))
        .withColumn("seg", F.col("__to.seg"))
    )
    states_own = ~F.col("__to.closing")

    def last(name: str):
        return F.max_by(F.col(name), F.when(states_own & F.col(name).isNotNull(), at)).alias(name)

    return (
        told.groupBy(*TX)
        .agg(
            F.min("session_first").alias("session_first"),
            F.min(F.when(states_own, at)).alias("first_line"),
            F.min(F.when(~states_own, at)).alias("close_line"),
            last("mti"),
            F.coalesce(F.bool_or(F.when(states_own, F.col("is_heartbeat"))), F.lit(False)).alias("is_heartbeat"),
            *[last(name) for name in IDS],
        )
        .withColumn("close_key", F.coalesce("close_line", F.lit(END_OF_FILE)))
    )


def drop_ghosts(tx: DataFrame) -> DataFrame:
    """Leave out fragments that are no heartbeat and carry no identifier."""
    known = F.coalesce("stan", "transaction_id", "rrn", "pan").isNotNull()
    return tx.filter(F.col("is_heartbeat") | known)


def describe(tx: DataFrame) -> DataFrame:
    """Add ``mti_description`` and ``approval``."""
    text = F.coalesce(lookup(fv.MESSAGE_TYPES, F.col("mti"), 1), F.lit(fv.MTI_UNKNOWN))
    return tx.withColumns(
        {"mti_description": F.when(F.col("mti").isNotNull(), text), "approval": tl.approval("response_code")}
    )


def transactions(lines: DataFrame, block: int = BLOCK) -> DataFrame:
    """Raw lines to transactions, ghosts left out."""
    return describe(drop_ghosts(assemble(segments(line_facts(lines), block=block))))


def file_order(tx: DataFrame, out: str = "tx_no", block: int = BLOCK) -> DataFrame:
    """1-based place of each transaction in its file (order in which transactions close)."""
    return ranked(tx, ["file_id"], ["close_key", "session_first"], _places(block), out)


def _blocks(position: str, tie: str, block: int) -> list[Column]:
    """Blocks that grow with ``(position, tie)``; only rows that share END_OF_FILE are cut by their tie."""
    last = F.when(F.col(position) == END_OF_FILE, position_block(tie, block)).otherwise(0)
    return [position_block(position, block), last]


def _places(block: int) -> list[Column]:
    return _blocks("close_key", "session_first", block)


def response_as_of(tx: DataFrame, pairs: DataFrame, asof: bool = True, block: int = BLOCK) -> DataFrame:
    """Add ``network_response``: code of the latest response to the same STAN in the file.

    By default only responses completed no later than the line that closed the
    transaction count; ``asof=False`` looks at the whole file.  Responses and
    transactions are laid in one sequence per STAN, so no pair of rows is ever built.
    """
    pos = F.col("close_key") if asof else F.lit(END_OF_FILE)
    code_type = "struct<done_line:bigint,code:string>"
    asked = tx.filter(F.col("stan").isNotNull()).withColumns(
        {"__pos": pos, "__side": F.lit(1), "__sub": F.col("session_first"), "__code": F.lit(None).cast(code_type)}
    )
    told = pairs.select(
        "file_id",
        "stan",
        F.col("done_line").alias("__pos"),
        F.lit(0).alias("__side"),
        F.lit(0).cast("bigint").alias("__sub"),
        F.struct("done_line", F.col("response_code").alias("code")).cast(code_type).alias("__code"),
    )
    both = asked.unionByName(told, allowMissingColumns=True)
    found = block_scan(
        both,
        ["file_id", "stan"],
        ["__pos", "__side", "__sub"],
        _blocks("__pos", "__sub", block),
        [Running("__found", "max", "__code")],
    )
    out = found.filter("__side = 1").withColumn("network_response", F.col("__found.code"))
    rest = tx.filter(F.col("stan").isNull()).withColumn("network_response", F.lit(None).cast("string"))
    return out.select(*tx.columns, "network_response").unionByName(rest)


def response_event(stan="stan", response="network_response"):
    """Sentence that closes the chronology of a transaction with a STAN."""
    return F.when(F.col(response).isNotNull(), F.format_string(fv.MSG_RESPONSE_SENT, F.col(response))).when(
        F.col(stan).isNotNull(), F.lit(fv.MSG_NO_RESPONSE)
    )


def merge_roots(tx: DataFrame, split_heartbeats: bool = False, block: int = BLOCK) -> DataFrame:
    """Tell each transaction which one it is merged into.

    * a fragment without STAN and transaction id joins the first transaction of its
      file that has one and carries the same RRN, unless the fragment is a heartbeat
      and that transaction is not;
    * transactions with the same STAN join the first of them; ``split_heartbeats``
      keeps heartbeats and business transactions apart.

    Adds ``root`` (identity and place), ``target`` (same) and ``is_orphan``.

    Both rules are one scan over groups of a (kind, key): a transaction with a STAN asks its STAN, any other its
    RRN; those that can be joined tell their RRN who they are as well.
    """
    me = F.struct("close_key", "session_first", "session_id", "seg")
    orphan = F.col("stan").isNull() & F.col("transaction_id").isNull()
    by_stan, by_rrn = F.col("stan").isNotNull(), F.col("rrn").isNotNull()
    apart = F.col("is_heartbeat") if split_heartbeats else F.lit(None).cast("boolean")
    group = lambda kind, key, hb, asks: F.struct(F.lit(kind).alias("kind"), key.alias("key"), hb.alias("hb"), F.lit(asks).alias("asks"))
    none = F.lit(None).cast("boolean")
    asked = F.when(by_stan, group("stan", F.col("stan"), apart, True)).when(by_rrn, group("rrn", F.col("rrn"), none, True))
    told = F.when(by_stan & by_rrn, group("rrn", F.col("rrn"), none, False))

    work = tx.withColumns({"me": me, "is_orphan": orphan})
    who = F.when(~F.col("is_orphan"), F.struct("me", "is_heartbeat", "stan"))
    laid = work.withColumn("__to", F.explode(F.array_compact(F.array(asked, told)))).select(
        "*", F.col("__to.kind").alias("__kind"), F.col("__to.key").alias("__key"), F.col("__to.hb").alias("__hb"), who.alias("__who")
    )
    found = block_scan(laid, ["file_id", "__kind", "__key", "__hb"], ["close_key"], _places(block), [Total("__first", "min", "__who")])
    found = found.filter("__to.asks")

    columns = [*tx.columns, "me", "is_orphan"]
    same_stan = found.filter("__kind = 'stan'").select(
        *columns, F.col("__first.me").alias("root"), F.col("me").alias("target"), F.lit(False).alias("merged_by_rrn")
    )
    # A fragment that joins a transaction goes where that one goes.
    roots = tx.filter(by_stan).groupBy(F.col("file_id").alias("__file"), F.col("stan").alias("__stan"), apart.alias("__same")).agg(F.min(me).alias("__root"))
    first_hb = F.col("__first.is_heartbeat") if split_heartbeats else none
    there = (F.col("file_id") == F.col("__file")) & (F.col("__first.stan") == F.col("__stan")) & first_hb.eqNullSafe(F.col("__same"))
    joins = (
        F.col("is_orphan")
        & F.col("__first").isNotNull()
        & ~(F.col("is_heartbeat") & ~F.col("__first.is_heartbeat"))
    )
    same_rrn = found.filter("__kind = 'rrn'").join(roots, there, "left").select(
        *columns,
        F.when(joins, F.coalesce("__root", F.col("__first.me"))).otherwise(F.col("me")).alias("root"),
        F.when(joins, F.col("__first.me")).otherwise(F.col("me")).alias("target"),
        joins.alias("merged_by_rrn"),
    )
    alone = work.filter(~by_stan & ~by_rrn).withColumns({"root": F.col("me"), "target": F.col("me"), "merged_by_rrn": F.lit(False)})
    return same_stan.unionByName(same_rrn).unionByName(alone)


def fold_place() -> Column:
    """Place of a part among the parts of its root: by target, the target before its orphans, then file order."""
    return F.struct(
        F.col("target.close_key").alias("target_close"),
        F.col("target.session_first").alias("target_first"),
        "merged_by_rrn",
        "close_key",
        "session_first",
    )


def fold_merged(rooted: DataFrame) -> DataFrame:
    """One row per root: its own identity, first known RRN and response code, number of merged parts."""
    place = fold_place()
    is_root = F.col("me") == F.col("root")

    def own(name: str):
        return F.max(F.when(is_root, F.col(name))).alias(name)

    def first(name: str):
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), place)).alias(name)

    return (
        rooted.groupBy("file_id", "root")
        .agg(
            *[own(c) for c in ("mti", "is_heartbeat", "transaction_id", "stan", "pan", "first_line", "close_line")],
            first("rrn"),
            first("response_code"),
            F.count("*").alias("parts"),
        )
        .withColumns(
            {
                "session_id": F.col("root.session_id"),
                "seg": F.col("root.seg"),
                "close_key": F.col("root.close_key"),
                "session_first": F.col("root.session_first"),
            }
        )
        .drop("root")
    )


def merge_places(rooted: DataFrame) -> DataFrame:
    """Identity of every part with its root and its place in the fold, to carry lists along."""
    return rooted.select(
        *TX,
        F.col("root.session_id").alias("root_session_id"),
        F.col("root.seg").alias("root_seg"),
        fold_place().alias("place"),
    )


def drop_heartbeats(tx: DataFrame, keep: bool = False) -> DataFrame:
    """Leave out heartbeats, except those with failed functions or alerts (``n_failed``, ``n_alerts``)."""
    if keep:
        return tx
    return tx.filter(~F.col("is_heartbeat") | (F.col("n_failed") > 0) | (F.col("n_alerts") > 0))


def business_only(tx: DataFrame) -> DataFrame:
    return tx.filter(~F.col("is_heartbeat"))
