"""Structure repair of conversations by a shortest edit path, with backward costs stored only at checkpoints.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Four states say what came last (nothing, system, user,
assistant).  The rows of a conversation are cut into blocks of about the square root of the longest conversation:

1. every block is reduced to the cheapest way from each state before it to each state after it (blocks in parallel);
2. one pass over these few matrices of a conversation, last block first, leaves the backward cost vector at the end of each
   block: the checkpoints;
3. walking forward, a block recomputes its own backward vectors from its checkpoint and emits, row after row, the smallest
   letter that is still on a cheapest path.

A task holds the vectors of one block and one row.  The rows of one conversation are read in order by one task at the end, as
a stream, for a digest over a whole conversation can be computed in no other way.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import query, read, write_stage

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits Delete, Insert, Rerole; a kept or reroled row that is cut off costs one more.
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or reroled row leads to.
AFTER = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The states a row of each initial may be kept in, and where that leads.
KEEP = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
FAR = 1 << 40
#: Costs of the inserts that complete a conversation after its last row.
END = (0, 2 * INSERT, INSERT, 0)
LEAST_BLOCK = 256
PREFIX = 64

_MEMO: dict[tuple, tuple] = {}


def before(symbol: str, after: tuple) -> tuple:
    """Backward costs before a row from those after it.

    A row's symbol is its initial (``x`` for any other), in capitals if it is cut off, or ``-`` if it must go.
    """
    low = min(after)
    key = (symbol, tuple(a - low for a in after))
    if key not in _MEMO:
        least = [DELETE + a for a in key[1]]
        if symbol != "-":
            cut = CUT_OFF if symbol.isupper() else 0
            keep = KEEP[symbol.lower()]
            for q in range(4):
                least[q] = min(least[q], REROLE + cut + key[1][AFTER[q]], cut + key[1][keep[q]] if q in keep else FAR)
        for _ in range(3):
            least = [min(c, INSERT + least[AFTER[q]]) for q, c in enumerate(least)]
        _MEMO[key] = tuple(min(c, FAR) for c in least)
    return tuple(min(c + low, FAR) for c in _MEMO[key])


def backward(symbols: str, end: tuple) -> list[tuple]:
    """Cost vectors before every row of a block and, last, ``end``."""
    out = [end]
    for symbol in reversed(symbols):
        out.append(before(symbol, out[-1]))
    return out[::-1]


def matrix(symbols: str) -> list[int]:
    """Least costs through a block, from each state (rows) to each state (columns)."""
    columns = []
    for q in range(4):
        vector = tuple(0 if p == q else FAR for p in range(4))
        for symbol in reversed(symbols):
            vector = before(symbol, vector)
        columns.append(vector)
    return [columns[q][p] for p in range(4) for q in range(4)]


def row_edits(symbol: str, state: int, here: tuple, after: tuple) -> tuple[list[tuple[str, int]], int]:
    """The smallest tight letters for a row, with the state each leads to, and the state after the row."""
    out, cut = [], CUT_OFF if symbol.isupper() else 0
    while True:
        if DELETE + after[state] == here[state]:
            return [*out, ("D", state)], state
        if INSERT + here[AFTER[state]] == here[state]:
            state = AFTER[state]
            out.append(("I", state))
            continue
        kept = KEEP.get(symbol.lower(), {}).get(state)
        if kept is not None and cut + after[kept] == here[state]:
            return [*out, ("K", kept)], kept
        return [*out, ("R", AFTER[state])], AFTER[state]


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows by conversation and turn (nulls first), then role and text; ``pos`` grows in that order.  Written once.

    Nulls in ``role`` and ``text`` are one space.  Rows alike in the range keys (the first ``PREFIX`` characters of the text
    are the last of them) stay in one partition.
    """
    filled = conversations.select(
        F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc()]
    dealt = filled.repartitionByRange(*keys, F.substring("text", 1, PREFIX).asc())
    return write_stage(dealt.sortWithinPartitions(*keys, F.col("text").asc()).withColumn("pos", F.monotonically_increasing_id()), "turns")


def with_faults(turns: DataFrame) -> DataFrame:
    """``conv_id, pos, fault, symbol``: the first fault of every row (blank, duplicate, truncated or none)."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    facts = turns.select(
        "conv_id", "pos", "role", F.sha2("text", 256).alias("digest"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    again = facts.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("earliest"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(*[F.col(c).alias(f"{c}_") for c in ("conv_id", "role", "digest")], "earliest")
    same = F.col("conv_id").eqNullSafe(F.col("conv_id_")) & (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_"))
    seen = F.coalesce(F.col("pos") > F.col("earliest"), F.lit(False))
    fault = F.when(F.col("blank"), "blank").when(seen, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    return facts.join(again, same, "left").withColumn("fault", fault).select("conv_id", "pos", "fault", symbol.alias("symbol"))


def checkpoints(faults: DataFrame) -> DataFrame:
    """``conv_id, pos, symbols, faults, ends``: per block its first position, its symbols and the cost vector after it.

    ``faults`` has one letter per row as well: the first of its fault, or ``-``.
    """
    longest = faults.groupBy("conv_id").count().agg(F.max("count").alias("n")).first().n or 0
    size = max(LEAST_BLOCK, math.isqrt(longest) + 1)
    rows = F.sort_array(F.collect_list(F.struct("pos", "symbol", F.coalesce(F.left("fault", F.lit(1)), F.lit("")).alias("fault"))))
    blocks = faults.groupBy("conv_id", F.floor(F.col("pos") / size).alias("block")).agg(F.min("pos").alias("pos"), rows.alias("rows"))
    blocks = blocks.select(
        "conv_id", "pos", F.array_join(F.col("rows.symbol"), "").alias("symbols"),
        F.array_join(F.transform("rows", lambda r: F.when(r.fault == "", "-").otherwise(r.fault)), "").alias("faults"),
    )

    def reduce(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([matrix(s) for s in b.column("symbols").to_pylist()], pa.list_(pa.int64()))], [*b.schema.names, "costs"])

    kind = f"conv_id {faults.schema['conv_id'].dataType.simpleString()}, pos long, symbols string, faults string"
    reduced = write_stage(blocks.mapInArrow(reduce, f"{kind}, costs array<long>"), "blocks")

    def chain(batches):
        conv, end, started = None, END, False
        for b in batches:
            ends = []
            for c, costs in zip(b.column("conv_id").to_pylist(), b.column("costs").to_pylist(), strict=True):
                if not started or c != conv:
                    conv, end, started = c, END, True
                ends.append(list(end))
                end = tuple(min(min(costs[4 * q + p] + end[p] for p in range(4)), FAR) for q in range(4))
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ends, pa.list_(pa.int64()))], [*b.schema.names[:4], "ends"])

    backwards = reduced.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("pos").desc())
    return backwards.mapInArrow(chain, f"{kind}, ends array<long>")


EDITS = "turn long, was_role string, fault string, edit string, role string, text string"
FAULTS = {"-": "", "b": "blank", "d": "duplicate", "t": "truncated"}


def repair(conversations: DataFrame) -> DataFrame:
    """The edits of every conversation, in order: ``conv_id, turn, was_role, fault, edit, role, text``.

    Each conversation opens with one row whose ``edit`` is empty, so that none is missing.  ``edit`` is ``K``, ``R``, ``D`` or
    ``I``; ``role`` and ``text`` are what stands after it (null for ``D``).  An inserted row has no turn, fault and earlier role.
    The rows of a conversation lie in one partition, in order.  A null ``conv_id`` is a conversation of its own; nulls in role
    and text are one space; repeated rows are duplicates; equal turns are ordered by role and text.  Only the columns
    ``conv_id, turn, role, text`` are read.  An empty table gives an empty one.
    """
    turns = in_order(conversations)
    blocks = checkpoints(with_faults(turns))
    stream = conversations.select("conv_id").distinct().withColumns({"pos": F.lit(-1).cast("long"), "kind": F.lit(0)})
    stream = stream.unionByName(blocks.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    stream = stream.unionByName(turns.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    stream = stream.select("conv_id", "kind", "symbols", "faults", "ends", F.col("turn").cast("long").alias("turn"), "role", "text", "pos")
    conv_type = conversations.schema["conv_id"].dataType.simpleString()

    def walk(batches):
        open_, conv, state, block = False, None, NOTHING, None
        for b in batches:
            out = []
            for c, kind, symbols, faults, ends, turn, role, text, _ in zip(*[col.to_pylist() for col in b.columns], strict=True):
                if kind == 0:
                    if open_:
                        out += complete(conv, state)
                    open_, conv, state = True, c, NOTHING
                    out.append((c, None, None, None, "", None, None))
                elif kind == 1:
                    block, costs, at = (symbols, faults), backward(symbols, tuple(ends)), 0
                else:
                    edits, state = row_edits(block[0][at], state, costs[at], costs[at + 1])
                    out += [(c, None, None, None, "I", NAMES[s], "") for _, s in edits[:-1]]
                    letter, s = edits[-1]
                    after = None if letter == "D" else role if letter == "K" else NAMES[s]
                    out.append((c, turn, role, FAULTS[block[1][at]], letter, after, None if letter == "D" else text))
                    at += 1
            if out:
                yield arrow(out, b.schema.field("conv_id").type)
        if open_ and (tail := complete(conv, state)):
            yield arrow(tail, b.schema.field("conv_id").type)

    ordered = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "pos", "kind")
    return ordered.mapInArrow(walk, f"conv_id {conv_type}, {EDITS}")


def complete(conv, state: int) -> list[tuple]:
    """Inserts that complete a conversation after its last row."""
    out = []
    while END[state]:
        state = AFTER[state]
        out.append((conv, None, None, None, "I", NAMES[state], ""))
    return out


def arrow(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
    names = ["conv_id", "turn", "was_role", "fault", "edit", "role", "text"]
    types = [conv_type, pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def summarise(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s result, read in its order.

    ``gaps`` counts missing turns, ``illegal`` the neighbours (before the edits) whose initials are not ``su``, ``ua`` or ``au``.
    """

    def run(batches):
        one = None
        for b in batches:
            done = []
            for conv, turn, was, fault, edit, role, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if edit == "":
                    if one:
                        done.append(one.row())
                    one = _Conversation(conv)
                else:
                    one.add(turn, was, fault, edit, role, text)
            if done:
                yield result(done, b.schema.field("conv_id").type)
        if one:
            yield result([one.row()], b.schema.field("conv_id").type)

    names = ["conv_id", *[c.split()[0] for c in SUMMARY.split(", ")]]

    def result(rows, conv_type):
        types = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return edits.mapInArrow(run, f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, {SUMMARY}")


class _Conversation:
    """Running counts and the running digest of one conversation."""

    def __init__(self, conv):
        self.conv, self.first, self.last, self.turns, self.initial = conv, None, None, 0, None
        self.faults, self.illegal, self.cost, self.audit, self.hash, self.any = dict.fromkeys(FAULTS.values(), 0), 0, 0, [], hashlib.sha256(), False

    def add(self, turn, was, fault, edit, role, text):
        self.audit.append(edit)
        self.cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
        if edit != "I":
            self.faults[fault] += 1
            self.cost += CUT_OFF if fault == "truncated" and edit != "D" else 0
            if self.initial is not None and self.initial + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.initial = was[:1]
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.last, self.turns = turn, self.turns + 1
        if edit != "D":
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True

    def row(self):
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        f = self.faults
        return self.conv, gaps, f["blank"], f["duplicate"], f["truncated"], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``: 0 dropped, 1 emptied, 2 without ``. ! ?``, 3 twice, 4 said by the user.

    A null anywhere counts as one space.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    which = (F.crc32(F.concat(filled[0], F.lit(":"), filled[1]).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", filled[2].alias("role"), filled[3].alias("text"), which.alias("which")).filter("which <> 0")
    text = F.when(F.col("which") == 1, "").when(F.col("which") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("which") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("which") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


@query("op12_conversation_repair")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    seen = summarise(repair(damaged(table)))
    ids = table.select(F.col("conv_id").alias("id")).distinct()
    zero = {c.split()[0]: F.coalesce(c.split()[0], F.lit(0).cast("long")) for c in SUMMARY.split(", ")[:6]}
    empty = {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))}
    joined = ids.join(seen, F.col("id").eqNullSafe(F.col("conv_id")), "left").withColumns({**zero, **empty})
    return joined.select(F.col("id").alias("conv_id"), *zero, *empty)
