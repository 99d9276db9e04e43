"""Roles of transcript lines by a hidden Markov model, then canonical turns.

Each line of a transcript is observed through a speaker marker at its start and simple features; the hidden state is the
role that speaks.  Start, transition and emission counts come from rows whose role is known.  Viterbi decoding finds the
roles of a conversation whatever its length: rows are range-partitioned by conversation and turn with sampled splitters, so
a long conversation is cut into several parts; a part tells, for each state before it and after it, its best score (a small
max-plus matrix), these are chained over the parts of a conversation, and every part is then decoded between its two
known ends.  Only such matrices, at most two for each part, reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import query, read, write_stage

PART_ROWS = 20_000
DEFAULT_ROLES = ["assistant", "system", "user"]
# Markers that open a speaker's line, by role.
ALIASES = {
    "user": "user human customer client question q prompter".split(),
    "assistant": "assistant ai bot model agent answer a gpt".split(),
    "system": "system instruction instructions sys".split(),
}
ROLE_OF = {alias: role for role, names in ALIASES.items() for alias in names}
MARKER = re.compile(r"^\s*(?:<\|(?P<tag>\w+)\|>|\[(?P<box>\w+)\]:?|#{1,3}\s*(?P<head>\w+):?\s*$|(?:\*\*)?(?P<name>\w+)(?:\*\*)?\s*[:>])\s*", re.I)
MARK_WEIGHT = 50.0


def marker_of(line: str) -> tuple[str, str]:
    """Role named by a marker at the start of the line ('' without one) and the rest of the line."""
    m = MARKER.match(line)
    if m:
        role = ROLE_OF.get((m["tag"] or m["box"] or m["head"] or m["name"]).lower())
        if role:
            return role, line[m.end() :]
    return "", line


def observe(text: str | None) -> list[tuple[tuple, str, bool]]:
    """Lines of a row: (features, text without marker, whether a speaker may change here)."""
    lines = (text or "").split("\n")
    out = []
    for i, line in enumerate(lines):
        mark, rest = marker_of(line)
        features = (
            ("mark", mark),
            ("length", len(rest).bit_length()),
            ("row", len(text or "").bit_length() if i == 0 else -1),
            ("lines", min(len(lines), 8) if i == 0 else -1),
            ("question", rest.rstrip().endswith("?")),
            ("list", bool(re.match(r"\s*(?:[-*+]|\d+[.)])\s", rest))),
            ("code", "```" in rest),
        )
        out.append((features, rest, i == 0 or bool(mark)))
    return out


class Model:
    """Log-probabilities over ``roles``."""

    def __init__(self, counts: Counter, roles: list[str]):
        self.roles = roles
        n = len(roles)
        start = np.array([counts["start", r] + 1.0 for r in roles])
        self.start = np.log(start / start.sum())
        turn = np.array([[counts["turn", a, b] + 1.0 for b in roles] for a in roles])
        self.turn = np.log(turn / turn.sum(axis=1, keepdims=True))
        stay = np.full((n, n), 1e-6)
        np.fill_diagonal(stay, 1.0)
        self.stay = np.log(stay / stay.sum(axis=1, keepdims=True))
        self.marked = np.log(np.full((n, n), 1.0 / n))
        kinds: dict[str, Counter] = defaultdict(Counter)
        for key, c in counts.items():
            if key[0] == "emit":
                kinds[key[1]][key[2], key[3]] += c
        self.emit: dict[str, dict] = {}
        self.unseen: dict[str, np.ndarray] = {}
        for kind in ("mark", "length", "row", "lines", "question", "list", "code"):
            seen = kinds[kind]
            values = {v for v, _ in seen}
            if kind == "mark":  # a marker names its own role; the weight stands for the rows that carry one
                for role in ALIASES:
                    values.add(role)
                    for r in roles:
                        seen[role, r] += MARK_WEIGHT if r == role else 1.0
            total = np.array([sum(c for (_, r), c in seen.items() if r == role) for role in roles]) + len(values) + 1
            self.emit[kind] = {v: np.log(np.array([seen[v, r] + 1.0 for r in roles]) / total) for v in values}
            self.unseen[kind] = np.log(1.0 / total)

    def emission(self, features) -> np.ndarray:
        return sum(self.emit[k].get(v, self.unseen[k]) for k, v in features)

    def step(self, first_of_row: bool, may_change: bool) -> np.ndarray:
        return self.turn if first_of_row else self.marked if may_change else self.stay


def _lines(rows):
    """Observed lines of consecutive rows: (row, line in row, features, rest, first of row, may change)."""
    for row, text in rows:
        for i, (features, rest, change) in enumerate(observe(text)):
            yield row, i, features, rest, i == 0, change


def transfer(model: Model, rows, at_start: bool) -> np.ndarray:
    """Best score of a part: [state before, last state] (all rows alike at the start of a conversation)."""
    n = len(model.roles)
    score = None
    for _, _, features, _, first, change in _lines(rows):
        e = model.emission(features)
        if score is None:
            score = (np.broadcast_to(model.start, (n, n)) if at_start else model.turn) + e
        else:
            score = (score[:, :, None] + model.step(first, change)[None]).max(axis=1) + e
    return score


def viterbi(model: Model, rows, before: int | None, last: int | None) -> list[tuple[int, int, str, int]]:
    """(row, line, text without marker, role) of each line, given the state before the part and its last state."""
    seen, back, score = [], [], None
    for row, i, features, rest, first, change in _lines(rows):
        e = model.emission(features)
        if score is None:
            score = (model.start if before is None else model.turn[before]) + e
        else:
            paths = score[:, None] + model.step(first, change)
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + e
        seen.append((row, i, rest))
    state = int(score.argmax()) if last is None else last
    states = [state]
    for b in reversed(back):
        state = int(b[state])
        states.append(state)
    return [(*s, r) for s, r in zip(seen, reversed(states), strict=True)]


def _conversations(table: pa.Table):
    """Conversations of a part in order: id, rows (index in the part, role, text)."""
    table = table.sort_by([("conv_id", "ascending"), ("turn", "ascending"), ("tie", "ascending")])
    out: dict = {}
    for i, (c, r, t) in enumerate(zip(*(table.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True)):
        out.setdefault(c, []).append((i, r, t))
    return table, out


def _counts(key, table):
    counts: Counter = Counter()
    _, conversations = _conversations(table)
    ends = []
    for c, rows in conversations.items():
        known = [(r, t) for _, r, t in rows if r]
        for r, t in known:
            for features, _, _ in observe(t):
                for k, v in features:
                    counts["emit", k, repr(v), r] += 1
        for (a, _), (b, _) in zip(known, known[1:], strict=False):
            counts["turn", a, b, ""] += 1
        if known:
            counts["start", known[0][0], "", ""] += 1
        ends.append((c, known[0][0] if known else "", known[-1][0] if known else ""))
    part = key[0].as_py()
    rows = [(*k, v, -1, "") for k, v in counts.items()]
    rows += [("end", a, b, "", 0, part, str(c)) for c, a, b in dict.fromkeys((ends[0], ends[-1]))] if ends else []
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(("a", "b", "c", "d", "n", "part", "conv"), [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string()], strict=True))})


def _value(kind: str, text: str):
    return text[1:-1] if text[:1] in "'\"" else text == "True" if text in ("True", "False") else int(text)


def chat_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, part, role, text, rendered``: the canonical turns of each row of ``turns`` (``conv_id, turn, role, text``).

    ``role`` of the input only trains the model (null: unknown; without any known role three default roles are taken); the
    role of the result is decoded from the texts.  A row becomes one turn, or several when markers inside it change the
    speaker.  Rows are ordered by turn (null first), ties by text; a null text is empty and keeps its row; repeated rows are
    kept; null conversations form one; other columns are not read.
    """
    spark = turns.sparkSession
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.lower(F.trim("role")).alias("role"), "text").withColumn("tie", F.xxhash64("text"))
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = rows.repartitionByRange(parts, "conv_id", "turn", "tie").withColumn("p", F.spark_partition_id().cast("long"))
    dealt = write_stage(dealt, "turns")
    found = dealt.groupBy("p").applyInArrow(_counts, "a string, b string, c string, d string, n long, part long, conv string")
    found = found.groupBy("a", "b", "c", "d", "part", "conv").agg(F.sum("n").alias("n")).collect()  # sums by feature, two ends a part
    counts: Counter = Counter()
    for r in found:
        if r.a == "emit":
            counts["emit", r.b, _value(r.b, r.c), r.d] += r.n
        elif r.a == "turn":
            counts["turn", r.b, r.c] += r.n
        elif r.a == "start":
            counts["start", r.b] += r.n
    ends = defaultdict(dict)
    for r in found:
        if r.a == "end":
            ends[r.part][r.conv] = (r.b, r.c)
    roles = sorted({k[1] for k in counts if k[0] == "start"} | {k[3] for k in counts if k[0] == "emit"}) or DEFAULT_ROLES
    order = sorted(ends)
    # A conversation that goes on in the next part: its second start is a turn.
    cut: list[tuple[int, int, str]] = []
    for p, q in zip(order, order[1:], strict=False):
        for conv in ends[p].keys() & ends[q].keys():
            cut.append((p, q, conv))
            (_, a), (b, _) = ends[p][conv], ends[q][conv]
            if a and b:
                counts["turn", a, b] += 1
                counts["start", b] -= 1
    model = Model(counts, roles)
    goes_on = {(p, c) for p, _, c in cut}
    comes_from = {(q, c) for _, q, c in cut}
    touched = goes_on | comes_from
    fixed: dict[tuple[int, str], tuple[int | None, int]] = {}
    if touched:
        named = F.concat_ws(" ", F.col("p").cast("string"), F.coalesce(F.col("conv_id").cast("string"), F.lit("None")))
        wanted = [f"{p} {c}" for p, c in touched]

        def matrices(key, table):
            p = key[0].as_py()
            _, conversations = _conversations(table)
            got = [(p, str(c), transfer(model, [(i, t) for i, _, t in rows], (p, str(c)) not in comes_from).ravel().tolist()) for c, rows in conversations.items()]
            return pa.table({"p": pa.array([g[0] for g in got], pa.int64()), "conv": pa.array([g[1] for g in got], pa.string()), "m": pa.array([g[2] for g in got], pa.list_(pa.float64()))})

        got = dealt.filter(named.isin(wanted)).groupBy("p").applyInArrow(matrices, "p long, conv string, m array<double>").collect()
        n = len(roles)
        chains = defaultdict(list)
        for r in got:
            chains[r.conv].append((r.p, np.array(r.m).reshape(n, n)))
        for conv, chain in chains.items():
            chain.sort(key=lambda x: x[0])
            score, back = None, []
            for p, m in chain:
                if (p, conv) in comes_from and score is not None:
                    paths = score[:, None] + m
                    back.append(paths.argmax(axis=0))
                    score = paths.max(axis=0)
                else:
                    back.append(None)
                    score = m[0]
            state = int(score.argmax())
            for (p, _), b in zip(reversed(chain), reversed(back), strict=True):
                before = None if b is None else int(b[state])
                fixed[p, conv] = before, state
                state = before if before is not None else state

    def decode(key, table):
        p = key[0].as_py()
        table, conversations = _conversations(table)
        ids, turn = table.column("conv_id"), table.column("turn")
        out = []
        for c, rows in conversations.items():
            before, last = fixed.get((p, str(c)), (None, None))
            at, number = None, 0
            for row, _, rest, role in viterbi(model, [(i, t) for i, _, t in rows], before, last):
                if at == (row, role):
                    out[-1][3].append(rest)
                else:
                    number = number + 1 if at is not None and at[0] == row else 0
                    out.append((row, number, roles[role], [rest]))
                    at = (row, role)
        where = pa.array([o[0] for o in out], pa.int64())
        texts = ["\n".join(o[3]).strip() for o in out]
        shown = [f"<|{o[2]}|>\n{t}\n<|end|>\n" for o, t in zip(out, texts, strict=True)]
        return pa.table({"conv_id": ids.take(where), "turn": turn.take(where), "part": pa.array([o[1] for o in out], pa.int64()), "role": pa.array([o[2] for o in out], pa.string()), "text": pa.array(texts, pa.string()), "rendered": pa.array(shown, pa.string())})

    kind = dict(dealt.dtypes)["conv_id"]
    return dealt.groupBy("p").applyInArrow(decode, f"conv_id {kind}, turn long, part long, role string, text string, rendered string")


@query("op6_chat_format")
def op6(spark, sf_dir):
    return chat_turns(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "part", "role", "rendered")
