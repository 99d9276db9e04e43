"""Conversation repair against an exhaustive search over edits."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from tracemill.llm import conversation_repair as C

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def search(rows):
    """Cheapest edits, least letters first, by uniform-cost search over (cost, letters, rows read, roles so far)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, kept = heapq.heappop(queue)
        if (i, last) in seen:
            continue
        if i == len(rows) and last in ("", "a"):
            return cost, audit, kept
        seen.add((i, last))
        nexts = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        for r in nexts.replace("s", ""):
            heapq.heappush(queue, (cost + 2, audit + "I", i, r, (*kept, ({"u": "user", "a": "assistant"}[r], ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, last, kept))
            if fault not in ("blank", "duplicate"):
                more = cost + (fault == "truncated")
                if role[:1] and role[:1] in nexts:
                    heapq.heappush(queue, (more, audit + "K", i + 1, role[:1], (*kept, (role, text))))
                for r in nexts.replace("s", ""):
                    heapq.heappush(queue, (more + 2, audit + "R", i + 1, r, (*kept, ({"u": "user", "a": "assistant"}[r], text))))


def expected(table):
    out, groups = {}, defaultdict(list)
    for conv, turn, role, text in table:
        groups[conv].append((turn, " " if role is None else role, " " if text is None else text))
    for conv, all_rows in groups.items():
        rows = []
        for turn, role, text in all_rows:
            which = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if which == 0:
                continue
            text = "" if which == 1 else re.sub("[.!?]", "", text) if which == 2 else text
            rows += [(turn, "user" if which == 4 else role, text)] * (2 if which == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in rows if t is not None]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(marked, marked[1:])]
        cost, audit, kept = search(marked)
        body = "\n".join(f"{r}:{t}" for r, t in kept)
        assert LEGAL.match("".join(r[:1] for r, _ in kept))
        counts = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(body.encode()).hexdigest())
    return out


def table(rng, convs, most):
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, most)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "User", "", None, "ux"])
            text = rng.choice(["hi.", "ok", "why? \n", " \t", "", None, f"{rng.random()}!", f"{rng.random()}", "a ", ".\x0b"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 2]), role, text))
    rows += rng.sample(rows, 5)
    rng.shuffle(rows)
    return rows


def run(spark, rows, tmp_path):
    schema = "conv_id long, turn long, role string, text string, pos int, kind int, symbols string"
    spark.createDataFrame([(*r, 1, 1, "x") for r in rows], schema).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: tuple(r)[1:] for r in C.op12(spark, str(tmp_path)).collect()}


@pytest.mark.parametrize("block", [1, 3, C.LEAST_BLOCK])
def test_equals_search(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(C, "LEAST_BLOCK", block)
    rows = table(random.Random(block), 60, 12)
    assert run(spark, rows, tmp_path) == expected(rows)


def test_long_conversation(spark, tmp_path):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randrange(900)}" + rng.choice(".a")) for t in range(3000)] + [(2, 0, "user", "x " * 200_000)]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_everything_dropped_and_empty(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = run(spark, [(gone, 0, "user", "x.")], tmp_path)
    assert got == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert run(spark, [], tmp_path) == {}


def test_edits_are_the_repaired_conversation(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "And you"), (1, 2, "user", "And you"), (1, 3, "user", "Fine!")]
    edits = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(e.edit, e.role, e.text, e.fault) for e in edits] == [
        ("", None, None, None), ("I", "user", "", None), ("K", "assistant", "Hello.", ""), ("K", "user", "And you", "truncated"),
        ("D", None, None, "duplicate"), ("R", "assistant", "Fine!", ""),
    ]
