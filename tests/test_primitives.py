"""Scans, containment, batches, budgets, vectors: small inputs against plain Python."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.functions.chunk_text import split_spans
from tracemill.operators import chunking, containment, context, retrieval
from tracemill.operators.scan import Running, Total, block_scan, position_block, ranked


def test_block_scan_equals_plain_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), i, rng.choice([None, rng.randint(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, pos bigint, v bigint")
    measures = [Running("s", "sum", "v"), Running("m", "max", "v"), Running("b", "sum", "v", before=True), Total("t", "min", "v")]
    got = {}
    for size in (4, 1000):
        out = block_scan(df, ["k"], ["pos"], position_block("pos", size), measures)
        got[size] = sorted((r["k"], r["pos"], r["s"], r["m"], r["b"], r["t"]) for r in out.collect())
    want = []
    for key in "ab":
        seen = []
        mine = [(p, v) for k, p, v in rows if k == key]
        low = min(v for _, v in mine if v is not None)
        for p, v in mine:
            before = [x for x in seen if x is not None]
            seen.append(v)
            upto = [x for x in seen if x is not None]
            want.append((key, p, sum(upto) if upto else None, max(upto) if upto else None, sum(before) if before else None, low))
    assert got[4] == got[1000] == sorted(want)


def test_ranked(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("p"))
    out = ranked(df, ["k"], ["p"], position_block("p", 7), "n").collect()
    assert all(r["n"] == r["p"] // 3 + 1 for r in out)


def test_containment_with_one_and_many_automata(spark, monkeypatch):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abc dé\U0001f600") for _ in range(30))) for i in range(60)] + [(60, None), (61, "")]
    needles = [("ab",), ("a",), ("bc d",), ("déa",), ("cab",), ("zz",), ("",), (None,), ("\U0001f600a",), ("ab",)]
    t, n = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(needles, "needle string")
    want = sorted((i, x) for i, s in texts for (x,) in needles if s and x and x in s)
    for size, few in ((8 << 20, 2000), (1, 2000), (1, 2)):
        monkeypatch.setattr(containment, "AUTOMATON_BYTES", size)
        monkeypatch.setattr(containment, "FEW_NEEDLES", few)
        assert sorted((r["id"], r["needle"]) for r in containment.contains_join(t, "text", n, "needle").collect()) == want
    upper = spark.createDataFrame([("DÉ",)], "needle string")
    assert containment.contains_join(t, "text", upper, "needle", ignore_case=True).count() == sum("dé" in (s or "") for _, s in texts)
    assert containment.contains_join(t, "text", upper.limit(0), "needle").count() == 0


def test_a_hundred_thousand_needles(spark):
    rng = random.Random(4)
    needles = {f"{rng.randrange(10**7):07d}" for _ in range(100_000)}
    texts = [(i, "".join(rng.choice("0123456789") for _ in range(400))) for i in range(300)]
    hits = containment.contains_join(
        spark.createDataFrame(texts, "id int, text string"), "text", spark.createDataFrame([(x,) for x in needles], "needle string"), "needle"
    )
    want = sorted((i, s[k : k + 7]) for i, s in texts for k in {s[j : j + 7]: j for j in range(394)}.values() if s[k : k + 7] in needles)
    assert sorted((r["id"], r["needle"]) for r in hits.collect()) == want
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and len(want) > 500


def test_split_spans():
    assert split_spans("", 10, 2) == []
    assert split_spans("un deux trois", 7, 0) == ["un deux", "trois"]
    assert split_spans("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert split_spans("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]
    assert split_spans("p1\n\np2 longue\n\np3", 9, 0) == ["p1", "p2", "longue", "p3"]
    text = " ".join(f"mot{i}" for i in range(400)) + "\n\n" + "x" * 300
    pieces = split_spans(text, 100, 20)
    assert all(0 < len(p) <= 100 for p in pieces)
    assert all(f"mot{i}" in " ".join(pieces) for i in range(400))


@pytest.mark.parametrize("block", [5, 12, 1000])
def test_plan_batches(spark, block):
    rng = random.Random(block)
    rows = [(j, i, rng.choice([1, 3, 9, 40])) for j, n in (("a", 83), ("b", 4), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "job string, position bigint, tokens bigint")
    got = {(r["job"], r["position"]): r["batch_no"] for r in chunking.plan_batches(df, max_items=5, max_tokens=30, block=block).collect()}
    want = {}
    for job in "abc":
        no, held, used = 0, 0, 0
        for j, i, t in rows:
            if j == job:
                if held and (held >= 5 or used + t > 30):
                    no, held, used = no + 1, 0, 0
                held, used = held + 1, used + t
                want[(j, i)] = no
    assert got == want


def test_number_chunks_and_bridge(spark):
    pages = spark.createDataFrame([("h", 1, "un"), ("h", 2, " "), ("h", 4, "deux" * 100), ("g", 9, "seul")], "file_hash string, page bigint, text string")
    for block in (1, 100):
        rows = {(r["file_hash"], r["page_label"]): r["text"] for r in chunking.bridge_pages(pages, block=block).collect()}
        assert set(rows) == {("h", "1-4"), ("h", "4"), ("g", "9")}
        assert rows[("h", "1-4")] == "--- Page 1 ---\nun\n\n--- Début page suivante (contexte) ---\n" + ("deux" * 100)[:300]
        out = chunking.chunk_pages(pages, size=120, overlap=10, block=block).collect()
        mine = sorted(r["chunk_index"] for r in out if r["file_hash"] == "h")
        assert mine == list(range(len(mine))) and len(mine) > 4


@pytest.mark.parametrize("seed", [1, 2])
def test_select_blocks(spark, seed):
    rng = random.Random(seed)
    rows = [(f, i, rng.randint(0, 2), rng.choice([50, 90, 90, 400, 1500])) for f in "ab" for i in range(1, 80)]
    df = spark.createDataFrame(rows, "file_id string, block_no bigint, block_class int, size bigint")
    got = {(r["file_id"], r["block_no"]) for r in context.select_blocks(df, 1000, block=9).collect()}
    want = set()
    for f in "ab":
        used, taken = 0, 0
        for _, no, _, size in sorted((r for r in rows if r[0] == f), key=lambda r: (r[2], r[1])):
            fits = used + size + 4 <= 1000
            if fits or not taken:
                want.add((f, no))
                used, taken = used + size + 4, taken + 1
                if not fits:
                    break
    assert got == want


def test_vector_paths_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    v = lambda n: [(i, [float(x) for x in rng.normal(size=6)], int(i % 3)) for i in range(n)]
    queries = spark.createDataFrame(v(9), "query_id int, vector array<double>, label int")
    stored = spark.createDataFrame(v(50), "chunk_id int, embedding array<double>, label int").repartition(4)
    plain = {(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieval.vector_topk(queries, stored, 4, match=("label",)).collect()}
    monkeypatch.setattr(retrieval, "TASK_QUERIES", 4)
    monkeypatch.setattr(retrieval, "BLOCK_CHUNKS", 15)
    blocked = {(r["query_id"], r["chunk_id"], r["rank"]) for r in retrieval.vector_topk(queries, stored, 4, match=("label",)).collect()}
    assert plain == blocked and len(plain) == 36


def test_spec_score_against_all_pairs(spark):
    rng = random.Random(5)
    parts = ["card", "limit", "check", "issuer", "bank", "refus", "load", "of", "é"]
    join = lambda n, sep: sep.join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    specs = [("CheckCard", "card limit", "NOK", 1), ("LoadIssuer", "issuer bank card", "refus", 2), ("Other", None, "", 3), ("", "card", "x", 4), (None, "issuer check", "bank", 5)]
    specs += [(join(3, ""), join(4, " "), join(2, " "), n) for n in range(6, 120)]
    queries = [(i, q) for i, q in enumerate(["check card limit", "CheckCard", "issuer", "zzz", "bank refus card", "card card card card", "", None])]
    queries += [(i, join(6, " ")) for i in range(10, 60)]
    want = set()
    for i, q in queries:
        scored = []
        for row in specs:
            name, text, exc = (None if x is None else x.lower() for x in row[:3])
            words = [w for w in re.findall(r"\w+", (q or "").lower()) if len(w) > 2]
            score = sum(10 * (name is not None and w in name) + 3 * (text is not None and w in text) + 2 * (exc is not None and w in exc) for w in words)
            score += 20 * (q is not None and name is not None and name in q.lower())
            if score >= 8:
                scored.append((-score, row[3], row[0]))
        want |= {(i, f, -s, rank) for rank, (s, _, f) in enumerate(sorted(scored, key=lambda x: x[:2])[:4], 1)}
    out = retrieval.spec_score_topk(spark.createDataFrame(queries, "query_id int, query string"), spark.createDataFrame(specs, "function string, description string, exception string, spec_no bigint"))
    one = {(r["query_id"], r["function"], r["score"], r["rank"]) for r in out.collect()}
    assert one == want
    assert (1, "CheckCard", 30) in {x[:3] for x in one} and (3, "", 20) in {x[:3] for x in one}
