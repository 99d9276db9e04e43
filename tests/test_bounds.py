"""Memory and work that must not grow with the input or with a row."""

import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from tracemill.functions import payload as pl
from tracemill.functions.chunk_text import split_spans
from tracemill.operators import chunking as ck
from tracemill.operators import containment as ct
from tracemill.operators import transactions as tr
from tracemill.session import stage


def test_windows_hold_no_part_per_character(spark, monkeypatch):
    text = "abcdefghij" * 30_000
    tracemalloc.start()
    pieces = split_spans(text, 800, 100, ("",))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pieces == [text[i : i + 800] for i in range(0, len(text) - 100, 700)]
    assert peak < 4 * len(text)

    monkeypatch.setattr(ck, "SPLIT_CHARS", 10)  # the rows of one batch leave in several
    rows = [(1, "aaaa bbbb cccc"), (None, None), (3, ""), (4, "dd"), (5, "eeee ffff")]
    split = ck.split_text(spark.createDataFrame(rows, "n bigint, text string").coalesce(1), size=5, overlap=0, separators=(" ", ""))
    assert [(r["n"], r["pieces"]) for r in split.collect()] == [(1, ["aaaa", "bbbb", "cccc"]), (None, []), (3, []), (4, ["dd"]), (5, ["eeee", "ffff"])]


def test_items_beyond_the_cut_are_not_written(spark, monkeypatch):
    spaced = pl.spaced_json
    monkeypatch.setattr(pl, "spaced_json", lambda c: F.when(F.contains(c, F.lit("far")), F.raise_error(F.lit("written"))).otherwise(spaced(c)))
    rows = ['[{"b":1,"a":[1,2]}, 1E2, "longer, than: it", 7, "far"]', "[]", "[1] x]", '{"a":1}', "[1,2", None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    cut = [r[0] for r in df.orderBy("i").select(pl.cut_json_array("t", F.lit(30))).collect()]
    assert cut == ['[{"a": [1, 2], "b": 1}, 100]', "[]", "[1]", None, None, None]


def test_one_automaton_in_a_worker(spark, monkeypatch):
    words = [f"{a}{b}word{c}" for a in "abc" for b in "xyz" for c in range(4)]
    texts = spark.createDataFrame([(i, f"{w} and {words[-1]}") for i, w in enumerate(words)] + [(99, None)], "i int, t string")
    needles = spark.createDataFrame([(w,) for w in words], "needle string")
    whole = sorted((r["i"], r["needle"]) for r in ct.contains_join(texts, "t", needles, "needle").collect())
    monkeypatch.setattr(ct, "AUTOMATON_BYTES", 1500)
    lists = ct.needle_lists(needles)
    assert len(lists) > 4 and [w for n in lists for w in n.held.value.to_pylist()] == sorted(words)
    assert sorted((r["i"], r["needle"]) for r in ct.contains_join(texts, "t", needles, "needle").collect()) == whole

    def walk(batches):
        for batch in batches:
            for needles_part in lists:
                ct._automaton(needles_part)
                yield pa.RecordBatch.from_pydict({"held": [len(ct._BUILT)]})

    assert {r["held"] for r in texts.select("i").mapInArrow(walk, "held bigint").collect()} == {1}
    found = texts.coalesce(1).select("i", ct.contained(F.col("t"), lists).alias("f")).collect()
    assert all(r["f"] == sorted({words[r["i"]], words[-1]}) for r in found if r["i"] < 99)
    assert [r["f"] for r in found if r["i"] == 99] == [None]


def test_segments_of_all_lines_are_not_broadcast(spark):
    lines = stage(spark.range(40).selectExpr("'F' AS file_id", "id AS line_no", "id DIV 7 AS seg"), "lines")
    rows = lines.filter("line_no % 3 = 0").select("file_id", "line_no").unionByName(lines.filter("line_no = 3").select("file_id", "line_no"))
    moved = tr.in_segments(rows, lines)
    assert sorted((r["line_no"], r["seg"]) for r in moved.collect()) == sorted([(i, i // 7) for i in range(0, 40, 3)] + [(3, 0)])
    assert "Broadcast" not in moved._jdf.queryExecution().executedPlan().toString()
