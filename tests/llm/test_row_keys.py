"""Repeated and null ids: every row is a document of its own."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.conftest import words
from tracemill.llm import decontaminate, minhash, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    return [". ".join(" ".join(words(rng, 12)) for _ in range(6)) + "." for _ in range(12)]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def _rows(texts):
    a, b, c, d, e, f, g, h, *_ = texts
    # twice the same row; one id with two texts; null ids, two of them copies; b is also named by the larger id 9
    return [(1, a), (1, a), (2, b), (2, c), (None, d), (None, d), (None, e), (9, b), (5, f), (5, g), (6, h)]


def test_run_with_repeated_and_null_ids(spark, tmp_path, texts):
    """One row of each set of copies stays, whole; the leaking row goes, not the others of its id."""
    rows = _rows(texts)
    _docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, texts[6]), (2, texts[4])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    good = corpus_pipeline.quality(spark, _docs(spark, rows), str(tmp_path)).collect()
    assert len(good) == len(rows)
    want = {}
    for i, t in rows:  # brute force: of equal texts the smallest id, null last
        if t in (texts[6], texts[4]):
            continue
        want[t] = i if t not in want or (want[t] is None) or (i is not None and i < want[t]) else want[t]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(want.values())
    assert sum(r["doc_id"] is None for r in got) == 1


def test_cut_keeps_the_first_of_equal_rows(spark, texts):
    rows = _rows(texts)
    got = Counter((r["doc_id"], r["text"]) for r in suffix_dedup.cut_repeats(_docs(spark, rows)).collect())
    left = [r for i, r in enumerate(rows) if r not in rows[:i] and r != (9, texts[1])]
    assert got == Counter(left)


def test_bytes_with_repeated_and_null_ids(spark, texts):
    rows = _rows(texts)
    out = suffix_dedup.suffix_dedup(_docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    gone = Counter((r["doc_id"], r["n_removed"] == r["n_bytes"]) for r in out)
    assert all(r["n_removed"] in (0, r["n_bytes"]) for r in out)
    assert gone == Counter({(1, False): 1, (1, True): 1, (2, False): 2, (None, False): 2, (None, True): 1, (9, True): 1, (5, False): 2, (6, False): 1})


def test_leaks_by_row_in_several_blocks(spark, texts, monkeypatch):
    rows = _rows(texts)
    bench = spark.createDataFrame([(i, texts[i]) for i in (2, 4, 8, 9, 10, 11)], "item_id int, text string")
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    one = Counter(map(str, decontaminate.decontaminate(_docs(spark, rows), bench).select(columns).collect()))
    kept = Counter((r["doc_id"], r["text"]) for r in decontaminate.keep_clean(_docs(spark, rows), bench).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert Counter(map(str, decontaminate.decontaminate(_docs(spark, rows), bench).select(columns).collect())) == one and sum(one.values()) == len(rows)
    assert kept == Counter(r for r in rows if r[1] not in (texts[2], texts[4]))


def test_classes_of_rows_with_null_and_repeated_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (None, ""), (4, "c d e")]
    out = minhash.minhash_dedup(_docs(spark, rows)).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["class_id"], []).append((r["doc_id"], r["kept"]))
    members = sorted(sorted(str(d) for d, _ in g) for g in groups.values())
    assert members == [["1", "2"], ["1", "3", "None"], ["4"], ["None"]]
    assert all(sum(k for _, k in g) == 1 for g in groups.values())
