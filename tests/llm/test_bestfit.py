"""Best-fit packing against plain tokenising and a sequential best fit."""

import random
import zlib

import numpy as np
import pytest

from tracemill.llm import bestfit_packing as B


def expected(rows, capacity):
    from tokenizers import Tokenizer

    known, out = Tokenizer.from_file(B.vocabulary()), []
    for doc, text in rows:
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out += [(doc, i // capacity, i, len(ids[i : i + capacity]), zlib.crc32(ids[i : i + capacity].tobytes())) for i in range(0, len(ids), capacity)]
    return sorted(out, key=str)


def check(df, capacity):
    rows = df.collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert all(e <= capacity for e in ends.values())
    return sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str), len(ends), sum(r.length for r in rows)


def decreasing(sizes, capacity):
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [(f, i) for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits)[1]] -= s
        else:
            free.append(capacity - s)
    return len(free)


def test_odd_documents(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got, bins, tokens = check(B.pack_best_fit(odd_docs, B.vocabulary(), 512), 512)
    assert got == expected(rows, 512)
    assert bins == -(-tokens // 512)
    assert B.pack_best_fit(no_docs, B.vocabulary()).count() == 0


def test_words_at_a_time(spark):
    texts = ["It's a DOG'S life... isn't it?", "Å ≠ x.̸ <|endoftext|> <|ENDOFTEXT|>.", "a\x0bb\x85c d,e ;f!! \x1c", "K.! don't.\r\n\tWE'LL", "J̌.", "ΑΣ. ΣΑΣ", "1,000.5 Ünïcödé. 日本。"]
    docs = spark.createDataFrame([(None if i == 2 else 7, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got, *_ = check(B.pack_best_fit(docs, B.vocabulary(), 8), 8)
    assert got == expected([(None if i == 2 else 7, t) for i, t in enumerate(texts)], 8)


@pytest.mark.parametrize("range_rows", [10**6, 60])
def test_as_few_as_sequential_best_fit(spark, range_rows):
    rng = random.Random(range_rows)
    sizes = [min(100, int(rng.lognormvariate(3, 1)) + 1) for _ in range(500)] + [33] * 50 + [50] * 51 + [100] * 3
    items = spark.createDataFrame(list(enumerate(sizes)), "key long, size long")
    rows = B.best_fit(items, 100, range_rows).collect()
    assert sorted(r.key for r in rows) == list(range(len(sizes)))
    ends = {}
    for r in sorted(rows, key=lambda r: (r.bin, r.offset)):
        assert r.offset == ends.get(r.bin, 0)
        ends[r.bin] = r.offset + sizes[r.key]
    assert max(ends.values()) <= 100
    assert len(ends) <= decreasing(sizes, 100) * (1.01 if range_rows > 1000 else 1.03)


def test_sweep_takes_the_smallest_gap_that_holds():
    size = np.array([9, 8, 7, 5, 5, 4, 3, 3])
    is_doc = np.array([False, True, False, False, True, True, True, False])
    placed, gap, before, free = B.sweep(size, is_doc)
    # 8 into 9; 5 into 5; 4 into 7, which has 3 left; 3 into one of the gaps of 3
    assert list(zip(placed, before)) == [(1, 9), (4, 5), (5, 7), (6, 3)]
    assert gap[0] == 0 and gap[1] == 3 and gap[2] == 2 and sum(free) == 1 + 0 + 3


def test_chain_prefers_the_nearest_larger_range():
    assert B.chain({0: (2, 3), 1: (1, 1), 2: (3, 0)}) == [(1, 0, 0, 2, 1), (2, 0, 1, 0, 1), (2, 1, 0, 1, 2)]
