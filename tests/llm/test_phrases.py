"""Phrase mining against counting everything."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from tracemill.llm import phrase_mining as M


def expected(rows, least, top):
    out = []
    by_lang = defaultdict(list)
    for lang, text in rows:
        by_lang["und" if lang is None else lang].append(text or "")
    for lang, texts in by_lang.items():
        f = Counter()
        for text in texts:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            for piece in re.split("[.,;:!?\x0a-\x0d]", low):
                w = re.findall("[^\x20\x09]+", piece)
                f.update(tuple(w[i : i + n]) for n in range(1, 5) for i in range(len(w) - n + 1))
        total = sum(v for k, v in f.items() if len(k) == 1)
        cands = {k: v for k, v in f.items() if len(k) > 1 and v >= least}
        inside = defaultdict(int)
        for k, v in cands.items():
            for n in range(2, len(k)):
                for i in range(len(k) - n + 1):
                    inside[k[i : i + n]] = max(inside[k[i : i + n]], v)
        found = []
        for k, a in cands.items():
            if 100 * inside[k] < 80 * a or not inside[k]:
                s, j = min((2000000 * a // (f[k[:j]] + f[k[j:]]), j) for j in range(1, len(k)))
                found.append((-s, -a, " ".join(k).encode(), f[k[:j]], f[k[j:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total, -s))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "x\x0c", "Ab", "\x00", "日本"]
    fixed = ["new york city hall", "Ab w1 w2", "É x\x0cy", "w3 w4 w5 w6 w7"]
    rows = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary[: 4 + i % 13]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "fr", None, "und", ""]), "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words)))
    return [*rows, ("en", None), (None, ""), *rows[:5]]


@pytest.mark.parametrize(("least", "top", "first", "held"), [(3, 2000, 2, 10**6), (2, 6, 1, 10), (2, 3, 1, 50)])
def test_equals_counting(spark, monkeypatch, least, top, first, held):
    """Small ``top`` and ``first`` make frontiers grow over several rounds; small ``held`` makes tasks send early."""
    for name, value in (("LEAST", least), ("TOP", top), ("FIRST", first), ("HELD", held), ("BITS", 12)):
        monkeypatch.setattr(M, name, value)
    rows = corpus(least, 60)
    docs = spark.createDataFrame([(*r, 1, 1) for r in rows], "lang string, text string, k1 int, score int").repartition(3)
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in M.collocations(docs).collect()]
    assert sorted(got) == expected(rows, least, top)


def test_sql_says_the_same(spark):
    rows = corpus(9, 400)
    documents = spark.createDataFrame(rows, "lang string, text string").toPandas()
    sql = duckdb.connect()
    sql.register("documents", documents)
    assert sorted(sql.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({M.SQL})").fetchall()) == expected(rows, M.LEAST, M.TOP)


def test_odd_and_empty(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    got = [(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in M.collocations(odd_docs).collect()]
    assert sorted(got) == expected(rows, M.LEAST, M.TOP)
    assert M.collocations(no_docs).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(3 * 10**13, 7 * 10**13)], "a long, s long").select(M.score(M.F.col("a"), M.F.col("s")).alias("v"))
    assert rows.first().v == 2_000_000 * 3 * 10**13 // (7 * 10**13)
