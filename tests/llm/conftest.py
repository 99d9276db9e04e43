import random

import pytest

#: Columns whose names the operators use inside; each holds 1.
CLASHES = "g _g key c kept _kept _hit bucket shard rank first host ref lead _statistics".split()


def words(rng, n):
    syllables = "ba be bi bo bu da de di do du ka ke ki ko ku la le li lo lu".split()
    return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty, blank, very long, repeated and unusual texts, with extra columns."""
    rng = random.Random(3)
    long = " ".join(words(rng, 60_000))
    texts = [None, "", "  \n\t ", "x", long, long, "one two three", "é" * 500 + "日本語 ünïcödé \u0000 end", "a\n" * 300, "The The " * 400, " ".join(words(rng, 80)), None]
    rows = [(i, t, None if i % 5 == 0 else "en" if i % 2 else "fr", "s", None if t is None else len(t), *[1] * len(CLASHES)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHES))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def corpus(spark):
    """Random texts with exact and near copies and shared passages."""
    rng = random.Random(11)
    passage = " ".join(words(rng, 40))
    texts = []
    for i in range(60):
        w = words(rng, rng.randint(3, 150))
        if i % 4 == 0:
            w[1:1] = passage.split()
        if i % 7 == 3 and texts:
            w = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
        texts.append(" ".join(w))
    return spark.createDataFrame([(i * 3 + 1, t, rng.choice(["en", "fr"]), "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
