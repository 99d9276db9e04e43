"""Languages of whole texts as mixtures: n-gram likelihoods, expectation-maximisation, a penalised choice of the set.

Trigrams of bytes (letters lower-cased, everything else one blank) are hashed into ``GRAMS`` bins; their counts per language
come from all training rows by partial aggregation, so the model is a table of ``GRAMS`` numbers per language.  A text is cut
into stretches of ``STRETCH`` trigrams.  Expectation-maximisation over the stretches estimates each language's share; among
the sets of the 1, 2, 3, ... strongest languages, up to all, the one with the best likelihood less a penalty per language is
chosen.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import query, read
from tracemill.llm.decontaminate import LOWER
from tracemill.llm.scan import Chunk, chunks

GRAMS = 1 << 16
STRETCH = 24
ROUNDS = 8
PENALTY = 4.0

LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
BLANKED = np.where(LETTER[LOWER], LOWER, 32).astype(np.uint32)


def trigrams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bin of each trigram whose middle is a letter."""
    if len(chunk.data) < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = np.full(len(chunk.data) + 2, 32, np.uint32)
    b[1:-1] = BLANKED[chunk.data]
    before, after = b[:-2].copy(), b[2:].copy()
    full = chunk.ends > chunk.starts
    before[chunk.starts[full]] = 32  # texts do not see each other
    after[chunk.ends[full] - 1] = 32
    code = (before << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | after
    at = np.flatnonzero(b[1:-1] != 32)
    bins = ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
    return chunk.owner(at), bins


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities (GRAMS, languages) from ``text, lang``."""

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for chunk in chunks(batches):
            owner, bins = trigrams(chunk)
            names, code = np.unique(np.array(chunk.batch.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            made = np.bincount(code[owner] * GRAMS + bins, minlength=len(names) * GRAMS).reshape(len(names), GRAMS)
            for name, row in zip(names, made, strict=True):
                total[name] = total.get(name, 0) + row
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at].astype(np.int64))], ["lang", "gram", "n"])

    grams = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(grams.lang.unique())
    table = np.full((GRAMS, len(langs)), 0.5)
    np.add.at(table, (grams.gram.to_numpy(), grams.lang.map({x: i for i, x in enumerate(langs)}).to_numpy(int)), grams.n.to_numpy())
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def mixtures(owner: np.ndarray, bins: np.ndarray, n: int, model: np.ndarray):
    """Per text: shares of the chosen set (n, languages), zero outside it; and the certainty of the strongest language."""
    width = model.shape[1]
    count = np.bincount(owner, minlength=n)
    first = np.cumsum(count) - count
    new = (np.arange(len(owner)) - first[owner]) % STRETCH == 0
    starts = np.flatnonzero(new)
    text = owner[starts]
    like = np.add.reduceat(model[bins], starts, axis=0).astype(float) if len(starts) else np.zeros((0, width))
    total = np.stack([np.bincount(text, like[:, j], n) for j in range(width)], axis=1)
    top = like.max(axis=1, keepdims=True) if len(like) else like
    like = np.exp(like - top)
    parts = np.maximum(np.bincount(text, minlength=n), 1)[:, None]

    def step(share):
        weighed = share[text] * like
        weighed /= weighed.sum(axis=1, keepdims=True)
        return np.stack([np.bincount(text, weighed[:, j], n) for j in range(width)], axis=1) / parts

    share = np.full((n, width), 1 / width)
    for _ in range(ROUNDS):
        share = np.maximum(step(share), 1e-12)
    order = np.argsort(-share, axis=1, kind="stable")
    # With one language the strongest is that of the whole text.
    best = np.argmax(total, axis=1)
    chosen, value = np.zeros((n, width)), np.full(n, -np.inf)
    for k in range(1, width + 1):
        inside = np.zeros((n, width))
        if k == 1:
            inside[np.arange(n), best] = 1
        else:
            np.put_along_axis(inside, order[:, :k], np.take_along_axis(share, order[:, :k], axis=1), axis=1)
            inside /= inside.sum(axis=1, keepdims=True)
        seen = (inside[text] * like).sum(axis=1)
        fit = np.bincount(text, np.log(np.maximum(seen, 1e-300)), n) - PENALTY * k * np.log1p(parts[:, 0])
        better = fit > value
        chosen[better], value[better] = inside[better], fit[better]
    posterior = np.exp(total - total.max(axis=1, keepdims=True)) if width else total
    posterior = posterior.max(axis=1) / posterior.sum(axis=1)
    certain = np.where((chosen > 0).sum(axis=1) == 1, posterior, chosen.max(axis=1))
    return chosen, certain


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """``doc_id, lang_pred, score, langs, shares`` per row of ``docs``, from ``text`` alone.

    A null text, one without a letter, or an empty model gives ``und`` with score 0 and no languages.  Ties go to the
    language that sorts first.  Repeated ids get one row each; other columns are not read.
    """

    def run(batches):
        for chunk in chunks(batches):
            owner, bins = trigrams(chunk)
            known = np.bincount(owner, minlength=chunk.n) > 0
            if langs:
                share, certain = mixtures(owner, bins, chunk.n, model)
                # Bytes beyond ASCII may be no letters: such texts are looked at by character.
                ascii_letter = np.concatenate([[0], np.cumsum(LETTER[LOWER[chunk.data]] & (chunk.data < 128))])
                doubtful = np.flatnonzero(known & (ascii_letter[chunk.ends] == ascii_letter[chunk.starts]))
                for i in doubtful:
                    known[i] = any(c.isalpha() for c in chunk.data[chunk.starts[i] : chunk.ends[i]].tobytes().decode("utf-8", "replace"))
            else:
                share, certain, known = np.zeros((chunk.n, 0)), np.zeros(chunk.n), np.zeros(chunk.n, bool)
            found = [[(langs[j], float(share[i, j])) for j in np.argsort(-share[i], kind="stable") if share[i, j] > 0] if known[i] else [] for i in range(chunk.n)]
            yield pa.RecordBatch.from_arrays(
                [
                    chunk.batch.column("doc_id"),
                    pa.array([f[0][0] if f else "und" for f in found], pa.string()),
                    pa.array(np.where(known, certain, 0.0)),
                    pa.array([[x for x, _ in f] for f in found], pa.list_(pa.string())),
                    pa.array([[x for _, x in f] for f in found], pa.list_(pa.float64())),
                ],
                ["doc_id", "lang_pred", "score", "langs", "shares"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, langs array<string>, shares array<double>")


@query("op5_language_id")
def op5(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    langs, model = train(docs.filter((remainder("doc_id", 5) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang"))
    found = identify(docs, langs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", F.concat_ws(",", "langs").alias("languages"))
