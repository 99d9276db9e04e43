"""Collocations by best-first growth of phrases under bounds from prefix counts.

A phrase of 2 to 4 words with the count ``a`` scores ``floor(2000000 a / (l + r))``, ``l`` and ``r`` being the counts of its two
parts at the worst cut.  All extensions of a prefix ``p`` occur at most ``f(p)`` times, their first word ``f(w)`` times and the
rest at least as often as the extension: none scores more than ``floor(2000000 f(p) / (f(w) + f(p)))``.

Per language a threshold starts at the score of the 4000th pair of words.  Only prefixes whose bound reaches it are grown, and
phrases that reach it themselves are grown to both sides, for a longer phrase can drop them.  If 2000 phrases survive at or
above the threshold, all that could still outrank or equal them are known and the language is settled; otherwise its
threshold falls and its frontier grows, down to nothing left to grow.

Each growth is one pass over the corpus: tasks read texts as bytes, count within a bounded table and send what passes the
frontier, which reaches them as bit tables of a fixed size (they let some others through, whose counts are then as exact).
Sums are made by Spark.  Words are known by 64-bit fingerprints that include the language: two of ``v`` distinct words collide
with a probability of about ``v * v / 4e19``, one in four million for three million words.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import query, read, write_stage
from tracemill.llm.scan import CODES, MULTIPLIER, Chunk, Prefix, chunks, mix
from tracemill.session import spread

LEAST, TOP, LONGEST = 30, 2000, 4
#: A shorter phrase goes if a longer one around it has this share of its count, in percent.
COVERED = 80
#: Pairs per language that set the first threshold, as a multiple of ``TOP``; each further round takes four times as many.
FIRST = 2
#: Bits of a frontier table.
BITS = 26
#: Distinct phrases that a task counts before it sends them on.
HELD = 400_000

DELIMITER = np.zeros(256, bool)
DELIMITER[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
WORD = ~DELIMITER
WORD[list(b" \t")] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
FOLDED = CODES[0][LOWER]


def language_code(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Words:
    """Words of a chunk in order: fingerprint, place, text and whether the next word follows in the same piece."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.owner, self.starts, self.ends = chunk.runs(WORD)
        langs = chunk.batch.column("lang").dictionary_encode()
        self.langs, which = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        codes = np.array([language_code(v) for v in self.langs], np.uint64)
        self.lang = which[self.owner]
        self.keys = mix(Prefix(FOLDED[chunk.data]).span(self.starts, self.ends) + codes[self.lang]) if len(self.owner) else np.zeros(0, np.uint64)
        passed = np.cumsum(DELIMITER[chunk.data])[self.starts] if len(self.owner) else self.owner
        self.linked = (self.owner[1:] == self.owner[:-1]) & (passed[1:] == passed[:-1])

    def phrases(self, n: int) -> np.ndarray:
        """Positions where ``n`` words follow each other in one piece."""
        last = len(self.keys) - n + 1
        return np.flatnonzero(reduce(np.logical_and, [self.linked[i : i + last] for i in range(n - 1)])) if last > 0 else np.zeros(0, np.int64)

    def columns(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        return [self.keys[at + i] for i in range(n)]


def joint(keys: list[np.ndarray]) -> np.ndarray:
    """One 64-bit number for each row of word keys."""
    with np.errstate(over="ignore"):
        return reduce(lambda h, k: mix(h * np.uint64(MULTIPLIER) + k), keys)


class Bits:
    """A set of phrases as a bit table: says yes for all of them and for few others."""

    def __init__(self, phrases: DataFrame, names: list[str]):
        self.shift = shift = np.uint64(64 - BITS)

        def positions(batches):
            for b in batches:
                at = joint([b.column(n).to_numpy().view(np.uint64) for n in names]) >> shift
                slots, first = np.unique(at >> np.uint64(6), return_inverse=True)
                masks = np.zeros(len(slots), np.uint64)
                np.bitwise_or.at(masks, first, np.uint64(1) << (at & np.uint64(63)))
                yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(masks.view(np.int64))], ["slot", "mask"])

        slots = phrases.select(*names).mapInArrow(positions, "slot int, mask long").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask"))
        table = np.zeros(1 << (BITS - 6), np.uint64)
        found = slots.toPandas()
        table[found.slot.to_numpy()] = found["mask"].to_numpy().astype(np.int64).view(np.uint64)
        self.empty = not len(found)
        self.table = phrases.sparkSession.sparkContext.broadcast(table)

    def holds(self, keys: list[np.ndarray]) -> np.ndarray:
        at = joint(keys) >> self.shift
        return (self.table.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0

    def __getstate__(self):
        return {"table": self.table, "shift": self.shift}


def with_language(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))


def words(texts: DataFrame) -> DataFrame:
    """``lang, k1, word, f``: every word of every language with its count."""

    def run(batches):
        for chunk in chunks(batches):
            w = Words(chunk)
            keys, first, n = np.unique(w.keys, return_index=True, return_counts=True)
            starts, ends = w.starts[first], w.ends[first]
            sizes = ends - starts
            data = LOWER[chunk.data[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]]
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            text = pa.LargeStringArray.from_buffers(len(keys), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).cast(pa.string())
            lang = pa.DictionaryArray.from_arrays(pa.array(w.lang[first].astype(np.int32)), pa.array(w.langs, pa.string())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array(keys.view(np.int64)), text, pa.array(n)], ["lang", "k1", "word", "n"])

    return texts.mapInArrow(run, "lang string, k1 long, word string, n long").groupBy("lang", "k1", "word").agg(F.sum("n").alias("f"))


class Counter:
    """Counts of phrases in a task, sent on whenever ``HELD`` distinct ones are exceeded."""

    def __init__(self, n: int, held: int):
        self.names, self.held, self.parts, self.rows = [f"k{i + 1}" for i in range(n)], held, [], 0

    def add(self, keys: list[np.ndarray]) -> pa.RecordBatch | None:
        hashes, first, n = np.unique(joint(keys), return_index=True, return_counts=True)
        self.parts.append((hashes, n, *[k[first] for k in keys]))
        self.rows += len(n)
        if self.rows > 2 * self.held:
            self._merge()
        return self.send() if self.rows > self.held and len(self.parts) == 1 else None

    def _merge(self):
        hashes, n, *keys = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[0]] + np.uint64(1)))
        self.parts = [(hashes[order][first], np.add.reduceat(n[order], first), *[k[order][first] for k in keys])]
        self.rows = len(first)

    def send(self) -> pa.RecordBatch:
        if len(self.parts) > 1:
            self._merge()
        _, n, *keys = self.parts[0]
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([*[pa.array(k.view(np.int64)) for k in keys], pa.array(n.astype(np.int64))], [*self.names, "n"])


def count(texts: DataFrame, n: int, wanted) -> DataFrame:
    """``k1..kn, a`` of all phrases of ``n`` words for which ``wanted(columns of keys)`` holds and that occur ``LEAST`` times."""
    names, held = [f"k{i + 1}" for i in range(n)], HELD

    def run(batches):
        counter = Counter(n, held)
        for chunk in chunks(batches):
            w = Words(chunk)
            at = w.phrases(n)
            keys = w.columns(at, n)
            at = at[wanted(keys)]
            if len(at) and (full := counter.add(w.columns(at, n))) is not None:
                yield full
        if counter.rows:
            yield counter.send()

    kind = ", ".join(f"{k} long" for k in names)
    counted = texts.mapInArrow(run, f"{kind}, n long").groupBy(*names).agg(F.sum("n").alias("a")).filter(F.col("a") >= LEAST)
    return write_stage(counted, f"phrases{n}")


def score(a: Column, whole: Column) -> Column:
    """``floor(2000000 a / whole)``, exact for any counts."""
    wide = "decimal(20,0)"
    return F.call_function("div", F.lit(2_000_000).cast(wide) * a.cast(wide), whole.cast(wide)).cast("long")


def worst_cut(df: DataFrame, n: int, parts: list[tuple[str, str]]) -> DataFrame:
    """``l, r, score`` of the lowest-scoring cut; ``parts`` names the counts after 1, 2, ... words."""
    cuts = [F.struct(score(F.col("a"), F.col(x) + F.col(y)).alias("score"), F.lit(i).alias("cut"), F.col(x).alias("l"), F.col(y).alias("r")) for i, (x, y) in enumerate(parts)]
    worst = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return df.withColumn("w", worst).select(*[f"k{i + 1}" for i in range(n)], "lang", "first", "a", F.col("w.l").alias("l"), F.col("w.r").alias("r"), F.col("w.score").alias("score"))


def part(df: DataFrame, names: list[str], value: str, out: str, *more: str) -> DataFrame:
    """``df`` with the words renamed to ``names`` and its count called ``out``, for a join."""
    return df.select(*[F.col(f"k{i + 1}").alias(n) for i, n in enumerate(names)], F.col(value).alias(out), *more)


def bound(df: DataFrame) -> Column:
    return score(F.col("a"), F.col("first") + F.col("a"))


def collocations(docs: DataFrame) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``TOP`` phrases of every language.

    Only ``text`` and ``lang`` are read.  A null text has no words, a null language is ``und``; repeated rows count as often as
    they stand; an empty table, or one without a phrase of ``LEAST`` occurrences, gives no rows.  Equal scores are ordered by
    count and then by the bytes of the phrase.
    """
    texts = with_language(docs)
    all_words = write_stage(words(texts), "words")
    total = all_words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = all_words.filter(F.col("f") >= LEAST)
    one = Bits(frequent, ["k1"])
    singles = part(frequent, ["k1"], "f", "f1", "lang")
    pairs = count(texts, 2, lambda k: one.holds(k[:1]) & one.holds(k[1:]))
    pairs = pairs.join(singles, "k1").join(part(frequent, ["k2"], "f", "f2"), "k2").withColumn("first", F.col("f1"))
    pairs = write_stage(worst_cut(pairs, 2, [("f1", "f2")]), "pairs")

    best = Window.partitionBy("lang").orderBy(F.col("score").desc())
    depth, open_, settled = FIRST * TOP, pairs, []
    while True:
        ranked = open_.select("lang", "score", F.row_number().over(best).alias("place")).filter(F.col("place") <= depth)
        limits = ranked.groupBy("lang").agg(F.when(F.max("place") == depth, F.min("score")).otherwise(0).alias("limit"))
        limits = write_stage(limits, "limits")
        found = write_stage(_grow(texts, pairs, limits, singles, frequent), "found")
        state = found.groupBy("lang").agg(F.count("*").alias("kept")).join(limits, "lang", "right")
        state = write_stage(state.select("lang", ((F.col("limit") <= 0) | (F.coalesce("kept", F.lit(0)) >= TOP)).alias("done")), "settled")
        settled.append(found.join(state.filter("done").select("lang"), "lang", "left_semi"))
        left = state.filter("NOT done").select("lang")
        if left.isEmpty():
            break
        open_, depth = open_.join(left, "lang", "left_semi"), 4 * depth
    result = reduce(DataFrame.unionByName, settled)
    for i in range(LONGEST):
        result = result.join(frequent.select(F.col("k1").alias(f"k{i + 1}"), F.col("word").alias(f"w{i + 1}")), f"k{i + 1}", "left")
    result = result.withColumn("phrase", F.concat_ws(" ", *[f"w{i + 1}" for i in range(LONGEST)]))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    result = result.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP).join(total, "lang")
    return result.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _grow(texts: DataFrame, pairs: DataFrame, limits: DataFrame, singles: DataFrame, frequent: DataFrame) -> DataFrame:
    """All surviving phrases of the languages in ``limits`` whose score reaches the language's limit."""

    def reach(df: DataFrame, value: Column) -> DataFrame:
        return df.join(limits, "lang").filter(value >= F.col("limit")).drop("limit")

    common = Bits(pairs, ["k1", "k2"])
    grown2, own2 = Bits(reach(pairs, bound(pairs)), ["k1", "k2"]), Bits(reach(pairs, F.col("score")), ["k1", "k2"])
    threes = count(texts, 3, lambda k: (grown2.holds(k[:2]) | own2.holds(k[1:])) & common.holds(k[:2]) & common.holds(k[1:]))

    def scored3(counted):
        df = counted.join(singles.withColumnRenamed("f1", "first"), "k1").join(part(frequent, ["k3"], "f", "f3"), "k3")
        df = df.join(part(pairs, ["k1", "k2"], "a", "f12"), ["k1", "k2"]).join(part(pairs, ["k2", "k3"], "a", "f23"), ["k2", "k3"])
        return worst_cut(df, 3, [("first", "f23"), ("f12", "f3")])

    triples = write_stage(scored3(threes), "triples")
    three = ["k1", "k2", "k3"]
    grown3, own3 = Bits(reach(triples, bound(triples)), three), Bits(reach(triples, F.col("score")), three)
    fours = count(texts, 4, lambda k: (grown3.holds(k[:3]) & common.holds(k[2:])) | (own3.holds(k[1:]) & common.holds(k[:2])))

    # Of a grown phrase of four words the last three may not have been counted yet: their first two never reached the limit.
    reached = reach(triples, bound(triples)).select(*three)
    rest = fours.join(reached, three, "left_semi").select(*[F.col(f"k{i + 2}").alias(f"k{i + 1}") for i in range(3)]).distinct()
    rest = write_stage(rest.join(threes, three, "left_anti"), "rests")
    if not rest.isEmpty():
        missing = Bits(rest, three)
        more = count(texts, 3, missing.holds)
        threes = threes.unionByName(more.join(rest, three, "left_semi"))
    quads = fours.join(singles.withColumnRenamed("f1", "first"), "k1").join(part(frequent, ["k4"], "f", "f4"), "k4")
    quads = quads.join(part(pairs, ["k1", "k2"], "a", "f12"), ["k1", "k2"]).join(part(pairs, ["k3", "k4"], "a", "f34"), ["k3", "k4"])
    quads = quads.join(part(threes, three, "a", "f123"), three).join(part(threes, ["k2", "k3", "k4"], "a", "f234"), ["k2", "k3", "k4"])
    quads = worst_cut(quads, 4, [("first", "f234"), ("f12", "f34"), ("f123", "f4")])

    def survivors(df, n, longer):
        names = [f"k{i + 1}" for i in range(n)]
        out = reach(df, F.col("score"))
        for side, shift in (("right", 0), ("left", 1)):
            more = longer.groupBy(*[F.col(f"k{i + 1 + shift}").alias(names[i]) for i in range(n)]).agg(F.max("a").alias(side))
            out = out.join(more, names, "left")
        wide = "decimal(20,0)"
        around = F.greatest(F.coalesce("right", F.lit(0)), F.coalesce("left", F.lit(0)))
        return out.filter(around.cast(wide) * 100 < F.col("a").cast(wide) * COVERED).drop("right", "left")

    kept = survivors(pairs, 2, threes).unionByName(survivors(triples, 3, fours), allowMissingColumns=True)
    return kept.unionByName(reach(quads, F.col("score")), allowMissingColumns=True).drop("first")


UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = rf"""
WITH pieces AS (
 SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{SMALL}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM listed, (VALUES (1), (2), (3), (4)) AS t(k)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {LEAST} OR k = 1),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
cands AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1),
halves AS (SELECT *, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, k)) AS j FROM cands)),
cuts AS (SELECT c.*, p.f AS l, q.f AS r, (2000000 * c.a::HUGEINT) // (p.f + q.f)::HUGEINT AS score FROM halves c
 JOIN counted p ON p.lang = c.lang AND p.phrase = c.head JOIN counted q ON q.lang = c.lang AND q.phrase = c.tail),
worst AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (SELECT lang, a, unnest([array_to_string(ws[1:k - 1], ' '), array_to_string(ws[2:], ' ')]) AS phrase FROM cands),
around AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY lang, phrase),
kept AS (SELECT w.* FROM worst w LEFT JOIN around o ON o.lang = w.lang AND o.phrase = w.phrase WHERE coalesce(100 * o.most::HUGEINT, 0) < {COVERED} * w.a::HUGEINT),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""


@query("op13_phrase_mining", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))
