"""Toxicity of clauses by a weighted finite-state pattern grammar.

Words are mapped to symbols: insults (a lexicon learned from labelled rows: whole words, and stems that many words share),
threats, targets, negations and reporting words (short closed lists), and all others.  Five small transducers, each a table
of transitions with outputs, read the symbols of a whole clause: insult, threat, target, negation and reported speech.  They
are composed into one (:data:`GRAMMAR`).  A clause is accepted if its path ends in a state with an insult among other words,
or with a threat; whether a target, a negation or a report stood before or after it, at any distance, is part of that state.
A text is scored by its accepted clauses with weights learned from the same labels; a word alone in its clause scores nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import query, read
from tracemill.llm.decontaminate import LOWER
from tracemill.llm.language_id import remainder
from tracemill.llm.scan import CODES, Chunk, Prefix, chunks, mix

#: Labelled rows the lexicon and the weights are learned from: those with the smallest hash of their id.
LABEL_BOUND = 40_000
#: Lengths in bytes of the word beginnings that may become stems (0: the whole word).
STEMS = (0, 4, 5, 6, 7, 8)
#: A lexicon entry needs this many different contexts in toxic texts, and this log-odds against clean ones.
#: The contexts grow with half the root of the number of toxic rows.
MIN_CONTEXTS, MIN_ODDS = 3, 3.0
#: Toxic texts a word must occur in, and log-odds by texts, before its contexts are looked at.
MIN_TEXTS, MIN_TEXT_ODDS = 3, 2.0
#: Least weight of aiming, and what a negation or a report takes off at least: labels may refine the grammar, not turn it round.
AIMED, TURNED = 0.5, 1.0

# Fixed word lists.
TARGETS = "you your yours u he she they them him her du dich dir ihr euch sie er tu te toi vous il elle ils tú usted ustedes él ella ellos".split()
NEGATIONS = "not no never isn't aren't nicht kein keine nie niemals pas jamais aucun nunca ni jamás".split()
REPORTS = "said says say called quoted reported claims claimed wrote sagte sagt nannte schrieb dit disait écrit appelé dijo dice llamó escribió".split()
THREATS = "kills hurts beats shoots stabs burns destroys punishes tötet tötest bringt schlägt verletzt tue tuera tuerai frappe frappera brûle blesse mata mataré matará golpea hiere quema kill hurt beat shoot stab burn destroy punish töten umbringen schlagen verletzen tuer frapper brûler blesser matar golpear herir quemar".split()

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
WORD[39] = True
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[list(b".!?;:\n")] = True
U64 = np.uint64
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
SYMBOLS = 6


class Transducer:
    """States 0 (start) to n - 1; ``step[symbol]`` is the next state of each, ``output`` what a path that ends there says."""

    def __init__(self, step: np.ndarray, output: list[tuple]):
        self.step, self.output = np.asarray(step, np.uint8), output

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; the outputs of a path are joined.  States that no path reaches are left out."""
        number, todo, step = {(0, 0): 0}, [(0, 0)], []
        for a, b in todo:
            row = []
            for symbol in range(SYMBOLS):
                pair = int(self.step[symbol, a]), int(other.step[symbol, b])
                if pair not in number:
                    number[pair] = len(number)
                    todo.append(pair)
                row.append(number[pair])
            step.append(row)
        return Transducer(np.array(step).T, [self.output[a] + other.output[b] for a, b in todo])


def seen(symbol: int) -> Transducer:
    """Says whether the symbol stands in the clause."""
    step = np.tile(np.arange(2), (SYMBOLS, 1))
    step[symbol] = 1
    return Transducer(step, [(False,), (True,)])


def among_others(symbol: int) -> Transducer:
    """Says whether the symbol stands in a clause of at least two words: 0 nothing, 1 others, 2 the symbol alone, 3 both."""
    step = np.tile([1, 1, 3, 3], (SYMBOLS, 1))
    step[symbol] = [2, 3, 3, 3]
    return Transducer(step, [(False,), (False,), (False,), (True,)])


#: Insult, threat, target, negation and report, composed.
GRAMMAR = among_others(INSULT).compose(among_others(THREAT)).compose(seen(TARGET)).compose(seen(NEGATION)).compose(seen(REPORT))
#: Names of accepted states: insult or threat, plain or aimed, each free, negated or reported.
STATES = [f"{kind}_{aim}_{mood}" for kind in ("insult", "threat") for aim in ("plain", "aimed") for mood in ("free", "negated", "reported")]


def accepted(output: tuple) -> int:
    """Index in ``STATES`` of what a path says, -1 if it is not accepted: a threat only counts with a target."""
    insult, threat, target, negation, report = output
    if not insult and not (threat and target):
        return -1
    return 6 * (not insult) + 3 * target + (2 if report else 1 if negation else 0)


ACCEPT = np.array([accepted(o) for o in GRAMMAR.output])


def end_states(symbol: np.ndarray, clause: np.ndarray) -> np.ndarray:
    """End state of each clause (numbers ``clause`` from 0, sorted).

    A symbol is a map of states; maps of neighbours are composed pairwise, so a clause of any length takes logarithmic time.
    A symbol right after itself changes nothing once it was read twice, which leaves few to compose.
    """
    keep = np.ones(len(symbol), bool)
    same = (symbol[1:] == symbol[:-1]) & (clause[1:] == clause[:-1])
    keep[2:] = ~(same[1:] & same[:-1])
    maps, clause = GRAMMAR.step[symbol[keep]], clause[keep]
    while True:
        new = np.ones(len(clause), bool)
        new[1:] = clause[1:] != clause[:-1]
        if new.all():
            return maps[:, 0]
        first = np.flatnonzero(new)
        place = np.arange(len(clause)) - first[np.cumsum(new) - 1]
        left = np.flatnonzero(place % 2 == 0)
        paired = np.append(~new[1:], False)[left]
        out = maps[left]
        out[paired] = np.take_along_axis(maps[left[paired] + 1], out[paired].astype(np.int64), axis=1)
        maps, clause = out, clause[left]


def fingerprint(words: list[str]) -> np.ndarray:
    """Sorted fingerprints of the words of a list."""
    raw = [w.encode() for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8)
    size = np.array([len(r) for r in raw])
    end = np.cumsum(size)
    return np.sort(Prefix(CODES[0][data]).span(end - size, end))


def tokens(chunk: Chunk):
    """Per word: text, clause, fingerprint, and a function for the fingerprint of its first bytes."""
    data = LOWER[chunk.data]
    text, start, end = chunk.runs(WORD)
    if not len(start):
        return text, text, np.zeros(0, U64), lambda size: (np.zeros(0, bool), np.zeros(0, U64))
    prefix = Prefix(CODES[0][data])
    ends = np.concatenate([[0], np.cumsum(CLAUSE_END[data])])[start]
    new = np.ones(len(start), bool)
    new[1:] = (ends[1:] != ends[:-1]) | (text[1:] != text[:-1])

    def stem(size: int):
        if size == 0:
            return np.ones(len(start), bool), prefix.span(start, end)
        long = end - start > size
        return long, prefix.span(start[long], start[long] + size)

    return text, np.cumsum(new) - 1, prefix.span(start, end), stem


def found_in(prints: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Index in the sorted ``table``, or -1."""
    if not len(table):
        return np.full(len(prints), -1)
    spot = np.minimum(np.searchsorted(table, prints), len(table) - 1)
    return np.where(table[spot] == prints, spot, -1)


def text_counts(rows: DataFrame) -> DataFrame:
    """Texts that hold each word and stem: ``stem, print, toxic, clean``, summed per chunk before they are shuffled."""

    def count(batches):
        for chunk in chunks(batches):
            text, _, _, stem = tokens(chunk)
            if not len(text):
                continue
            toxic = chunk.batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            salt = mix(np.arange(1, chunk.n + 1, dtype=U64))
            for size in STEMS:
                has, p = stem(size)
                _, once = np.unique(p ^ salt[text[has]], return_index=True)
                bad = toxic[text[has][once]]
                prints, inverse = np.unique(p[once], return_inverse=True)
                sums = [np.bincount(inverse, weights=w, minlength=len(prints)).astype(np.int64) for w in (bad, ~bad)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), size, np.int32)), pa.array(prints.view(np.int64)), *map(pa.array, sums)], ["stem", "print", "toxic", "clean"])

    made = rows.mapInArrow(count, "stem int, print long, toxic long, clean long")
    return made.groupBy("stem", "print").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def context_counts(rows: DataFrame, asked: dict[int, np.ndarray]) -> DataFrame:
    """Contexts (neighbouring words) of the words and stems ``asked`` for: ``stem, print, toxic, clean``.

    Copies of a text add none, and a context that a clean text has too is clean.
    """

    def contexts(batches):
        for chunk in chunks(batches):
            text, _, prints, stem = tokens(chunk)
            if not len(text):
                continue
            toxic = chunk.batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)[text]
            around = mix(np.concatenate([[U64(0)], prints[:-1]]) * U64(3) + np.concatenate([prints[1:], [U64(0)]]))
            for size, table in asked.items():
                has, p = stem(size)
                hit = found_in(p, table) >= 0
                p, near, bad = p[hit], around[has][hit], toxic[has][hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(p), size, np.int32)), pa.array(p.view(np.int64)), pa.array(near.view(np.int64)), pa.array(bad)], ["stem", "print", "context", "toxic"]
                )

    seen = rows.mapInArrow(contexts, "stem int, print long, context long, toxic boolean")
    once = seen.groupBy("stem", "print", "context").agg(F.min("toxic").alias("toxic"))
    return once.groupBy("stem", "print").agg(F.count_if("toxic").alias("toxic"), F.count_if(~F.col("toxic")).alias("clean"))


def sorted_prints(part) -> tuple[np.ndarray, np.ndarray]:
    prints = part["print"].to_numpy(np.int64).view(U64)
    order = np.argsort(prints)
    return prints[order], part.odds.to_numpy()[order]


class Grammar:
    """Lexicon and weights."""

    def __init__(self):
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.closed = {name: fingerprint(words) for name, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS))}
        self.weights = np.zeros(7)
        self.bias = -4.0
        self.threat = MIN_ODDS

    def features(self, chunk: Chunk) -> np.ndarray:
        """(texts, 7 + states): strongest and summed weight of matched clauses, shares by state, length; then which states matched."""
        text, clause, prints, stem = tokens(chunk)
        out = np.zeros((chunk.n, 7 + len(STATES)))
        if not len(text):
            return out
        weight = np.zeros(len(text))
        for size, (table, odds) in self.tables.items():
            has, p = stem(size)
            at = found_in(p, table)
            hit = at >= 0
            where = np.flatnonzero(has)[hit]
            weight[where] = np.maximum(weight[where], odds[at[hit]])
        symbol = np.zeros(len(text), np.int64)
        for name, code in (("report", REPORT), ("negation", NEGATION), ("target", TARGET), ("threat", THREAT)):
            symbol[found_in(prints, self.closed[name]) >= 0] = code
        symbol[weight > 0] = INSULT
        marked = np.zeros(clause[-1] + 1, bool)
        marked[clause[(symbol == INSULT) | (symbol == THREAT)]] = True
        inside = np.flatnonzero(marked[clause])  # clauses without either are not accepted
        if not len(inside):
            return out
        first = inside[np.flatnonzero(np.diff(clause[inside], prepend=-1))]
        number = np.cumsum(np.diff(clause[inside], prepend=clause[inside[0]]) != 0)
        state = ACCEPT[end_states(symbol[inside], number)]
        strongest = np.zeros(len(first))
        np.maximum.at(strongest, number, weight[inside])
        # A threat weighs as the middle entry of the lexicon.
        strongest = np.where(state >= 6, self.threat, strongest)
        t, s, w = text[first][state >= 0], state[state >= 0], strongest[state >= 0]
        n = chunk.n
        every = np.bincount(t, weights=w, minlength=n)
        np.maximum.at(out[:, 0], t, w)
        out[:, 1] = np.log1p(every)
        for i, mask in enumerate((s % 6 >= 3, s % 3 == 1, s % 3 == 2, s >= 6)):  # shares of aimed, negated, reported, threatening clauses
            out[:, 2 + i] = np.bincount(t[mask], weights=w[mask], minlength=n) / np.maximum(every, 1e-9)
        out[:, 6] = np.log1p(np.bincount(text, minlength=n)) * (every > 0)
        out[t, 7 + s] = 1
        return out

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features[:, :7] @ self.weights + self.bias, -30, 30)))


def newton(x: np.ndarray, y: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a small ridge, by Newton steps; weights given in ``fixed`` (else nan) stay as they are."""
    free = np.isnan(fixed)
    offset = x[:, ~free] @ fixed[~free]
    a = np.column_stack([x[:, free], np.ones(len(x))])
    w = np.zeros(a.shape[1])
    ridge = np.full(a.shape[1], 1e-2 * max(len(x), 1) / 100)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w + offset, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9)
        d = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += d
        if np.abs(d).max() < 1e-6:
            break
    out = fixed.copy()
    out[free] = w[:-1]
    return out, float(w[-1])


def fit_weights(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights with those of aimed, negated and reported clauses at ``AIMED`` and ``TURNED`` at least."""
    fixed = np.full(x.shape[1], np.nan)
    while True:
        w, bias = newton(x, y, fixed)
        wrong = np.flatnonzero([np.isnan(fixed[2]) and w[2] < AIMED, np.isnan(fixed[3]) and w[3] > -TURNED, np.isnan(fixed[4]) and w[4] > -TURNED])
        if not len(wrong):
            return w, bias
        fixed[2 + wrong] = np.array([AIMED, -TURNED, -TURNED])[wrong]


def fit(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> Grammar:
    """Learn from at most ``bound`` rows of ``labels`` (``doc_id, toxic``); conflicting labels go by majority."""
    grammar = Grammar()
    marks = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    rows = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(marks), "doc_id").select("text", "toxic")  # bounded by ``bound`` slim rows
    totals = rows.agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c")).first()
    if not totals.t or not totals.c:
        grammar.bias = 4.0 if totals.t else -4.0
        return grammar
    odds = F.log((F.col("toxic") + 0.5) / (totals.t + 1)) - F.log((F.col("clean") + 0.5) / (totals.c + 1))

    def telling(counted, least, least_odds):
        return counted.filter(F.col("toxic") >= least).withColumn("odds", odds).filter(F.col("odds") >= least_odds).select("stem", "print", "odds").toPandas()

    asked = {int(size): sorted_prints(part)[0] for size, part in telling(text_counts(rows), MIN_TEXTS, MIN_TEXT_ODDS).groupby("stem")}
    if asked:
        grammar.tables = {int(size): sorted_prints(part) for size, part in telling(context_counts(rows, asked), max(MIN_CONTEXTS, int(0.5 * totals.t**0.5)), MIN_ODDS).groupby("stem")}
        grammar.threat = float(np.median(np.concatenate([odds for _, odds in grammar.tables.values()]))) if grammar.tables else MIN_ODDS

    def measure(batches):
        for chunk in chunks(batches):
            x = grammar.features(chunk)[:, :7]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), chunk.batch.column("toxic")], ["x", "toxic"])

    sample = rows.mapInArrow(measure, "x array<double>, toxic boolean").groupBy("x", "toxic").agg(F.count("*").alias("n")).toPandas()
    x = np.repeat(np.array(sample.x.tolist()), sample.n, axis=0)
    grammar.weights, grammar.bias = fit_weights(x, np.repeat(sample.toxic.to_numpy(float), sample.n))
    return grammar


def toxicity(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """``doc_id, score, predicted, states`` per row of ``docs``, from ``text`` alone.

    Null and empty texts match no clause and get the score of a text without any match.  ``states`` names the states of the
    clauses that matched.  Repeated ids get one row each; other columns are not read.
    """

    def run(batches):
        for chunk in chunks(batches):
            x = grammar.features(chunk)
            score = grammar.score(x)
            states = [[STATES[s] for s in np.flatnonzero(row[7:])] for row in x]
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(states, pa.list_(pa.string()))],
                ["doc_id", "score", "predicted", "states"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, states array<string>")


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    grammar = fit(docs, read(spark, sf_dir, "labels").filter(remainder("doc_id", 4) != 2))
    return toxicity(docs, grammar).select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted", F.concat_ws(",", "states").alias("states"))
