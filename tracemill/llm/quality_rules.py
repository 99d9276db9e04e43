"""Learned decision lists over text statistics.

Statistics of every whole text are computed in one Arrow pass.  Sequential covering learns the list: a rule starts empty,
takes the threshold that gains most information on the growing rows until it covers no good row there, and loses trailing
conditions while that raises its precision on the pruning rows.  The list becomes one ordered Spark conditional.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import fresh, query, read, write_stage
from tracemill.llm.scan import CODES, Chunk, Prefix, chunks, mix, per_text

#: Labelled rows the list is learned from: those with the smallest hash of their id, all if there are fewer.
LABEL_BOUND = 40_000
MAX_RULES, MAX_CONDITIONS, MAX_THRESHOLDS = 16, 4, 64
#: A rule is kept if, on growing and pruning rows alike, at least this share of what it rejects is bad.
MIN_PRECISION, MIN_COVERED = 0.97, 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_digits", "n_punctuation", "n_lines", "n_distinct_words"]
#: Ratios the rules may test: numerator, denominator.
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_share": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "punctuation_share": ("n_punctuation", "n_words"),
    "distinct_share": ("n_distinct_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
}


def _table(*ranges) -> np.ndarray:
    out = np.zeros(256, bool)
    for r in ranges:
        out[list(r)] = True
    return out


WORD = ~_table([0x20], range(0x09, 0x0E))
NOT_NEWLINE = ~_table([0x0A])
SYMBOL = _table(b"#*$%&|<>")
UPPER, DIGIT = _table(range(65, 91)), _table(range(48, 58))
LETTER = _table(range(65, 91), range(97, 123), range(0xC0, 256))  # a non-ASCII character counts by its first byte
PUNCTUATION = _table(b"!\"'(),-./:;?@[\\]^_`{}~+=")
CHARACTER = ~_table(range(0x80, 0xC0))


def statistics(chunk: Chunk) -> dict[str, np.ndarray]:
    data, n = chunk.data, chunk.n
    edges = chunk.edges

    def count(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return sums[edges[1:]] - sums[edges[:-1]]

    is_word = WORD[data]
    text, start, end = chunk.runs(WORD)
    out = {"n_words": per_text(np.ones(len(text)), text, n), "word_chars": count(is_word & CHARACTER[data])}
    for name, table in (("n_symbols", SYMBOL), ("n_upper", UPPER), ("n_letters", LETTER), ("n_digits", DIGIT), ("n_punctuation", PUNCTUATION)):
        out[name] = count(table[data])
    prefix = Prefix(CODES[0][data])
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))

    def repeats(owner, prints):
        """Inverse and counts of equal fingerprints within a text."""
        _, inverse, counts = np.unique(prints ^ salt[owner], return_inverse=True, return_counts=True)
        return inverse, counts

    line, a, b = chunk.runs(NOT_NEWLINE)
    words_before = np.concatenate([[0], np.cumsum(is_word)])
    full = words_before[b] > words_before[a]
    line, a, b = line[full], a[full], b[full]
    out["n_lines"] = per_text(np.ones(len(line)), line, n)
    distinct = np.unique(prefix.span(a, b) ^ salt[line], return_index=True)[1] if len(line) else line
    out["n_dup_lines"] = out["n_lines"] - per_text(np.ones(len(distinct)), line[distinct], n)
    words = prefix.span(start, end) if len(start) else np.zeros(0, np.uint64)
    distinct = np.unique(words ^ salt[text], return_index=True)[1] if len(text) else text
    out["n_distinct_words"] = per_text(np.ones(len(distinct)), text[distinct], n)
    marked = np.zeros(len(words), bool)
    if len(words) >= 3:
        at = np.flatnonzero(text[2:] == text[:-2])
        if len(at):
            inverse, counts = repeats(text[at], Prefix(words).span(at, at + 3))
            again = at[counts[inverse] > 1]
            for shift in range(3):
                marked[again + shift] = True
    out["n_repeat_words"] = per_text(marked.astype(np.int64), text, n)
    return {name: out[name].astype(np.int64) for name in COUNTS}


def with_statistics(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` and a struct ``column`` of the statistics of its ``text``."""

    def run(batches):
        for chunk in chunks(batches):
            made = statistics(chunk)
            struct = pa.StructArray.from_arrays([pa.array(v) for v in made.values()], list(made))
            yield pa.RecordBatch.from_arrays([*chunk.batch.columns, struct], [*chunk.batch.schema.names, column])

    kind = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, kind)]))


def ratio(name: str, of=F.col) -> Column:
    a, b = RATIOS[name]
    return of(a) / F.greatest(of(b), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def column(self, of=F.col) -> Column:
        c = ratio(self.feature, of)
        return c >= self.value if self.at_least else c <= self.value

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] >= self.value if self.at_least else rows[self.feature] <= self.value

    def __str__(self):
        return f"{self.feature} {'>=' if self.at_least else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covered(rule, rows, n):
    out = np.ones(n, bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _best_condition(rows, bad, live):
    """The threshold with the largest information gain among the live rows."""
    p0, n0 = (bad & live).sum(), (~bad & live).sum()
    base, best = np.log2(p0 / (p0 + n0)), (0.0, None)
    for name, values in rows.items():
        v, y = values[live], bad[live]
        order = np.argsort(v, kind="stable")
        v, y = v[order], y[order]
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, MAX_THRESHOLDS + 1), method="lower"))
        at = np.searchsorted(v, cuts)
        positives = np.concatenate([[0], np.cumsum(y)])
        for at_least, k in ((True, at), (False, np.searchsorted(v, cuts, side="right"))):
            p = p0 - positives[k] if at_least else positives[k]
            total = len(v) - k if at_least else k
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / np.maximum(total, 1)) - base), -1.0)
            i = int(np.argmax(gain))
            if gain[i] > best[0] + 1e-9:
                best = gain[i], Condition(name, at_least, float(cuts[i]))
    return best[1]


def learn_list(rows: dict[str, np.ndarray], bad: np.ndarray, pruning: np.ndarray) -> list[Rule]:
    """Ordered rules that reject bad rows; ``pruning`` marks the rows kept for pruning."""
    n, rules, live = len(bad), [], np.ones(len(bad), bool)
    for _ in range(MAX_RULES):
        if (bad & live & ~pruning).sum() < MIN_COVERED:
            break
        rule: list[Condition] = []
        inside = live & ~pruning
        while len(rule) < MAX_CONDITIONS and (~bad & inside).any():
            condition = _best_condition(rows, bad, inside)
            if condition is None or condition in rule:
                break
            rule.append(condition)
            inside = inside & condition.holds(rows)

        def worth(length, rule=rule):
            hit = _covered(rule[:length], rows, n) & live & pruning
            return ((bad & hit).sum() + 1) / (hit.sum() + 2)

        if not rule:
            break
        rule = rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))]
        hit = _covered(rule, rows, n) & live
        good = [(bad & hit & part).sum() >= MIN_PRECISION * max((hit & part).sum(), 1) for part in (pruning, ~pruning)]
        if hit.sum() < MIN_COVERED or not all(good):
            # What this rule covers can't be told apart: set its growing rows aside, keep searching among the rest.
            live = live & ~(hit & ~pruning)
            if not hit.any():
                break
            continue
        rules.append(tuple(rule))
        live &= ~hit
    return rules


def fit(stats: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> list[Rule]:
    """Learn from ``labels`` (``doc_id, quality``) joined with statistics; conflicting labels go by majority, ties are good."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg((F.avg("quality") < 0.5).alias("bad"))
    rows = stats.filter(~base_failed()).join(marks, "doc_id")
    sample = rows.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(bound).toPandas()
    if not len(sample):
        return []
    # Ratios only: a count that is telling in short texts also grows with the length of good ones.
    values = {r: sample[a].to_numpy(float) / np.maximum(sample[b].to_numpy(float), 1) for r, (a, b) in RATIOS.items()}
    return learn_list(values, sample.bad.to_numpy(bool), sample.h.to_numpy() % 3 == 0)


def base_failed(of=F.col) -> Column:
    return (of("n_words") < 50) | (100 * of("n_repeat_words") > 50 * of("n_words"))


def rule_number(rules: list[Rule], of=F.col) -> Column:
    """The list as one ordered conditional: number of the first rule that holds, 0 if none."""
    out = None
    for i, rule in enumerate(rules):
        test = rule[0].column(of)
        for c in rule[1:]:
            test = test & c.column(of)
        out = F.when(test, i + 1) if out is None else out.when(test, i + 1)
    return out.otherwise(0) if out is not None else F.lit(0)


def quality_rules(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> tuple[DataFrame, list[Rule]]:
    """Statistics and verdict per row of ``docs`` (``doc_id, <COUNTS>, base_failed, rule, kept``), and the learned list.

    Null and empty texts have no words and fail the base; an empty label table gives an empty list, so the base decides
    alone; repeated ids get one row each; other columns are not read.
    """
    stats = write_stage(with_statistics(docs.select("doc_id", "text"), "s").select("doc_id", "s.*"), "quality")
    rules = fit(stats, labels, bound)
    judged = stats.withColumns({"base_failed": base_failed(), "rule": rule_number(rules)})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0)), rules


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = LABEL_BOUND) -> DataFrame:
    """Rows of ``docs`` that the base and the list keep, with their columns; no text is shuffled."""
    _, rules = quality_rules(docs, labels, bound)
    name = fresh(docs, "_statistics")
    of = lambda c: F.col(f"{name}.{c}")
    return with_statistics(docs, name).filter(~base_failed(of) & (rule_number(rules, of) == 0)).drop(name)


@query("op1_quality_rules")
def op1(spark, sf_dir):
    judged, _ = quality_rules(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
