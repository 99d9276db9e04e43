"""Benchmark leaks in a corpus by suffix arrays over its shards.

A shard is a chunk of documents inside a task.  Its word suffixes are sorted by multikey refinement (one word at a time,
suffixes that no test suffix can follow are left out), and every test suffix is looked up by binary search, so one pass
over the corpus without any shuffle gives all verbatim occurrences and their places.  The benchmark is taken in blocks of
at most ``BLOCK_BYTES`` of text, the only thing sent to the tasks; more blocks mean more passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, group_of, query, read, text_bytes, with_key
from tracemill.llm.scan import CODES, Chunk, Prefix, chunks, per_text, spans_inside

WINDOW = 13
BLOCK_BYTES = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[48:58] = WORD_BYTE[65:91] = WORD_BYTE[97:123] = WORD_BYTE[128:] = True


def words_of(chunk: Chunk):
    """Text index and fingerprint of every word, in order."""
    text, start, end = chunk.runs(WORD_BYTE)
    return text, Prefix(CODES[0][LOWER[chunk.data]]).span(start, end) if len(start) else np.zeros(0, np.uint64)


class TestSuffixes:
    """The windows of some benchmark items, as vocabulary ids."""

    def __init__(self, items: list[str], texts: list[str], window: int):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
        self.items, ids, at, size, all_words, base = items, [], [], [], [], 0
        for i, row in enumerate(range(len(items))):
            _, w = words_of(Chunk(batch.slice(row, 1), "text"))
            m = min(window, len(w))
            for p in range(len(w) - m + 1 if m else 0):
                ids.append(i), at.append(base + p), size.append(m)
            all_words.append(w)
            base += len(w)
        words = np.concatenate(all_words) if all_words else np.zeros(0, np.uint64)
        self.vocabulary, code = np.unique(words, return_inverse=True)
        self.code = code.astype(np.int64) + 1
        self.item, self.at, self.size = (np.array(x, np.int64) for x in (ids, at, size))


def occurrences(owner: np.ndarray, words: np.ndarray, last: np.ndarray, test: TestSuffixes):
    """Every place where a test suffix occurs: index of the suffix, word position.  ``last``: end of each word's text."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(test.at):
        return none
    spot = np.minimum(np.searchsorted(test.vocabulary, words), len(test.vocabulary) - 1)
    code = np.where(test.vocabulary[spot] == words, spot + 1, 0)
    v = len(test.vocabulary) + 1
    suffixes = np.flatnonzero(code)
    cls = np.zeros(len(suffixes), np.int64)
    queries, qcls = np.arange(len(test.at)), np.zeros(len(test.at), np.int64)
    found_q, found_p = [], []
    for depth in range(int(test.size.max())):
        inside = suffixes + depth < last[owner[suffixes]]
        suffixes, cls = suffixes[inside], cls[inside]
        key = cls * v + code[suffixes + depth]
        wanted = qcls * v + test.code[test.at[queries] + depth]
        known = np.unique(wanted)
        spot = np.minimum(np.searchsorted(known, key), len(known) - 1)
        keep = known[spot] == key
        suffixes, key = suffixes[keep], key[keep]
        order = np.argsort(key, kind="stable")
        suffixes, key = suffixes[order], key[order]
        low, high = np.searchsorted(key, wanted), np.searchsorted(key, wanted, side="right")
        done = (low < high) & (test.size[queries] == depth + 1)
        if done.any():
            where, which = spans_inside(low[done], (high - low)[done])
            found_q.append(queries[done][which]), found_p.append(suffixes[where])
        alive = (low < high) & ~done
        if not alive.any():
            break
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        cls = np.cumsum(first) - 1
        queries, qcls = queries[alive], cls[low[alive]]
    return (np.concatenate(found_q), np.concatenate(found_p)) if found_q else none


ROWS = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, items array<string>, longest_words long, longest_start long"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _rows(ids: pa.Array, n_words, text, start, end, pair_text, pair_item, items, longest, longest_at) -> pa.RecordBatch:
    n = len(ids)
    offsets = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]))
    offsets = np.searchsorted(pair_text, np.arange(n + 1)).astype(np.int32)
    names = pa.array(items, pa.string()).take(pa.array(pair_item)) if len(pair_item) else pa.array([], pa.string())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words), spans, pa.ListArray.from_arrays(pa.array(offsets), names), pa.array(longest), pa.array(longest_at)],
        ["doc_id", "n_words", "spans", "items", "longest_words", "longest_start"],
    )


def search(test: TestSuffixes):
    def run(batches):
        for chunk in chunks(batches):
            owner, words = words_of(chunk)
            count = per_text(np.ones(len(owner)), owner, chunk.n)
            last = np.cumsum(count)
            q, p = occurrences(owner, words, last, test)
            base = last - count
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, p, 1)
            np.add.at(covered, p + test.size[q], -1)
            hit = np.cumsum(covered[:-1]) > 0
            # Runs of hit words, cut between texts.
            new = hit & ~np.concatenate([[False], hit[:-1]])
            if len(hit):
                new |= hit & (np.diff(owner, prepend=-1) != 0)
            start = np.flatnonzero(new)
            stop = hit & np.concatenate([new[1:] | ~hit[1:], [True]]) if len(hit) else hit
            end = np.flatnonzero(stop) + 1
            text = owner[start] if len(start) else start
            pairs = np.unique(owner[p] * np.int64(len(test.items) + 1) + test.item[q]) if len(p) else np.zeros(0, np.int64)
            # Longest verbatim match: consecutive windows on one diagonal of (document, item).
            longest, longest_at = np.zeros(chunk.n, np.int64), np.full(chunk.n, -1, np.int64)
            if len(p):
                order = np.lexsort((p, p - test.at[q], test.item[q]))
                a, d, i, t, m = p[order], (p - test.at[q])[order], test.item[q][order], owner[p][order], test.size[q][order]
                cut = np.ones(len(a), bool)
                cut[1:] = (a[1:] != a[:-1] + 1) | (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (t[1:] != t[:-1])
                s = np.flatnonzero(cut)
                e = np.append(s[1:], len(a)) - 1
                size = a[e] + m[e] - a[s]
                best = np.lexsort((a[s], -size, t[s]))
                t0, f = np.unique(t[s][best], return_index=True)
                longest[t0], longest_at[t0] = size[best[f]], a[s][best[f]] - base[t0]
            yield _rows(
                chunk.batch.column("doc_id"), count, text, start - base[text], end - base[text],
                pairs // (len(test.items) + 1), pairs % (len(test.items) + 1), test.items, longest, longest_at,
            )

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, longest_words, longest_start, contaminated`` per row of ``docs``.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered.  A window is ``window`` consecutive words of an
    item, or a shorter item as a whole; a word inside an occurrence of a window is hit; a document is contaminated when
    hit words are at least ``share`` of its words.  Null texts have no words; empty tables and items without words give
    no hits; repeated items count once by id; other columns are not read.  ``spans`` are word ranges.  Rows with repeated or
    null ids get one row each, however many blocks the benchmark has.
    """
    n = max(1, -(-text_bytes(benchmark) // BLOCK_BYTES))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL AND item_id IS NOT NULL")
    rows_in, plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), True
    if n > 1:  # the results of several blocks meet by row
        own, plain = with_key(rows_in, "_row")
        rows_in = own.select(F.col("_row").alias("doc_id"), "text")
    found = None
    for k in range(n):
        rows = items.filter(group_of("item_id", n) == k).collect()  # at most a block of a stated query set
        test = TestSuffixes([r.item_id for r in rows], [r.text for r in rows], window)
        part = rows_in.mapInArrow(search(test), ROWS)
        found = part if found is None else found.union(part)
    if n > 1:  # spans of several blocks: the words they cover, each once
        found = found.groupBy("doc_id").agg(
            F.max("n_words").alias("n_words"),
            F.flatten(F.collect_list("spans")).alias("spans"),
            F.flatten(F.collect_list("items")).alias("items"),
            F.max(F.struct("longest_words", F.negative("longest_start").alias("at"))).alias("best"),
        ).select("doc_id", "n_words", _union_of("spans").alias("spans"), "items", "best.longest_words", F.negative("best.at").alias("longest_start"))
    if not plain:
        found = found.withColumnRenamed("doc_id", "_row").join(own.select("_row", "doc_id"), "_row").drop("_row").select("doc_id", *[c for c in found.columns if c != "doc_id"])
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    out = found.withColumns({"n_hit": hit, "items": F.array_sort(F.array_distinct("items"))})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") >= F.col("n_words") * F.lit(share)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = 0.05) -> DataFrame:
    """Rows of ``docs`` that are not contaminated; all columns.  The join moves keys and texts once; ids may repeat or be null."""
    key, name = fresh(docs, "_row"), fresh(docs, "_hit")
    rows, _ = with_key(docs, key)
    hit = decontaminate(rows.select(F.col(key).alias("doc_id"), "text"), benchmark, window, share).filter("contaminated").select(F.col("doc_id").alias(name))
    return rows.join(hit, F.col(key) == F.col(name), "left_anti").select(docs.columns)


def _union_of(spans: str):
    """Union of word ranges."""
    start = F.array_sort(spans)
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def add(acc, s):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]), joined).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(start, empty, add)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), {WINDOW}) AS m, unnest(range(1, greatest(len(w) - {WINDOW}, 0) + 2)) AS k0 FROM i WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, m, array_to_string(list_slice(w, k0, k0 + m - 1), ' ') AS win FROM p),
s AS (SELECT DISTINCT m FROM q),
x AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k0 FROM d, s WHERE len(w) >= m),
y AS (SELECT doc_id, m, k0, array_to_string(list_slice(w, k0, k0 + m - 1), ' ') AS win FROM x),
h AS (SELECT doc_id, y.m, k0, item_id FROM y JOIN q ON y.win = q.win AND y.m = q.m),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(k0, k0 + m)) AS pos FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw ON d.doc_id = hw.doc_id LEFT JOIN hi ON d.doc_id = hi.doc_id
"""


@query("op3_decontaminate", SQL)
def op3(spark, sf_dir):
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )
