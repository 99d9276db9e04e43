"""Bulk-synchronous best fit: pieces of documents go into sequences of a fixed capacity, as few as it can.

A superstep range-sorts the waiting pieces and the open gaps together by size, largest first, and sweeps every range on its
own: going down, gaps are pushed on a stack and each piece takes its successor, the smallest gap that holds it; what is left
of the gap is pushed again further down.  Pieces without a gap and gaps without a piece keep their rank in their range.  One
row per range says how many there are, and from these rows alone follows which ranks of pieces meet which ranks of gaps of
larger ranges (a gap wanted by several goes to the largest, the others take the next).  Gaps are updated and the step repeats.

Pieces are admitted from the largest down, in bands ``(capacity / (k + 1), capacity / k]``: ``k`` pieces of a band fit into an
empty sequence for sure, so pieces no gap can hold open ``1 / k`` sequences each.  A task holds one range, the driver one
row per range; every step is a table in the shared folder, so a lost executor repeats one step at most.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from itertools import batched, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import query, read, write_stage
from tracemill.llm.scan import Chunk, chunks, spans_inside
from tracemill.session import spread, values

CAPACITY = 2048
#: Bands of sizes, from the largest down; the last one holds everything smaller.
BANDS = 5
#: Pieces and gaps that one task sweeps.
RANGE_ROWS = 250_000
#: Words whose ids a worker remembers; beyond, it starts anew.
REMEMBERED = 600_000
#: White space that certainly separates tokens, and closing marks that certainly are tokens of their own after a letter.
INSIDE = np.ones(256, bool)
INSIDE[list(b" \t\n\r")] = False
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, bool)
MARK[list(b".,;:!?")] = True

#: Words of which no step before the merges changes more than the letters' bytes, once they are in lower case.
PLAIN = re.compile("[a-zß-öø-ÿ]+")

_READY: dict[str, tuple] = {}


def tokenizer(path: str) -> tuple:
    """The tokenizer of a file, its spelling of plain letters, and the ids of words seen so far: one set per worker."""
    if path not in _READY:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core per task
        from tokenizers import Tokenizer

        known = Tokenizer.from_file(path)
        letters = [c for c in map(chr, range(256)) if PLAIN.fullmatch(c)]
        _READY[path] = (known, str.maketrans({c: known.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}), {})
    return _READY[path]


def word_ids(words: list[str], path: str) -> list[bytes]:
    """Ids of each word as little-endian 32-bit numbers.  Plain words need the merges only."""
    known, spelling, ids = tokenizer(path)
    if len(ids) > REMEMBERED:
        ids.clear()
    merge, odd = known.model.tokenize, {}
    for w in words:
        if w not in ids:
            low = w.lower()
            if PLAIN.fullmatch(low):
                if low not in ids:
                    ids[low] = b"".join([t.id.to_bytes(4, "little") for t in merge(low.translate(spelling))])
                ids[w] = ids[low]
            else:
                odd[w] = None
    for part in batched(odd, 10_000):
        for k, e in zip(part, known.encode_batch(list(part), add_special_tokens=False), strict=True):
            ids[k] = np.array(e.ids, "<u4").tobytes()
    return [ids[w] for w in words]


def chunk_ids(chunk: Chunk, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a chunk, each text closed by id 0, and where each text begins and ends among them.

    No token of the vocabulary spans white space, and nothing in it looks beyond, so texts are tokenised word by word.
    """
    _, starts, ends = chunk.runs(INSIDE)
    last = ends - 1
    cut = (ends - starts > 1) & MARK[chunk.data[last]] & LETTER[chunk.data[last - 1]] if len(ends) else np.zeros(0, bool)
    starts, ends = np.sort(np.concatenate([starts, last[cut]])), np.sort(np.concatenate([ends, last[cut]]))
    inside = np.zeros(len(chunk.data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    data = chunk.data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    found = word_ids(words.dictionary.to_pylist(), path)
    sizes = np.array([len(f) // 4 for f in found], np.int64)
    flat = np.frombuffer(b"".join(found), "<u4")
    which = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    counts = sizes[which] if len(which) else np.zeros(0, np.int64)
    place, _ = spans_inside((np.cumsum(sizes) - sizes)[which] if len(which) else counts, counts)
    held = np.bincount(chunk.owner(starts), weights=counts, minlength=chunk.n).astype(np.int64) if len(starts) else np.zeros(chunk.n, np.int64)
    bounds = np.concatenate([[0], np.cumsum(held + 1)])
    ids = np.zeros(bounds[-1], "<u4")
    body = np.ones(len(ids), bool)
    body[bounds[1:] - 1] = False
    ids[body] = flat[place]
    return ids, bounds


def pieces(docs: DataFrame, path: str, capacity: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, key``: documents cut after every ``capacity`` ids; ``key`` is the row's own."""

    def run(batches):
        for chunk in chunks(batches):
            ids, bounds = chunk_ids(chunk, path)
            n = np.diff(bounds)
            piece, owner = spans_inside(np.zeros(chunk.n, np.int64), -(-n // capacity))
            start = piece * capacity
            length = np.minimum(capacity, n[owner] - start)
            at = bounds[owner] + start
            crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    cut = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    cut = cut.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return write_stage(cut.withColumn("key", F.monotonically_increasing_id()), "pieces")


def sweep(size: np.ndarray, is_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best fit over one range: rows sorted by size, largest first.

    Returns the rows of the placed pieces, the row of the gap of each, the space that the gap had then, and what each gap has
    left at the end.  Equal sizes are handled as one run, so the work is in arrays.
    """
    docs, gaps = np.flatnonzero(is_doc), np.flatnonzero(~is_doc)
    free = np.where(is_doc, 0, size)
    stack: list[tuple[int, np.ndarray]] = []
    later: list[tuple[int, int, np.ndarray]] = []  # gaps that shrank below the sizes swept so far
    for at in np.flatnonzero(np.diff(size[gaps], prepend=-1)).tolist() if len(gaps) else []:
        same = gaps[at : at + np.searchsorted(-size[gaps[at:]], -size[gaps[at]], side="right")]
        later.append((-int(size[gaps[at]]), -len(later), same))
    heapq.heapify(later)
    serial, out = len(later) + 1, ([], [], [])
    edges = [*np.flatnonzero(np.diff(size[docs], prepend=-1)).tolist(), len(docs)]
    for a, b in pairwise(edges):
        s, waiting = int(size[docs[a]]), docs[a:b]
        while later and -later[0][0] >= s:
            g, _, rows = heapq.heappop(later)
            stack.append((-g, rows))
        while len(waiting) and stack:
            g, rows = stack.pop()
            m = min(len(waiting), len(rows))
            if m < len(rows):
                stack.append((g, rows[m:]))
            taken = rows[:m]
            out[0].append(waiting[:m])
            out[1].append(taken)
            out[2].append(np.full(m, g, np.int64))
            free[taken] = g - s
            waiting = waiting[m:]
            if g - s >= s:
                stack.append((g - s, taken))
            elif g > s:
                heapq.heappush(later, (s - g, serial, taken))
                serial += 1
    placed, gap, before = (np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out)
    return placed, gap, before, free


STATE = "kind string, range int, rank long, key long, size long, bin long, before long"


def _sweep_range(batches):
    """Sweep the range of a task: ``placed`` pieces, ``doc``s and ``gap``s left with their ranks, ``low`` gaps below the range."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    size, is_doc = table["size"].to_numpy(), table["is_doc"].to_numpy()
    key, part = table["key"].to_numpy(), TaskContext.get().partitionId()
    placed, gap, before, free = sweep(size, is_doc)
    unplaced = is_doc.copy()
    unplaced[placed] = False
    docs = np.flatnonzero(unplaced)
    left = np.flatnonzero(~is_doc & (free > 0))
    high = left[free[left] >= size[-1]]
    high = high[np.argsort(-free[high], kind="stable")]
    low = left[free[left] < size[-1]]

    def rows(kind, rank, key_, size_, bin_, before_):
        n = len(rank)
        columns = [pa.array([kind] * n, pa.string()), pa.array(np.full(n, part, np.int32)), pa.array(rank), pa.array(key_), pa.array(size_), pa.array(bin_), pa.array(before_)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "range", "rank", "key", "size", "bin", "before"])

    none = np.zeros(0, np.int64)
    yield rows("placed", np.zeros(len(placed), np.int64), key[placed], size[placed], key[gap], before)
    for kind, at, sizes in (("doc", docs, size), ("gap", high, free), ("low", low, free)):
        zero = np.zeros(len(at), np.int64) if len(at) else none
        yield rows(kind, np.arange(len(at)), key[at], sizes[at], zero, zero)


def chain(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From ``range -> (pieces left, gaps left)``: ``(piece range, first rank, gap range, last rank, count)``.

    Ranges come largest first; a piece takes the smallest gap of the nearest larger range that still has one.
    """
    stack, flows = [], []
    for part in sorted(left):
        docs, gaps = left[part]
        taken = 0
        while taken < docs and stack:
            other, n = stack.pop()
            m = min(n, docs - taken)
            flows.append((part, taken, other, n - 1, m))
            taken += m
            if n > m:
                stack.append((other, n - m))
        if gaps:
            stack.append((part, gaps))
    return flows


def superstep(waiting: DataFrame, gaps: DataFrame, rows: int, range_rows: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """One superstep over ``waiting (key, size)`` and ``gaps (key, size)``: placements, pieces left, gaps, placements across ranges."""
    spark = waiting.sparkSession
    together = waiting.select("size", F.lit(True).alias("is_doc"), "key").unionByName(gaps.select("size", F.lit(False).alias("is_doc"), "key"))
    order = [F.col("size").desc(), F.col("is_doc").asc(), F.col("key").asc()]
    ranges = -(-rows // range_rows)
    dealt = together.repartitionByRange(ranges, *order) if ranges > 1 else together.coalesce(1)
    done = write_stage(dealt.sortWithinPartitions(*order).mapInArrow(_sweep_range, STATE), "sweep")
    placed = done.filter("kind = 'placed'").select("key", "size", "bin", "before")
    docs, high = done.filter("kind = 'doc'"), done.filter("kind = 'gap'")
    shrunk = done.filter("kind IN ('gap', 'low')").select("key", "size")
    counts = done.filter("kind IN ('doc', 'gap')").groupBy("range", "kind").count().collect() if ranges > 1 else []
    by_range: dict[int, tuple[int, int]] = {}
    for r in counts:
        d, g = by_range.get(r["range"], (0, 0))
        by_range[r["range"]] = (r["count"], g) if r["kind"] == "doc" else (d, r["count"])
    flows = chain(by_range)
    if not flows:
        return placed, docs.select("key", "size"), shrunk, 0
    bases = np.cumsum([0, *[f[4] for f in flows]]).tolist()
    plan = F.broadcast(values(spark, [(*f, b) for f, b in zip(flows, bases)], "doc_range int, first long, gap_range int, last long, n long, base long"))
    pair_docs = docs.join(plan, (F.col("range") == F.col("doc_range")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")), "left")
    pair_docs = pair_docs.select("key", "size", (F.col("base") + F.col("rank") - F.col("first")).alias("pair"))
    pair_gaps = high.join(plan, (F.col("range") == F.col("gap_range")) & (F.col("rank") <= F.col("last")) & (F.col("rank") > F.col("last") - F.col("n")))
    pair_gaps = pair_gaps.select(F.col("key").alias("bin"), F.col("size").alias("before"), (F.col("base") + F.col("last") - F.col("rank")).alias("pair"))
    met = write_stage(pair_docs.filter("pair IS NOT NULL").join(pair_gaps, "pair").select("key", "size", "bin", "before"), "met")
    used = met.select(F.col("bin").alias("key"), (F.col("before") - F.col("size")).alias("now"))
    after = shrunk.join(used, "key", "left").select("key", F.coalesce("now", "size").alias("size")).filter("size > 0")
    return placed.unionByName(met), pair_docs.filter("pair IS NULL").select("key", "size"), after, bases[-1]


def best_fit(items: DataFrame, capacity: int = CAPACITY, range_rows: int | None = None) -> DataFrame:
    """``key, bin, offset`` for every row of ``items (key, size)``, sizes from 1 to ``capacity``, keys unique and from 0 up.

    An empty table gives an empty table.  Equal sizes are ranked by ``key``.  Items as large as the capacity fill a bin of
    their own, numbered ``-1 - key``; the other bins are numbered from 0.
    """
    range_rows = range_rows or RANGE_ROWS
    spark = items.sparkSession
    whole = items.filter(F.col("size") >= capacity).select("key", (-1 - F.col("key")).alias("bin"), F.lit(0).cast("long").alias("offset"))
    parts = items.filter(F.col("size") < capacity)
    stats = parts.groupBy(F.least(F.floor(F.lit(capacity) / F.col("size")), F.lit(BANDS)).cast("int").alias("k")).agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("size").alias("least")).collect()
    bands = sorted(stats, key=lambda r: r.k)
    gaps, opened, open_rows, out = None, 0, 0, [whole]
    for i, band in enumerate(bands):
        waiting, n = parts.filter(F.least(F.floor(F.lit(capacity) / F.col("size")), F.lit(BANDS)) == band.k).select("key", "size"), band.n
        total, across, smallest = band.s, None, min(b.least for b in bands[i:])
        while n:
            if across == 0 or gaps is None:  # no gap holds what waits
                need = -(-total // capacity) if band.k == BANDS else -(-n // band.k)
                new = spark.range(opened, opened + need).select(F.col("id").alias("key"), F.lit(capacity).cast("long").alias("size"))
                gaps = new if gaps is None else gaps.unionByName(new)
                opened, open_rows = opened + need, open_rows + need
            placed, waiting, gaps, across = superstep(waiting, gaps, n + open_rows, range_rows)
            out.append(placed.select("key", "bin", (capacity - F.col("before")).alias("offset")))
            gaps = gaps.filter(F.col("size") >= smallest)
            if across:
                gaps = write_stage(gaps, "gaps")
                waiting = write_stage(waiting, "waiting")
            counted = waiting.agg(F.lit("w").alias("what"), F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s"))
            counted = counted.unionByName(gaps.agg(F.lit("g").alias("what"), F.count("*").alias("n"), F.lit(0).cast("long").alias("s")))
            now = {r.what: r for r in counted.collect()}
            n, total, open_rows = now["w"].n, now["w"].s, now["g"].n
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def pack_best_fit(docs: DataFrame, path: str, capacity: int = CAPACITY, range_rows: int | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    ``path`` names the tokenizer file, readable on every executor.  A null text is empty: one piece with id 0 alone.  Every
    row is a document of its own, whether its ``doc_id`` repeats or is null.  Only ``doc_id`` and ``text`` are read, whatever
    other columns there are; an empty table gives an empty result.
    """
    cut = pieces(docs, path, capacity)
    placed = best_fit(cut.select("key", F.col("length").alias("size")), capacity, range_rows)
    return cut.join(placed, "key").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op11_best_fit_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best_fit(read(spark, sf_dir, "documents"), vocabulary())
