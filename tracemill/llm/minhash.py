"""Near copies by weighted Jaccard similarity of five-word shingles: BagMinHash, bands, verified overlap, components.

A text is a multiset of shingles.  Each distinct shingle owns a Poisson process over (time, weight, register); its weight
axis is cut into the blocks (0,1], (1,2], (2,4], (4,8], ... with a process of its own each, and of a block that the
multiplicity only partly reaches the points beyond are left out.  A register keeps its earliest point, so two texts agree
in a register with a probability of exactly their weighted Jaccard similarity.  Points are made in ascending time up to
a horizon that leaves all registers filled; a text with an empty register is done again with twice the horizon.

Texts with one bag are one node.  In each band bucket every member is verified against its most central one, that whose
buckets hold most members: among copies of one text it is the one with the fewest changes, and what is like any of them
is mostly like it.  Buckets whose members then lie in several components are compared across components.  A pair can only
reach the similarity if enough shingles are left besides those that no other such text has; they are counted in ``CELLS``
cells by hash, and two texts share in a cell at most the smaller count.  The few pairs that pass are verified.  So no link is lost, and unlike members of a large bucket make no pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import fresh, query, read, with_key, write_stage
from tracemill.llm.decontaminate import words_of
from tracemill.llm.scan import Chunk, Prefix, chunks, mix

SHINGLE, SIMILARITY = 5, 0.8
#: 32 bands of 4: a pair of similarity 0.8 is missed with probability 5e-8.
BANDS, ROWS = 32, 4
#: Members of a bucket whose numbers are compared in one task.
BLOCK = 16_384
CELLS = 128
U64 = np.uint64
MASK = (1 << 64) - 1


def shingles_of(chunk: Chunk, size: int):
    """Text index and fingerprint of every shingle; a shorter text with words is one shingle."""
    owner, words = words_of(chunk)
    if not len(words):
        return owner, words
    count = np.bincount(owner, minlength=chunk.n)
    last = np.cumsum(count)
    at = np.arange(len(words))
    first = last - count
    short = np.flatnonzero((count > 0) & (count < size))
    full = at[at + size <= last[owner]]
    prefix = Prefix(words)
    start = np.concatenate([full, first[short]])
    end = np.concatenate([full + size, last[short]])
    return owner[start], prefix.span(start, end)


def weights_of(owner: np.ndarray, prints: np.ndarray, n: int):
    """Distinct shingles of each text and their multiplicities."""
    salt = mix(np.arange(1, n + 1, dtype=U64))
    _, first, counts = np.unique(prints ^ salt[owner], return_index=True, return_counts=True)
    return owner[first], prints[first], counts


def bag_minhash(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m); rows of texts without elements are meaningless."""
    total = np.bincount(owner, weights=weight, minlength=n)
    best, value = np.full(n * m, np.inf), np.zeros(n * m, U64)
    todo = total > 0
    horizon = np.zeros(n)
    horizon[todo] = (np.log(m) + 8) / total[todo]
    while todo.any():
        mine = todo[owner]
        o, e, w = owner[mine], element[mine], weight[mine]
        level = 0
        while len(o):
            low, size = (0, 1) if level == 0 else (1 << (level - 1), 1 << (level - 1))
            partial = w < low + size
            _block(o, e, np.where(partial, w - low, size), size, level, horizon, m, best, value)
            beyond = w > low + size
            o, e, w = o[beyond], e[beyond], w[beyond]
            level += 1
        empty = ~np.isfinite(best.reshape(n, m)).all(axis=1) & (total > 0)
        todo &= empty
        horizon = horizon * 2
    return value.reshape(n, m)


def _block(owner, element, reached, size, level, horizon, m, best, value):
    """All points of one block of the weight axis before the horizon of their text."""
    seed = mix(element + U64((level + 1) * 0xD1342543DE82EF95 & MASK))
    time, until = np.zeros(len(owner)), horizon[owner]
    step = 0
    while len(owner):
        step += 1
        point = mix(seed + U64(step * 0x9E3779B97F4A7C15 & MASK))
        time = time - np.log(((point >> U64(11)).astype(float) + 0.5) * 2.0**-53) / (m * size)
        alive = time <= until
        owner, seed, time, until, reached, point = (x[alive] for x in (owner, seed, time, until, reached, point))
        draw = mix(point + U64(1))
        # Place on the weight axis inside the block, in whole units.
        inside = np.ones(len(owner), bool) if size == 1 else (mix(draw) % U64(size)).astype(np.int64) < reached
        at = (owner * m + (draw % U64(m)).astype(np.int64))[inside]
        when, what = time[inside], point[inside]
        earlier = when < best[at]
        at, when, what = at[earlier], when[earlier], what[earlier]
        np.minimum.at(best, at, when)
        won = best[at] == when
        value[at[won]] = what[won]


SIGNATURE = "doc_id long, n long, d1 long, d2 long, bands array<long>"


def signatures(size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS):
    def run(batches):
        for chunk in chunks(batches):
            owner, prints = shingles_of(chunk, size)
            n = chunk.n
            count = np.bincount(owner, minlength=n)
            o, e, w = weights_of(owner, prints, n) if len(owner) else (owner, prints, owner)
            sums = [np.zeros(n, U64), np.zeros(n, U64)]
            for i, s in enumerate(sums):  # an order-free digest of the bag
                np.add.at(s, o, mix(mix(e + U64(i)) + w.astype(U64)))
            sign = bag_minhash(o, e, w, n, bands * rows).reshape(n, bands, rows)
            key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (n, bands)).copy()
            for r in range(rows):
                key = mix(key * U64(31) + sign[:, :, r])
            used = count > 0
            sizes = np.where(used, bands, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(key[used].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [chunk.batch.column("doc_id"), pa.array(count), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), lists],
                ["doc_id", "n", "d1", "d2", "bands"],
            )

    return run


def bags(size: int = SHINGLE):
    """``doc_id, bag``: sorted fingerprints, the j-th copy of a shingle with one of its own."""

    def run(batches):
        for chunk in chunks(batches):
            owner, prints = shingles_of(chunk, size)
            order = np.lexsort((prints, owner))
            owner, prints = owner[order], prints[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (prints[1:] != prints[:-1])
            first = np.flatnonzero(new)
            copy = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
            prints = mix(prints + copy.astype(U64) * U64(0xA0761D6478BD642F))
            order = np.lexsort((prints, owner))
            parts = np.split(prints[order], np.cumsum(np.bincount(owner, minlength=chunk.n))[:-1])
            yield pa.RecordBatch.from_arrays([chunk.batch.column("doc_id"), pa.array([p.tobytes() for p in parts], pa.binary())], ["doc_id", "bag"])

    return run


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= least * (len(a) + len(b) - common) - 1e-9


def verify(least: float):
    def run(batches):
        for batch in batches:
            left, right = batch.column("bag_a").to_pylist(), batch.column("bag_b").to_pylist()
            keep = [similar(np.frombuffer(x, U64), np.frombuffer(y, U64), least) for x, y in zip(left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])

    return run


PAIRS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64())])


def own_tokens(batches):
    """``doc_id, token``: the fingerprints of each bag."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for start in range(0, batch.num_rows, 64):
            tokens = [np.frombuffer(x, np.int64) for x in batch.column("bag").slice(start, 64).to_pylist()]
            owner = np.repeat(ids[start : start + 64], [len(t) for t in tokens])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate(tokens))], ["doc_id", "token"])


def cells_of(batches):
    """``doc_id, n, cells``: shingles of a bag by cell, without those in ``alone``."""
    for batch in batches:
        made, sizes = [], []
        for bag, alone in zip(batch.column("bag").to_pylist(), batch.column("alone").to_pylist(), strict=True):
            tokens = np.frombuffer(bag, U64)
            counts = np.bincount(tokens % U64(CELLS), minlength=CELLS) - np.bincount(np.array(alone or [], np.int64).view(U64) % U64(CELLS), minlength=CELLS)
            made.append(counts.astype(np.int32).tobytes()), sizes.append(len(tokens))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n", "cells"])


def possible_pairs(least: float):
    """Pairs of different components whose bags may reach ``least``.

    ``cells`` counts by hash those of the ``n`` shingles that occur in some other text; two bags share at most the smaller
    count of each cell.
    """

    def run(key, table):
        same = key[1].as_py() == key[2].as_py()
        own, ids, c, n = (table.column(x).to_numpy() for x in ("own", "doc_id", "c", "n"))
        cells = np.frombuffer(b"".join(table.column("cells").to_pylist()), np.int32).reshape(-1, CELLS)
        left = cells.sum(axis=1)
        x = np.flatnonzero(own == key[1].as_py())
        y = x if same else np.flatnonzero(own == key[2].as_py())
        y = y[np.argsort(n[y], kind="stable")]
        pairs = [(np.zeros(0, np.int64),) * 2]
        for i in x[left[x] >= least * n[x]]:  # sizes of partners lie between these bounds
            a, b = np.searchsorted(n[y], [least * n[i], n[i] / least + 1])
            j = y[a:b]
            common = np.minimum(left[i], left[j])
            j = j[(c[j] != c[i]) & (common >= least * (n[i] + n[j] - common) - 1e-9)]
            j = j[ids[j] < ids[i]] if same else j
            for part in np.array_split(j, len(j) // 4096 + 1):
                common = np.minimum(cells[part], cells[i]).sum(axis=1)
                part = part[common >= least * (n[i] + n[part] - common) - 1e-9]
                pairs.append((np.maximum(ids[i], ids[part]), np.minimum(ids[i], ids[part])))
        return pa.Table.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in range(2)], schema=PAIRS)

    return run


def components(edges: DataFrame) -> DataFrame:
    """``node, c``: each node of ``edges`` (a, b) and the smallest node it is connected to; large-star, small-star rounds."""
    e = write_stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = write_stage(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == now:
            return e.select(F.col("u").alias("node"), F.col("v").alias("c")).union(e.select(F.col("v").alias("node"), F.col("v").alias("c"))).distinct()
        state = now


def minhash_dedup(docs: DataFrame, least: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """``doc_id, class_id, n_shingles, kept``: documents linked, directly or over others, by a similarity of at least ``least``.

    ``class_id`` is the smallest ``doc_id`` of the class, whose row is ``kept``.  Where ids repeat or are null, every row is a
    document of its own and ``class_id`` the number of the class's first row in the order of the ids (null last).  Words are
    those of decontamination; a text of one to four words is one shingle; texts without words (null, empty) stay alone.
    Only ``doc_id`` and ``text`` are read; an empty table gives an empty result.
    """
    rows, plain = with_key(docs.select("doc_id", "text"), "_row")
    found = _classes(rows.select(F.col("_row").alias("doc_id"), "text"), least, size).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    if plain:
        return found
    own = rows.select("_row", F.col("doc_id").cast("long").alias("own_id"))
    return found.join(own, F.col("doc_id") == F.col("_row")).select(F.col("own_id").alias("doc_id"), "class_id", "n_shingles", "kept")


def _classes(docs: DataFrame, least: float, size: int = SHINGLE) -> DataFrame:
    """``doc_id, class_id, n_shingles`` for ids that are unique and not null."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sig = write_stage(texts.mapInArrow(signatures(size), SIGNATURE), "signatures")
    bag_key = ["n", "d1", "d2"]
    reps = sig.filter("n > 0").groupBy(*bag_key).agg(F.min("doc_id").alias("rep"))
    nodes = sig.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.explode("bands").alias("key"))
    buckets = nodes.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("digest"))
    # Buckets with the same members count once.
    buckets = buckets.filter("size > 1").groupBy("size", "digest").agg(F.min("key").alias("key"), F.count("*").alias("times"))
    members = write_stage(nodes.join(buckets.select("key", (F.col("size") * F.col("times")).alias("weight")), "key"), "members")
    central = members.groupBy("doc_id").agg(F.sum("weight").alias("weight"))
    leaders = members.select("key", "doc_id").join(central, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("weight", F.negative("doc_id"))).alias("first"))
    bag = write_stage(texts.join(central.select("doc_id").hint("merge"), "doc_id").mapInArrow(bags(size), "doc_id long, bag binary"), "bags")

    def linked(pairs, label):
        # Shuffled at every size: whether a side could be broadcast would change with the corpus.
        pairs = pairs.distinct().hint("merge").join(bag.select("doc_id", F.col("bag").alias("bag_a")), "doc_id")
        both = pairs.hint("merge").join(bag.select(F.col("doc_id").alias("first"), F.col("bag").alias("bag_b")), "first")
        return write_stage(both.select(F.col("doc_id").alias("a"), F.col("first").alias("b"), "bag_a", "bag_b").mapInArrow(verify(least), "a long, b long"), label)

    comp = components(linked(members.join(leaders, "key").filter("doc_id <> first").select("doc_id", "first"), "links"))
    # A bucket with several components: its members' numbers, in blocks of a bounded size.
    here = members.select("key", "doc_id").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("c", F.coalesce("c", "doc_id"))
    here = write_stage(here, "placed")
    several = here.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("size")).filter("lo <> hi")
    still = write_stage(here.join(several.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "key"), "open")
    tokens = bag.join(still.select("doc_id").distinct().hint("merge"), "doc_id").mapInArrow(own_tokens, "doc_id long, token long")
    shared = tokens.groupBy("token").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("texts")).filter("texts = 1")
    alone = shared.groupBy("doc_id").agg(F.collect_list("token").alias("alone"))
    asked = bag.join(still.select("doc_id").distinct().hint("merge"), "doc_id").join(alone.hint("merge"), "doc_id", "left")
    numbers = asked.mapInArrow(cells_of, "doc_id long, n long, cells binary")
    jobs = (
        still.join(numbers, "doc_id")
        .withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "c", "n", "cells")
    )
    late = linked(jobs.groupBy("key", "x", "y").applyInArrow(possible_pairs(least), "doc_id long, first long"), "late")
    if not late.isEmpty():  # components that the late links join
        label = comp.select("node", "c")
        over = late.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left")
        joined = components(over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).toDF("c", "top")
        every = comp.union(joined.select("c", "c")).distinct()
        comp = every.join(joined, "c", "left").select("node", F.coalesce("top", "c").alias("c")).groupBy("node").agg(F.min("c").alias("c"))
    final = sig.select("doc_id", "n", "d1", "d2").join(reps, bag_key, "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    final = final.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    return final.select("doc_id", F.coalesce("c", "rep").alias("class_id"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each class, that with the smallest id (null last); all columns of ``docs``.  Ids may repeat or be null."""
    key, name = fresh(docs, "_row"), fresh(docs, "_kept")
    rows, _ = with_key(docs, key)
    kept = _classes(rows.select(F.col(key).alias("doc_id"), "text"), least).filter("doc_id = class_id").select(F.col("doc_id").alias(name))
    return rows.join(kept.hint("merge"), F.col(key) == F.col(name), "left_semi").select(docs.columns)


@query("op7_minhash_dedup")
def op7(spark, sf_dir):
    return minhash_dedup(read(spark, sf_dir, "documents"))
