"""Repeated byte strings over a corpus by a sampled suffix array (every string of ``length`` bytes is judged).

Indexing all suffixes would move a hundred times the corpus.  A sparse suffix array is enough: of each window of
``length`` bytes the suffix with the smallest fingerprint of its leading ``LEAD`` bytes is kept (about one in 35), and as
that choice depends on the window alone, equal windows anywhere keep the same suffix.  Consecutive windows that keep one
suffix are a stretch.

1. Documents are dealt to groups of a few megabytes by a hash of their id.
2. Each group emits its distinct stretches as (suffix, digest, first place), no text; *sampled splitters* over the leading
   bytes range-partition them.  A bucket sorts them by suffix and digest: a stretch with an earlier equal is covered as a
   whole, a suffix whose stretches differ must be compared, all others need nothing.  A suffix that lies on a splitter
   meets its like across the boundary: it is spread over the adjoining buckets and always compared.
3. Only the text of the earliest stretch of each digest, and only of suffixes with several digests, goes to a second set of
   buckets.  There the windows are sorted byte by byte by multikey quicksort; each one that is equal to a window with
   smaller ``(doc_id, start)`` is covered.  Of suffixes on a boundary, or with more than ``hot`` different stretches, single
   windows go as two fingerprints, dealt by these, so no bucket receives a hot suffix whole.
4. Covered intervals return to the group of their document.

Step 3 compares bytes.  Steps 1 and 2 rest on fingerprints: two different stretches of one suffix count as equal with
probability of about 2**-64 per pair, two different windows of a hot suffix with 2**-128.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm.common import fresh, group_of, query, read, shuffle_partitions, text_bytes, with_key
from tracemill.llm.scan import CODES, Chunk, Prefix, chunks, mix, spans_inside

LEAD = 32
GROUP_BYTES = 2 << 20
#: Sampled suffixes from which the splitters are chosen, and buckets per shuffle partition.
SPLITTER_SAMPLE = 20_000
BUCKETS_PER_PARTITION = 4
#: Bytes of text per shuffle partition beyond which there are more of them than the session asks for.
PARTITION_BYTES = 64 << 20
#: Different stretches of one suffix (about 170 bytes each) that one bucket compares as text.
HOT_STRETCHES = 20_000

TOP32 = np.uint64(0xFFFFFFFF00000000)
LOW32 = np.uint64(0xFFFFFFFF)


def sampled_suffixes(chunk: Chunk, length: int):
    """Runs of windows that keep the same suffix: fingerprint and leading bytes of the suffix, text, first window, windows."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = chunk.data
    if len(data) < length or not ((chunk.ends - chunk.starts) >= length).any():
        return none
    h = CODES[0][data]
    for i, step in enumerate((1, 2, 4, 8, 16)):
        h = h[:-step] * (CODES[1][i] | np.uint64(1)) + h[step:]
    h = mix(h)  # h[p]: leading LEAD bytes of the suffix at p
    span = length - LEAD + 1
    low = (h & TOP32) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    low &= LOW32
    long = chunk.ends - chunk.starts >= length
    starts, last = chunk.starts[long], chunk.ends[long] - length
    inside = np.zeros(len(low) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, last + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    new = np.empty(len(low), bool)
    new[0] = True
    np.not_equal(low[1:], low[:-1], out=new[1:])
    new[starts] = True
    new &= valid
    first = np.flatnonzero(new)
    stop = np.zeros(len(low) + 1, bool)
    stop[first[1:]] = True
    stop[last + 1] = True
    ends = np.flatnonzero(stop)
    ends = ends[np.searchsorted(ends, first, side="right")]
    at = low[first].astype(np.int64)
    lead = np.zeros(len(at), np.uint64)
    for i in range(6):
        lead = (lead << np.uint64(8)) | data[at + i].astype(np.uint64)
    keys = h[at]
    return keys, (lead << np.uint64(16)) | (keys >> np.uint64(48)), chunk.owner(first), first, ends - first


def stretches(batches, length: int):
    """All runs of a group's texts, sorted by (suffix, digest, doc, start), and the bytes of chosen ones.

    Columns: ``key`` and ``lead`` of the kept suffix, ``digest`` of the whole stretch, ``doc``, first window ``start``, number
    of windows ``n``; ``first`` marks the first occurrence of each (suffix, digest).  ``take(rows)`` gives stretch bytes.
    """
    parts = {c: [] for c in ("key", "lead", "digest", "doc", "start", "n", "at")}
    data, base = [], 0
    for chunk in chunks(batches):
        key, lead, text, first, n = sampled_suffixes(chunk, length)
        if len(key):
            digest = Prefix(CODES[1][chunk.data]).span(first, first + n + length - 1)
            ids = chunk.batch.column("doc_id").to_numpy(zero_copy_only=False)
            for c, value in zip(parts, (key, lead, digest, ids[text], first - chunk.starts[text], n, first + base), strict=True):
                parts[c].append(value)
        data.append(chunk.data)
        base += len(chunk.data)
    if not parts["key"]:
        return None, None
    runs = {c: np.concatenate(v) for c, v in parts.items()}
    order = np.lexsort((runs["start"], runs["doc"], runs["digest"], runs["key"]))
    runs = {c: v[order] for c, v in runs.items()}
    runs["first"] = changes(runs["key"], runs["digest"])
    buffer = np.concatenate(data)
    return runs, lambda rows: buffer[spans_inside(runs["at"][rows], runs["n"][rows] + length - 1)[0]]


def changes(*columns: np.ndarray) -> np.ndarray:
    """Rows that differ from the row before in any column."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def equal_windows(buffer: np.ndarray, at: np.ndarray, counts: np.ndarray, doc: np.ndarray, start: np.ndarray, length: int):
    """Windows equal to a window with smaller (doc, start).  Segment ``i`` has ``counts[i]`` windows from ``buffer[at[i]]`` on.

    Multikey quicksort of the window suffixes, eight bytes being one character: a group of suffixes equal so far is
    partitioned by its next character; suffixes alone in their group leave, groups without a difference stay as they are.
    """
    rank = np.lexsort((start, doc))
    at, counts = at[rank], counts[rank]
    where, owner = spans_inside(at, counts)
    covered = np.zeros(len(where), bool)
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    chars = np.zeros(len(buffer) + 1, U64)
    for i in range(8):
        chars = (chars << U64(8)) | padded[i : i + len(chars)]
    rows = np.argsort(chars[where], kind="stable")  # equal ones stay in the order of (doc, start)
    new = changes(chars[where[rows]])
    for depth in [*range(8, length - 8, 8), length - 8]:
        alone = new & np.append(new[1:], True)
        rows, new = rows[~alone], new[~alone]
        if not len(rows):
            return covered, rank[owner], where - at[owner]
        char = chars[where[rows] + depth]
        group = np.cumsum(new) - 1
        differs = np.append(False, (char[1:] != char[:-1]) & ~new[1:])
        mixed = np.flatnonzero(np.logical_or.reduceat(differs, np.flatnonzero(new))[group])
        if len(mixed):
            order = mixed[np.lexsort((char[mixed], group[mixed]))]
            rows[mixed], char[mixed] = rows[order], char[order]
            new = changes(group, char)
    covered[rows[~new]] = True
    return covered, rank[owner], where - at[owner]


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of intervals per document, sorted."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    group = np.cumsum(np.diff(doc, prepend=doc[0] - 1) != 0)
    shift = group * (int(end.max()) + 1)  # one line for all documents
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], reach[last] - shift[last]


def runs_of(owner: np.ndarray, offset: np.ndarray):
    """Runs of consecutive offsets with one owner (input sorted): owner, first offset, how many."""
    if not len(owner):
        return owner, offset, offset
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] != offset[:-1] + 1)
    first = np.flatnonzero(new)
    return owner[first], offset[first], np.diff(np.append(first, len(owner)))


I64, U64 = np.int64, np.uint64
UNITS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("edge", pa.bool_()), ("keys", pa.binary()), ("digests", pa.binary()), ("doc", pa.binary()), ("start", pa.binary())])
MARKS = pa.schema([("g", pa.int32()), ("keys", pa.binary()), ("digests", pa.binary()), ("mark", pa.binary())])
PIECES = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("doc", pa.binary()), ("start", pa.binary()), ("n", pa.binary()), ("bytes", pa.binary())])
COVER = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
#: What a bucket says of a stretch: equal to an earlier one of another group; others of its suffix are in its group only;
#: in other groups too; the same, but so many that windows are compared by fingerprints.
COVERED, LOCAL, SHARED, HOT = 1, 2, 3, 4
#: Kinds of pieces: intervals already decided, stretches of text, fingerprints of single windows.
DECIDED, TEXT, PRINTS = 0, 1, 2


def ddl(schema: pa.Schema) -> str:
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as bytes, lowest bytes first: the zero bytes of small numbers lie together and compress away."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def joined(parts: list[bytes], read=unpack) -> np.ndarray:
    return np.concatenate([read(p) for p in parts]) if parts else np.zeros(0, I64)


def words(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, U64)


def split_by(bucket: np.ndarray):
    """Positions of each bucket: (bucket, index array); none for no positions."""
    if not len(bucket):
        return iter(())
    order = np.argsort(bucket, kind="stable")
    values, first = np.unique(bucket[order], return_index=True)
    return zip(values.tolist(), np.split(order, first[1:]), strict=True)


def table_of(rows: list, schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def emit_units(splitters: np.ndarray, length: int):
    """The distinct (suffix, digest) pairs of a group, each with its first occurrence, to the buckets of their ranges.

    Suffixes whose leading bytes are a splitter's lie on a boundary: they are spread over the buckets that meet there.
    """

    def run(table: pa.Table) -> pa.Table:
        runs, _ = stretches(table.to_batches(), length)
        if runs is None:
            return UNITS.empty_table()
        key, lead, digest, doc, start = (runs[c][runs["first"]] for c in ("key", "lead", "digest", "doc", "start"))
        low, high = np.searchsorted(splitters, lead, side="left"), np.searchsorted(splitters, lead, side="right")
        edge = high > low
        bucket = low + (digest % (high - low + 1).astype(U64)).astype(I64)
        g = table.column("g")[0].as_py()
        rows = [(b >> 1, g, bool(b & 1), key[i].tobytes(), digest[i].tobytes(), pack(doc[i]), pack(start[i])) for b, i in split_by(bucket * 2 + edge)]
        return table_of(rows, UNITS)

    return run


def mark_units(hot: int):
    """One bucket: sorted by suffix and digest, neighbours compared, marks sent back to the groups."""

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in UNITS.names}
        key, digest = joined(columns["keys"], words), joined(columns["digests"], words)
        doc, start = joined(columns["doc"]), joined(columns["start"])
        sizes = [len(k) // 8 for k in columns["keys"]]
        g, edge = np.repeat(np.array(columns["g"], np.int32), sizes), np.repeat(np.array(columns["edge"], bool), sizes)
        order = np.lexsort((start, doc, digest, key))
        key, digest, g, edge = key[order], digest[order], g[order], edge[order]
        new_key, new_unit = changes(key), changes(key, digest)
        at = np.flatnonzero(new_key)
        which = np.cumsum(new_key) - 1
        digests = np.add.reduceat(new_unit.astype(I64), at)[which]
        groups = (np.minimum.reduceat(g, at) != np.maximum.reduceat(g, at))[which]
        mark = np.where(digests > 1, np.where(groups, np.where(digests > hot, HOT, SHARED), LOCAL), 0)
        mark = np.where(edge, HOT, mark)  # the other side of the boundary is not seen here
        mark = np.where(new_unit, mark, COVERED).astype(np.uint8)
        keep = np.flatnonzero(mark)
        rows = [(one, key[k].tobytes(), digest[k].tobytes(), mark[k].tobytes()) for one, i in split_by(g[keep]) for k in [keep[i]]]
        return table_of(rows, MARKS)

    return run


def marks_of(runs: dict, marks: pa.Table) -> np.ndarray:
    """The mark of each run (0: none)."""
    first = np.flatnonzero(runs["first"])
    key, digest = joined(marks.column("keys").to_pylist(), words), joined(marks.column("digests").to_pylist(), words)
    mark = joined(marks.column("mark").to_pylist(), lambda raw: np.frombuffer(raw, np.uint8))
    keys, digests = np.concatenate([runs["key"][first], key.astype(U64)]), np.concatenate([runs["digest"][first], digest.astype(U64)])
    order = np.lexsort((np.arange(len(keys)), digests, keys))
    pair = np.flatnonzero(~changes(keys[order], digests[order]))
    out = np.zeros(len(first), np.uint8)
    out[order[pair - 1]] = mark[order[pair] - len(first)]
    return out[np.cumsum(runs["first"]) - 1]


def emit_pieces(splitters: np.ndarray, length: int):
    """What a group can decide, and the text of its stretches that others must be compared with.

    A stretch that repeats an earlier one is covered as a whole, so of equal stretches only the earliest sends its text, and
    none does if all stretches of the suffix are equal.
    """

    def run(key, texts: pa.Table, marks: pa.Table) -> pa.Table:
        runs, take = stretches(texts.to_batches(), length) if texts.num_rows else (None, None)
        if runs is None:
            return PIECES.empty_table()
        mark = marks_of(runs, marks)
        whole = ~runs["first"] | (mark == COVERED)
        found = [(runs["doc"][whole], runs["start"][whole], runs["start"][whole] + runs["n"][whole] + length - 1)]
        rows, buckets = [], len(splitters) + 1
        left = np.flatnonzero(~whole & (mark >= LOCAL))
        if len(left):
            doc, start, n, lead, mark = (x[left] for x in (runs["doc"], runs["start"], runs["n"], runs["lead"], mark))
            data = take(left)
            at = np.cumsum(n + length - 1) - (n + length - 1)
            covered, owner, offset = equal_windows(data, at, n, doc, start, length)
            s, o, w = runs_of(owner[covered], offset[covered])
            found.append((doc[s], start[s] + o, start[s] + o + w + length - 1))
            s, o, w = runs_of(*(x[~covered & (mark[owner] == SHARED)] for x in (owner, offset)))
            for b, i in split_by(np.searchsorted(splitters, lead[s], side="left")):
                text = data[spans_inside(at[s[i]] + o[i], w[i] + length - 1)[0]].tobytes()
                rows.append((b, TEXT, pack(doc[s[i]]), pack(start[s[i]] + o[i]), pack(w[i]), text))
            s, o = (x[~covered & (mark[owner] == HOT)] for x in (owner, offset))
            if len(s):
                where = at[s] + o
                one, two = (Prefix(c[data]).span(where, where + length) for c in CODES)
                for b, i in split_by((one % U64(buckets)).astype(I64)):
                    rows.append((b, PRINTS, pack(doc[s[i]]), pack(start[s[i]] + o[i]), b"", one[i].tobytes() + two[i].tobytes()))
        doc, start, end = merged(*(np.concatenate([f[i] for f in found]) for i in range(3)))
        if len(doc):
            rows.append((texts.column("g")[0].as_py() % buckets, DECIDED, pack(doc), pack(start), pack(end), b""))
        return table_of(rows, PIECES)

    return run


def compare_pieces(length: int):
    """All pieces of a bucket together: covered intervals, by document."""

    def run(table: pa.Table) -> pa.Table:
        rows = {kind: [] for kind in (DECIDED, TEXT, PRINTS)}
        for r in zip(*(table.column(c).to_pylist() for c in PIECES.names[1:]), strict=True):
            rows[r[0]].append(r[1:])
        doc, start, n = (joined([r[i] for r in rows[DECIDED]]) for i in range(3))
        found = [(doc, start, n)]
        if rows[TEXT]:
            doc, start, n = (joined([r[i] for r in rows[TEXT]]) for i in range(3))
            data = np.frombuffer(b"".join(r[3] for r in rows[TEXT]), np.uint8)
            size = n + length - 1
            covered, owner, offset = equal_windows(data, np.cumsum(size) - size, n, doc, start, length)
            s, o, w = runs_of(owner[covered], offset[covered])
            found.append((doc[s], start[s] + o, start[s] + o + w + length - 1))
        if rows[PRINTS]:
            doc, start = (joined([r[i] for r in rows[PRINTS]]) for i in range(2))
            one, two = (np.concatenate([words(r[3]).reshape(2, -1)[i] for r in rows[PRINTS]]) for i in range(2))
            order = np.lexsort((start, doc, two, one))
            again = order[~changes(one[order], two[order])]
            found.append((doc[again], start[again], start[again] + length))
        doc, start, end = merged(*(np.concatenate([f[i] for f in found]) for i in range(3)))
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (doc, start, end)], schema=COVER)

    return run


def repeated_spans(docs: DataFrame, length: int = 100, hot: int = HOT_STRETCHES) -> tuple[DataFrame, DataFrame, int]:
    """(documents dealt to groups, covered intervals ``doc_id, start, end`` in bytes, number of groups).

    ``doc_id`` must be unique and not null; a column ``own_id`` goes with the documents.
    """
    spark = docs.sparkSession
    if length < LEAD + 8:
        raise ValueError(f"length must be at least {LEAD + 8}")
    size = text_bytes(docs)
    groups = max(1, -(-size // GROUP_BYTES))
    parts = max(shuffle_partitions(spark), -(-size // PARTITION_BYTES))
    n_buckets = BUCKETS_PER_PARTITION * parts
    dealt = docs.select("doc_id", "text", *[c for c in docs.columns if c == "own_id"], group_of("doc_id", groups).alias("g")).repartition(max(1, min(groups, parts)), "g")

    share = min(1.0, SPLITTER_SAMPLE * 35 / max(size, 1))

    def leads(batches):
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sampled_suffixes(chunk, length)[1].view(I64))], ["lead"])

    sample = docs.select("text").sample(share, 7).mapInArrow(leads, "lead long").limit(20 * SPLITTER_SAMPLE).toPandas().lead.to_numpy().view(U64)
    ordered = np.sort(sample)
    splitters = ordered[np.linspace(0, len(ordered) - 1, n_buckets + 1).astype(int)[1:-1]] if len(ordered) else ordered

    units = dealt.groupBy("g").applyInArrow(emit_units(splitters, length), ddl(UNITS))
    marks = units.repartition(parts, "bucket").groupBy("bucket").applyInArrow(mark_units(hot), ddl(MARKS))
    pieces = dealt.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(emit_pieces(splitters, length), ddl(PIECES))
    spans = pieces.repartition(parts, "bucket").groupBy("bucket").applyInArrow(compare_pieces(length), ddl(COVER))
    return dealt, spans.withColumn("g", group_of("doc_id", groups)), groups


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])


def keep_rest(with_text: bool, with_digest: bool):
    """Remove the intervals of each document from its text."""

    def run(key, texts: pa.Table, spans: pa.Table) -> pa.Table:
        doc, start, end = merged(*(spans.column(c).to_numpy().astype(I64) for c in ("doc_id", "start", "end")))
        out = []
        for batch in texts.to_batches(max_chunksize=256):
            own = batch.column("own_id" if "own_id" in batch.schema.names else "doc_id").to_pylist()
            for d, name, text in zip(batch.column("doc_id").to_pylist(), own, batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                a, b = np.searchsorted(doc, d), np.searchsorted(doc, d, side="right")
                kept, at = [], 0
                for s, e in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True):
                    kept.append((at, s))
                    at = e
                kept.append((at, len(raw)))
                digest = hashlib.sha256(b"".join(raw[s:e] for s, e in kept)).hexdigest() if with_digest else None
                whole = None
                if with_text and b > a:  # a character goes only if all its bytes go
                    for i, (s, e) in enumerate(kept):
                        while i and s > kept[i - 1][1] and s < len(raw) and raw[s] & 0xC0 == 0x80:
                            s -= 1
                        while e < len(raw) and raw[e] & 0xC0 == 0x80:
                            e += 1
                        kept[i] = s, e
                    for i in range(1, len(kept)):
                        kept[i] = max(kept[i][0], kept[i - 1][1]), max(kept[i][1], kept[i - 1][1])
                    whole = b"".join(raw[s:e] for s, e in kept).decode()
                out.append((name, len(raw), int((end[a:b] - start[a:b]).sum()), int(b - a), digest, whole if with_text and b > a else text if with_text else None))
        columns = list(zip(*out, strict=True)) if out else [()] * len(RESULT)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)], schema=RESULT)

    return run


def suffix_dedup(docs: DataFrame, length: int = 100, with_text: bool = True, with_digest: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` per document.

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier (smaller ``doc_id``, or the same
    document further left), judged on the input.  Rows with equal ids are documents of their own, ordered by a hash of their
    text; a null id comes after all others.  A null text counts as empty
    (its ``kept_text`` stays null); an empty table gives an empty result; other columns of ``docs`` are not read.  In
    ``kept_text`` a character goes only if all its bytes go; ``kept_sha256`` is over the exact remaining bytes.
    """
    rows, plain = with_key(docs.select("doc_id", "text"), "_row")
    own = [] if plain else [F.col("doc_id").cast("long").alias("own_id")]
    dealt, spans, _ = repeated_spans(rows.select(F.col("_row").alias("doc_id"), "text", *own), length)
    return dealt.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(keep_rest(with_text, with_digest), ddl(RESULT))


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """``docs`` with repeated text cut out and ``n_chars`` brought up to date; rows of which nothing is left go.

    Rows whose text was null or empty from the start stay.  All columns are kept in their order and with their types.
    Rows with equal or null ids are documents of their own.
    """
    key = fresh(docs, "_row")
    rows, _ = with_key(docs, key)
    spans = repeated_spans(rows.select(F.col(key).alias("doc_id"), "text"), length)[1]
    groups = max(1, -(-text_bytes(docs) // GROUP_BYTES))
    g = fresh(docs, "_g")
    dealt = rows.withColumn(g, group_of(key, groups))
    names = docs.columns
    kind = T.StructType([f for f in docs.schema.fields])
    out = dealt.groupBy(g).cogroup(spans.groupBy("g")).applyInArrow(_cut(names, key), kind)
    return out


def _cut(names: list[str], row_key: str):
    keep = keep_rest(True, False)

    def run(key, rows: pa.Table, spans: pa.Table) -> pa.Table:
        made = keep(key, rows.select([row_key, "text"]).rename_columns(["doc_id", "text"]), spans)
        rows = rows.select(names)
        text = made.column("kept_text")
        if "n_chars" in names:
            cut = pc.greater(made.column("n_spans"), 0)
            n = pc.if_else(cut, pc.utf8_length(text).cast(rows.schema.field("n_chars").type), rows.column("n_chars"))
            rows = rows.set_column(names.index("n_chars"), "n_chars", n)
        rows = rows.set_column(names.index("text"), "text", text.cast(rows.schema.field("text").type))
        gone = pc.and_(pc.greater(made.column("n_spans"), 0), pc.equal(pc.fill_null(pc.binary_length(text), 0), 0))
        return rows.filter(pc.invert(gone))

    return run


@query("op2_suffix_dedup")
def op2(spark, sf_dir):
    return suffix_dedup(read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")
