"""Whole texts as byte arrays inside Arrow tasks: chunks, spans, and fingerprints of spans.

Texts arrive as Arrow string columns; a chunk is a few megabytes of consecutive texts (or one longer text), so the
working memory of a task does not depend on the number or the length of the other texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once in a task.
CHUNK_BYTES = 2 << 20

MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(seed: int = 0) -> np.ndarray:
    """A pseudo-random 64-bit code per byte value."""
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(256 * seed + 1)) * np.uint64(MULTIPLIER))


CODES = (byte_codes(0), byte_codes(1))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """``MULTIPLIER ** i`` (or its inverse) modulo 2**64 for ``i < n``."""
    key = int(inverse)
    if key not in _POWERS or len(_POWERS[key]) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = np.full(size, INVERSE if inverse else MULTIPLIER, np.uint64)
        base[0] = 1
        _POWERS[key] = np.multiply.accumulate(base)
    return _POWERS[key][:n]


class Prefix:
    """Running polynomial sums of a sequence of 64-bit codes; gives the fingerprint of any span."""

    def __init__(self, codes: np.ndarray):
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * powers(len(codes)), out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Fingerprints of ``[start, end)``; equal content gives equal values wherever it lies."""
        raw = (self.sums[end] - self.sums[start]) * powers(len(self.sums), True)[start]
        return mix(raw + (end - start).astype(np.uint64))


class Chunk:
    """Consecutive texts: ``data`` holds their UTF-8 bytes, text ``i`` is ``data[starts[i]:ends[i]]`` (null: empty)."""

    def __init__(self, batch: pa.RecordBatch, column: str):
        self.batch = batch
        texts = batch.column(column)
        if not pa.types.is_large_string(texts.type):
            texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = pc.fill_null(texts, "")
        self.n = len(texts)
        _, offsets, data = texts.buffers()
        edges = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + self.n + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data = raw[edges[0] : edges[-1]]
        self.edges = edges - edges[0]
        self.starts, self.ends = self.edges[:-1], self.edges[1:]

    def owner(self, positions: np.ndarray) -> np.ndarray:
        """Index of the text that holds each byte position."""
        return np.searchsorted(self.ends, positions, side="right")

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of bytes whose value is ``inside`` (a table of 256), never across texts: text, start, end."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        flags = np.zeros(len(self.data) + 2, np.int8)
        flags[1:-1] = inside[self.data]
        step = np.diff(flags)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        # A run over the edge between two texts is cut there.
        cuts = self.edges[1:-1]
        cuts = np.unique(cuts[(cuts > 0) & (cuts < len(self.data))])
        cuts = cuts[(flags[cuts] == 1) & (flags[cuts + 1] == 1)]
        if len(cuts):
            starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
        return self.owner(starts), starts, ends


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut Arrow batches into chunks of about ``limit`` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // limit
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for start, end in zip(edges, [*edges[1:], batch.num_rows], strict=True):
            yield Chunk(batch.slice(int(start), int(end - start)), column)


def per_text(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of integer ``values`` per text."""
    return np.bincount(owner, weights=values, minlength=n).astype(np.int64) if len(owner) else np.zeros(n, np.int64)


def spans_inside(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``counts[i]`` consecutive integers from ``starts[i]`` on, concatenated; and the index ``i`` of each."""
    owner = np.repeat(np.arange(len(starts)), counts)
    first = np.cumsum(counts) - counts
    return np.asarray(starts)[owner] + (np.arange(len(owner)) - first[owner]), owner
