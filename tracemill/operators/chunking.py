"""Pages to chunks: bridges, recursive split, chunk numbers, tags and embedding batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill import fixed_values as fv
from tracemill.functions import chunk_text as ct
from tracemill.functions.text import blank_to_null
from tracemill.operators.scan import BLOCK, Running, block_scan, position_block, ranked
from tracemill.session import stage

#: Characters of pieces that a splitting task gathers before it hands them on.
SPLIT_CHARS = 1 << 20


def scanned_documents(pages: DataFrame, min_ratio: float = fv.MIN_TEXT_RATIO, max_pages: int = fv.MAX_PAGES) -> DataFrame:
    """Documents that cannot be indexed: too many pages, or too few pages with text."""
    has_text = blank_to_null("text").isNotNull()
    counted = pages.groupBy("file_hash").agg(
        F.count("*").alias("total_pages"), F.count_if(has_text).alias("pages_with_text")
    )
    too_many = F.col("total_pages") > max_pages
    scanned = (F.col("pages_with_text") == 0) | (F.col("pages_with_text") / F.col("total_pages") < min_ratio)
    kind = F.when(too_many, "too_many_pages").when(scanned, "scanned_pdf")
    return counted.withColumn("error_type", kind).filter(F.col("error_type").isNotNull())


def bridge_pages(
    pages: DataFrame, keys: Sequence[str] = ("file_hash",), overlap: int = fv.CHUNK_OVERLAP, block: int = BLOCK
) -> DataFrame:
    """Each page with text, followed by the head of the next one (``page_label`` ``p`` or ``p-q``).

    Pages are numbered per document, then each page also reports its head to the page
    before it; the two meet in a group of at most two rows.
    """
    keys = list(keys)
    full = pages.filter(blank_to_null("text").isNotNull())
    numbered = ranked(full.select(*keys, "page", "text"), keys, ["page"], position_block("page", block), "place")
    own = F.struct(F.col("place"), F.col("page"), F.col("text"), F.lit(True).alias("own"))
    head = F.struct(
        (F.col("place") - 1).alias("place"), F.col("page"), F.substring("text", 1, overlap).alias("text"), F.lit(False).alias("own")
    )
    told = numbered.select(*keys, F.explode(F.array(own, head)).alias("t")).filter("t.place > 0")
    met = told.groupBy(*keys, F.col("t.place").alias("place")).agg(
        F.max(F.when(F.col("t.own"), F.col("t.page"))).alias("page"),
        F.max(F.when(F.col("t.own"), F.col("t.text"))).alias("body"),
        F.max(F.when(~F.col("t.own"), F.col("t.page"))).alias("next_page"),
        F.max(F.when(~F.col("t.own"), F.col("t.text"))).alias("head"),
    )
    text = F.concat(
        F.format_string(fv.PAGE_HEAD, F.col("page").cast("string")),
        F.col("body"),
        F.coalesce(F.concat(F.lit(fv.PAGE_BRIDGE), F.col("head")), F.lit("")),
    )
    return met.select(
        *keys, "place", "page", F.concat_ws("-", F.col("page").cast("string"), F.col("next_page").cast("string")).alias("page_label"), text.alias("text")
    )


def split_text(
    documents: DataFrame,
    text: str = "text",
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    separators: Sequence[str] = fv.SEPARATORS,
    out: str = "pieces",
) -> DataFrame:
    """Add ``pieces``, the recursive split of each row's text (narrow, Arrow batches, no shuffle).

    A task holds one batch of texts and the pieces of about ``SPLIT_CHARS`` characters.
    """
    schema = T.StructType(
        [f for f in documents.schema.fields if f.name != text] + [T.StructField(out, T.ArrayType(T.StringType()))]
    )
    separators, rest = tuple(separators), [c for c in documents.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, pieces, held = batch.column(text), 0, [], 0
            for i in range(len(texts)):
                pieces.append(ct.split_spans(texts[i].as_py() or "", size, overlap, separators))
                held += sum(map(len, pieces[-1]))
                if held >= SPLIT_CHARS or i + 1 == len(texts):
                    rows = batch.slice(first, len(pieces))
                    columns = [*(rows.column(c) for c in rest), pa.array(pieces, pa.list_(pa.string()))]
                    first, pieces, held = i + 1, [], 0
                    yield pa.RecordBatch.from_arrays(columns, [*rest, out])

    return documents.mapInArrow(run, schema)


def number_chunks(split: DataFrame, keys: Sequence[str], place: str = "place", block: int = BLOCK) -> DataFrame:
    """One row per piece with its 0-based ``chunk_index`` over the whole document."""
    counted = split.withColumn("__n", F.size("pieces").cast("bigint"))
    offset = block_scan(
        counted, list(keys), [place], position_block(place, block), [Running("__before", "sum", "__n", before=True)]
    )
    rest = [c for c in split.columns if c != "pieces"]
    return offset.select(*rest, "__before", F.posexplode("pieces").alias("__i", "text")).select(
        *rest, (F.coalesce("__before", F.lit(0)) + F.col("__i")).alias("chunk_index"), "text"
    )


def tag_chunks(chunks: DataFrame, version: str = fv.CHUNK_VERSION) -> DataFrame:
    """Command and response code, error-table flag and chunking version of each chunk."""
    return chunks.withColumns(
        {
            "command_code": ct.command_code("text"),
            "response_code": ct.response_code("text"),
            "contains_error_table": ct.has_error_table("text"),
            "chunking_version": F.lit(version),
        }
    )


def chunk_pages(pages: DataFrame, keys: Sequence[str] = ("file_hash",), size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, block: int = BLOCK) -> DataFrame:
    """Pages to numbered, tagged chunks.  The split is staged because numbering reads it twice."""
    split = split_text(bridge_pages(pages, keys, overlap, block), size=size, overlap=overlap)
    return tag_chunks(number_chunks(stage(split, "split"), keys, "place", block))


def _next_batch(tokens: np.ndarray, count: int, max_items: int, max_tokens: int) -> np.ndarray:
    """For each of the first ``count`` items: where the batch starting there ends."""
    total = np.concatenate([[0], np.cumsum(tokens)])
    start = np.arange(count)
    fits = np.searchsorted(total, total[start] + max_tokens, side="right") - 1
    return np.maximum(start + 1, np.minimum(np.minimum(fits, start + max_items), len(tokens)))


def plan_batches(
    items: DataFrame,
    job: str = "job",
    position: str = "position",
    tokens: str = "tokens",
    max_items: int = fv.BATCH_ITEMS,
    max_tokens: int = fv.BATCH_TOKENS,
    block: int = BLOCK,
) -> DataFrame:
    """Add ``batch_no``: a new batch starts when ``max_items`` are held or ``tokens`` would exceed ``max_tokens``.

    ``position`` numbers the items of a job from 0 without gaps.  The rule is
    sequential, but a batch holds at most ``max_items`` items, so whatever came
    before, the first batch that starts inside a block starts at one of its first
    ``max_items`` positions.  Each block therefore tabulates, per such position,
    where the next block is entered and how many batches start on the way; only those
    tables are chained per job, and every block then numbers its own items.
    """
    if block < max_items:
        raise ValueError("a block must hold at least one full batch")
    base = items.select(
        F.col(job).alias("__job"), F.col(position).alias("__pos"), F.col(tokens).cast("bigint").alias("__tok")
    )
    at = position_block("__pos", block)
    own = F.struct(at.alias("b"), F.lit(True).alias("own"))
    halo = F.struct((at - 1).alias("b"), F.lit(False).alias("own"))
    near_head = (F.col("__pos") % block < max_items) & (F.col("__pos") >= block)
    spread = base.select(
        "*", F.explode(F.when(near_head, F.array(own, halo)).otherwise(F.array(own))).alias("s")
    ).select("__job", F.col("s.b").alias("__block"), "__pos", "__tok", F.col("s.own").alias("__own"))
    job_type = items.schema[job].dataType.simpleString()

    def tabulate(key, pdf):
        pdf = pdf.sort_values("__pos")
        count = int(pdf["__own"].sum())
        nxt = _next_batch(pdf["__tok"].to_numpy(), count, max_items, max_tokens)
        leave, started = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for p in range(count - 1, -1, -1):
            q = nxt[p]
            leave[p], started[p] = (q - count, 1) if q >= count else (leave[q], started[q] + 1)
        k = min(max_items, count)
        return pd.DataFrame({"__job": [key[0]], "__block": [key[1]], "leave": [leave[:k].tolist()], "started": [started[:k].tolist()]})

    def chain(key, pdf):
        pdf = pdf.sort_values("__block")
        enter, base_no, rows = 0, 0, []
        for block_no, leave, started in zip(pdf["__block"], pdf["leave"], pdf["started"]):
            rows.append((key[0], block_no, enter, base_no))
            if enter < len(leave):
                base_no += int(started[enter])
                enter = int(leave[enter])
        return pd.DataFrame(rows, columns=["__job", "__block", "__enter", "__base"])

    sizes = base.groupBy("__job").agg(F.max("__pos").alias("__last"))
    long_jobs = sizes.filter(F.col("__last") >= block).select("__job")
    tables = (
        spread.join(long_jobs, "__job", "left_semi")
        .groupBy("__job", "__block")
        .applyInPandas(tabulate, f"__job {job_type}, __block bigint, leave array<bigint>, started array<bigint>")
    )
    entries = tables.groupBy("__job").applyInPandas(chain, f"__job {job_type}, __block bigint, __enter bigint, __base bigint")

    def number(key, pdf):
        pdf = pdf.sort_values("__pos")
        count = int(pdf["__own"].sum())
        nxt = _next_batch(pdf["__tok"].to_numpy(), count, max_items, max_tokens)
        p, base_no = int(pdf["__enter"].iloc[0]), int(pdf["__base"].iloc[0])
        starts = np.zeros(count, np.int64)
        while p < count:
            starts[p] = 1
            p = int(nxt[p])
        return pd.DataFrame(
            {"__job": key[0], "__pos": pdf["__pos"].to_numpy()[:count], "batch_no": base_no - 1 + np.cumsum(starts)}
        )

    entered = spread.join(entries, ["__job", "__block"], "left").fillna(0, ["__enter", "__base"])
    numbered = entered.groupBy("__job", "__block").applyInPandas(number, f"__job {job_type}, __pos bigint, batch_no bigint")
    named = numbered.select(F.col("__job").alias(job), F.col("__pos").alias(position), "batch_no")
    return items.join(named, [job, position])
