"""Length buckets with the least padding, and token-budget batches inside them.

The global histogram of lengths has a bounded number of bins (at most ``BINS`` per doubling), so dynamic programming over
it is a small exact computation on the driver, whatever the size of the corpus.  A document joins the smallest bucket that
holds it; a batch of a bucket holds ``budget // boundary`` documents (one at least).  Batches are numbered without a global
window: documents are ranked inside shards of a bounded size, and the counts of earlier shards are added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tracemill.llm.common import query, read, write_stage
from tracemill.llm.quality_rules import WORD
from tracemill.llm.scan import chunks, per_text

#: Bins per doubling of the length; lengths below are bins of their own.
BINS = 128
BUCKETS, BUDGET = 16, 65_536
SHARD_ROWS = 50_000


def bin_top(length: Column) -> Column:
    """The largest length of the bin that holds ``length``: itself up to ``BINS``, then ``BINS`` steps a doubling."""
    shift = F.greatest(F.length(F.bin(F.greatest(length, F.lit(1)) - 1)) - F.lit(BINS.bit_length()), F.lit(0))
    step = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    return (F.ceil(length / step) * step).cast("long")


def best_boundaries(tops: np.ndarray, counts: np.ndarray, totals: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` boundaries among ``tops`` (ascending, all counted) with the least total padding."""
    n = len(tops)
    if not n:
        return []
    c, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(totals)])
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    choice = []
    for _ in range(min(buckets, n)):
        after, arg = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        after[0] = 0
        for j in range(1, n + 1):
            padded = cost[:j] + (c[j] - c[:j]) * float(tops[j - 1]) - (s[j] - s[:j])
            arg[j] = int(np.argmin(padded))
            after[j] = padded[arg[j]]
        cost = after
        choice.append(arg)
    edges, j = [], n
    for arg in reversed(choice):
        if j == 0:
            break
        edges.append(int(tops[j - 1]))
        j = arg[j]
    return edges[::-1]


def with_length(docs: DataFrame, column: str) -> DataFrame:
    """``doc_id`` and the number of words (runs without white space) of the whole text."""

    def run(batches):
        for chunk in chunks(batches):
            text, *_ = chunk.runs(WORD)
            yield pa.RecordBatch.from_arrays([chunk.batch.column("doc_id"), pa.array(per_text(np.ones(len(text)), text, chunk.n))], ["doc_id", column])

    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField(column, T.LongType())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, kind)


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``doc_id, n_tokens, bucket, boundary, batch, slot, padding``: one row per document that has tokens, or none has 0.

    Tokens are words.  A null or empty text has length 0 and goes to the first bucket like any other.  Documents longer than
    the budget form batches of one; nothing is cut or dropped.  Ties in the choice of boundaries go to the smaller earlier
    boundary; inside a shard documents are ranked by ``doc_id`` and length.  Only ``doc_id`` and ``text`` are read.
    """
    lengths = write_stage(with_length(docs, "n_tokens").withColumn("top", bin_top(F.col("n_tokens"))), "lengths")
    bins = lengths.groupBy("top").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("s")).orderBy("top").toPandas()
    edges = best_boundaries(bins.top.to_numpy(), bins.n.to_numpy(), bins.s.to_numpy(), buckets)
    rows = int(bins.n.sum())
    shards = max(1, -(-rows // SHARD_ROWS))
    bucket = F.lit(None).cast("int")
    for i, edge in reversed(list(enumerate(edges))):
        bucket = F.when(F.col("top") <= edge, i).otherwise(bucket)
    bounds = F.array(*[F.lit(e).cast("long") for e in edges]) if edges else F.array().cast("array<bigint>")
    placed = lengths.withColumns({"bucket": bucket, "shard": F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")})
    before = Window.partitionBy("bucket").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("bucket", "shard").agg(F.count("*").alias("n")).withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("doc_id", "n_tokens")) - 1
    out = placed.withColumn("rank", rank).join(offsets, ["bucket", "shard"]).withColumn("boundary", F.element_at(bounds, F.col("bucket") + 1))
    held = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))))
    place = F.col("earlier") + F.col("rank")
    return out.select(
        "doc_id", "n_tokens", "bucket", "boundary", F.floor(place / held).cast("long").alias("batch"),
        (place % held).cast("long").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"),
    )


@query("op8_packing")
def op8(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))
