"""From raw documents to packed batches: quality, near copies, repeated passages, benchmark leaks, packing.

Every stage works on all rows that the one before it kept, and each but the last returns the columns of ``documents``.
SQL can express neither the learned rules nor the similarity classes, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracemill.llm import decontaminate, minhash, packing, quality_rules, suffix_dedup
from tracemill.llm.common import BATCH_ROWS, read, write_stage
from tracemill.session import configure


def _ready(spark: SparkSession) -> None:
    configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    _ready(spark)
    return quality_rules.keep_good(docs, read(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    _ready(spark)
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that repeats 100 bytes from earlier on is cut out; documents of which nothing is left go."""
    _ready(spark)
    return suffix_dedup.cut_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages to a twentieth of their words go."""
    _ready(spark)
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document with its bucket, batch and slot."""
    _ready(spark)
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; each is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_stage(docs, name)
    return docs


__all__ = ["ORACLE_SQL", "STAGES", "run"]
