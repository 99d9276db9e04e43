"""What the operators of this subpackage share: lineage cuts, group counts, safe columns, the registry of queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.session import configure, remove_at_end, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rows per Arrow batch: bounds what crosses to Python at once when texts are long.
BATCH_ROWS = 1000


def query(name: str, sql: str | None = None):
    """Register a query, with its oracle where SQL can say it."""

    def register(run):
        def call(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
            return run(spark, sf_dir)

        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: survives lost executors, cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n


def group_of(column: str | Column, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_key(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``docs`` with a key of its own for every row in the long column ``name``, ordered as ``doc_id``; is it ``doc_id`` itself?

    Ids that are unique and not null are the key.  Otherwise all rows are sorted by id (null last) and numbered, equal ids by
    their text, equal rows by their place; the numbers are written once, so every later reading has the same.
    """
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("doc_id IS NULL OR rows > 1")
    if repeated.isEmpty():
        return docs.withColumn(name, F.col("doc_id").cast("long")), True
    tie, place = fresh(docs, "_tie"), fresh(docs, "_place")
    order = [F.col("doc_id").asc_nulls_last(), F.col(tie), F.col(place)]  # the ties spread an id of any share over the ranges
    rows = docs.withColumns({tie: F.xxhash64("text"), place: F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order).drop(tie, place)
    return write_stage(rows.withColumn(name, F.monotonically_increasing_id()), "keyed"), False


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
