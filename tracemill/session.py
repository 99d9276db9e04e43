"""Session settings and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings the operators rely on.  They are runtime-checked by Spark itself:
#: broadcasts are chosen from measured sizes and skewed join partitions are split.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Batches for Python tasks are bounded by bytes, not by rows alone: texts may be long.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
    # Methods beyond HotSpot's limit are never compiled; past it Spark uses split projections instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session (tests, bench) may fall back to a temporary
    folder; a cluster without the setting is an error, never a local path.
    """
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="tracemill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several consumers need the same expensive intermediate: the copy
    survives executor loss, is columnar (so consumers still prune columns) and
    carries real file sizes, so Spark's own broadcast threshold sees true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a staged table when the application ends: until then results may still read it."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least one partition per core.

    Large inputs already come in many splits and pass through unchanged; only an
    input of fewer splits than cores is redistributed, before CPU-heavy text work.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def bounded_rows(df: DataFrame, limit: int) -> list | None:
    """Rows of ``df`` if there are at most ``limit`` of them, else ``None``.

    This is the size check behind every literal or broadcast table: at most
    ``limit + 1`` rows ever reach the driver.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A table of a few known rows as a local relation: its size is known to the planner, no job is needed to read it."""
    struct = T.StructType.fromDDL(schema)
    return spark.createDataFrame(pd.DataFrame([tuple(r) for r in rows], columns=struct.names, dtype=object), struct)


def small(df: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """``df`` marked for broadcast if its rows take at most ``limit`` bytes as text, else unchanged (then Spark decides)."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))) + 16).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= limit else df


__all__ = ["SETTINGS", "configure", "remove_at_end", "shared_folder", "stage", "spread", "bounded_rows", "small", "values"]
