"""Writers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.operators.chunkstore import CHUNK_KEY, missing_chunks


MANIFEST = "_current"


def _files(spark: SparkSession, path: str):
    """The file system of a path and the class of its paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def _version(spark: SparkSession, path: str) -> int | None:
    """Number of the current version of a collection: the largest manifest."""
    files, of = _files(spark, path)
    if not files.exists(of(f"{path}/{MANIFEST}")):
        return None
    names = [s.getPath().getName() for s in files.listStatus(of(f"{path}/{MANIFEST}"))]
    return max((int(n) for n in names if n.isdigit()), default=None)


def _publish(df: DataFrame, path: str, partition_by: Sequence[str]) -> DataFrame:
    """Write ``df`` as a new version and make it the current one.

    The version is complete before its manifest, a file with its folder's name, is put in place by one rename.  A run that
    fails before leaves the current version as it is.  Of two writers at once only one can create a number: the other
    fails and may be repeated.  Earlier versions stay for those who read them, until :func:`remove_versions`.
    """
    spark = df.sparkSession
    number = (_version(spark, path) or 0) + 1
    data = f"{path}/v{number}-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(data)
    files, of = _files(spark, path)
    name = data.rsplit("/", 1)[1]
    draft = of(f"{path}/{MANIFEST}/.{name}")
    out = files.create(draft, True)
    out.write(bytearray(name.encode()))
    out.close()
    # The manifest's name must not exist yet: this is the step that another writer can win.
    hadoop = spark._jvm.org.apache.hadoop.fs
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(draft), files.makeQualified(of(f"{path}/{MANIFEST}/{number}")), none)
    return read_collection(spark, path)


def read_collection(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The current (or another) version of a collection; ``None`` if there is none."""
    version = version or _version(spark, path)
    if version is None:
        return None
    folder = spark.read.text(f"{path}/{MANIFEST}/{version}").first()[0]
    return spark.read.parquet(f"{path}/{folder}")


def append_chunks(new: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Append chunks the store does not hold yet, each key once; a failed run leaves the stored ones untouched and may be repeated."""
    spark = new.sparkSession
    files, of = _files(spark, path)
    if files.exists(of(path)):
        new = missing_chunks(new, spark.read.parquet(path))
    new.dropDuplicates(CHUNK_KEY).write.mode("append").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def rebuild_collection(documents: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace a whole collection by a new version, which may be computed from the old one."""
    return _publish(documents, path, partition_by)


def remove_versions(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and what failed runs left behind."""
    files, of = _files(spark, path)
    current = _version(spark, path) or 0
    kept = set()
    for s in files.listStatus(of(f"{path}/{MANIFEST}")):
        name = s.getPath().getName()
        if name.isdigit() and int(name) > current - keep:
            kept.add(spark.read.text(f"{path}/{MANIFEST}/{name}").first()[0])
    for s in files.listStatus(of(path)):
        name = s.getPath().getName()
        if name != MANIFEST and name not in kept:
            files.delete(s.getPath(), True)


def as_json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_trace_report(lines: DataFrame, path: str) -> None:
    """Transaction lines as text, one folder per file, in report order."""
    order = ["file_id", "tx_no", "section", "at"]
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select("file_id", F.col("text").alias("value")).write.mode("overwrite").partitionBy("file_id").text(path)


def write_texts(lines: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], text: str = "text", parts: int | None = None) -> DataFrame:
    """Texts given as lines, each text written in order by as many tasks as its size asks for; returns the manifest.

    Lines are sorted by range over ``keys`` and ``order``, so a text may lie in several parts.  The manifest has a row per text
    and part: ``part, first_line, line_count, first_byte, bytes`` (bytes in UTF-8, with a line feed after every line).
    """
    spark = lines.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.select(*keys, *order, text).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    placed.withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(f"{path}/lines")
    sizes = spark.read.parquet(f"{path}/lines").groupBy(*keys, "part").agg(F.count("*").alias("line_count"), F.sum(F.octet_length(F.coalesce(text, F.lit(""))) + 1).alias("bytes"))
    # A row per text and part: the window holds the parts of one text, not its lines.
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    manifest = sizes.select(*keys, "part", (total("line_count") + 1).alias("first_line"), "line_count", total("bytes").alias("first_byte"), "bytes")
    manifest.write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def read_texts(spark: SparkSession, path: str, wanted: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lines of the texts whose keys are in ``wanted``, in order; only parts that the manifest names are read."""
    named = spark.read.parquet(f"{path}/manifest").join(wanted.select(*keys).distinct(), list(keys), "left_semi").select(*keys, "part")
    lines = spark.read.parquet(f"{path}/lines").join(named, [*keys, "part"], "left_semi")
    return lines.drop("part").orderBy(*keys, *order)


def append_usage(usage: DataFrame, path: str) -> None:
    usage.write.mode("append").parquet(path)


def append_session_files(files: DataFrame, path: str, buckets: int = 64) -> None:
    """Append session files, clustered by a bounded number of session buckets (column ``bucket``)."""
    bucket = F.pmod(F.xxhash64("session_id"), F.lit(buckets)).cast("int")
    files.withColumn("bucket", bucket).repartition(buckets, "bucket").write.mode("append").partitionBy("bucket").parquet(path)
