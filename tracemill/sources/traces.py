"""Trace files with exact line numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.trace_line import looks_like_trace
from tracemill.operators.ordered import top_per_group


def is_trace_file(name: Column | str) -> Column:
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    accepted = F.contains(low, F.lit(fv.TRACE_INFIX))
    for extension in fv.TRACE_EXTENSIONS:
        accepted = accepted | F.endswith(low, F.lit(extension))
    return accepted


#: Rows that one task can read of a file: the low bits of a place.
ROW_BITS = 33


@dataclass(frozen=True)
class TraceScan:
    """Lines of trace files whose ``line_no`` is a place: it grows from line to line of a file, but not by one.

    A place is the number of the file's split and the row inside it, so nothing has to be joined or ordered to make it.
    """

    lines: DataFrame

    def offsets(self) -> DataFrame:
        """``file_id, split, first, offset``: one row per split, with the lines of all earlier splits of its file."""
        split = F.shiftright("line_no", ROW_BITS).alias("split")
        splits = self.lines.groupBy("file_id", split).agg(F.min("line_no").alias("first"), F.count("*").alias("n"))
        before = Window.partitionBy("file_id").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
        return splits.select("file_id", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def number(self, rows: DataFrame, *columns: str) -> DataFrame:
        """``rows`` (with ``file_id``) whose places in ``columns`` are replaced by line numbers, 1 for a file's first line."""
        names, offsets = rows.columns, self.offsets()
        for c in columns:
            at = offsets.select("file_id", F.col("split").alias("__split"), "first", "offset")
            found = rows.withColumn("__split", F.shiftright(c, ROW_BITS)).join(at, ["file_id", "__split"], "left")
            rows = found.withColumn(c, F.col("offset") + F.col(c) - F.col("first") + 1).select(*names)
        return rows


def place_lines(raw: DataFrame) -> TraceScan:
    """A text scan (``file_id, start, line`` straight from the files) with places.

    Splits of a file start at multiples of a size that is at least the smaller of the two settings.
    """
    conf = raw.sparkSession.conf
    sizes = [F.expr(f"{int(_bytes(conf.get(k)))}") for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")]
    split = F.floor(F.col("start") / F.greatest(F.least(*sizes), F.lit(1))).cast("bigint")
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return TraceScan(raw.select("file_id", (F.shiftleft(split, ROW_BITS) + row).alias("line_no"), "line"))


def _bytes(setting: str) -> int:
    """Bytes of a size setting such as ``128MB`` or ``4194304b``."""
    digits = "".join(c for c in setting if c.isdigit())
    unit = setting[len(digits) :].strip().lower().removesuffix("b")
    return int(digits) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def text_scan(reader) -> DataFrame:
    """Batch or streaming text files with their path and the offset of the split each line came from."""
    return reader.select(
        F.col("_metadata.file_path").alias("file_id"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("value").alias("line"),
    )


def open_traces(spark: SparkSession, path: str, trace_only: bool = True) -> TraceScan:
    """All trace files under ``path``, blank lines included, for :func:`tracemill.plans.trace_report.analyze`."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path)
    if trace_only:  # on the file's metadata, so that other files are not read
        raw = raw.filter(is_trace_file(F.col("_metadata.file_name")))
    return place_lines(text_scan(raw))


def read_traces(spark: SparkSession, path: str, trace_only: bool = True) -> DataFrame:
    """Numbered lines ``file_id, line_no, line`` of all trace files under ``path``, for looking at the text itself."""
    scan = open_traces(spark, path, trace_only)
    return scan.number(scan.lines, "line_no")


def trace_hints(lines: DataFrame, n: int = fv.TRACE_HINT_LINES) -> DataFrame:
    """First ``n`` lines of each file that look like a trace at all."""
    return top_per_group(lines.filter(looks_like_trace("line")), ["file_id"], [F.col("line_no")], n)
