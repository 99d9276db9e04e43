"""Trace files arriving in a folder, analysed file by file.

The trace semantics need whole files (a transaction may be closed by the end of its
file), and the file source hands over whole files, so each micro-batch runs the batch
operators.  A batch writes its own ``batch=<id>`` folder in overwrite mode: a batch
that is repeated after a failure replaces what it left behind.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from tracemill.plans.trace_report import Analysis, analyze
from tracemill.sources.traces import is_trace_file, place_lines, text_scan


def watch(
    spark: SparkSession,
    landing: str,
    output: str,
    checkpoint: str,
    specs: DataFrame | None = None,
    files_per_batch: int = 1000,
    on_batch: Callable[[Analysis, int], None] | None = None,
) -> StreamingQuery:
    """Start (or resume) the folder watch; processes what is there, then stops."""
    source = text_scan(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(landing))

    def run(batch: DataFrame, batch_id: int) -> None:
        lines = place_lines(batch.filter(is_trace_file(F.element_at(F.split("file_id", "/"), -1))))
        result = analyze(lines, specs=specs)
        result.transactions.write.mode("overwrite").parquet(f"{output}/transactions/batch={batch_id}")
        result.events.write.mode("overwrite").parquet(f"{output}/events/batch={batch_id}")
        if on_batch:
            on_batch(result, batch_id)

    return (
        source.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
