"""tracemill: payment-switch trace analysis and document-chunk retrieval on PySpark.

Layout
    functions/  column expressions (no shuffles)
    operators/  DataFrame -> DataFrame operators (joins, scans, folds, top-k)
    sources/    readers, reference tables and sinks
    plans/      end-to-end compositions and the registered query catalogue
    streaming/  incremental runs over a landing folder
"""

__version__ = "0.1.0"
