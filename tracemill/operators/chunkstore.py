"""The chunk table: reuse, statistics, purges and rewrites.

``chunks`` columns used here: ``chunk_id, file_hash, session_id, source, page,
chunk_index, chunking_version, created_at, last_accessed`` (ISO text times).
Every maintenance operator returns the table to keep; the caller writes it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv

CHUNK_KEY = ["file_hash", "chunking_version", "chunk_index"]


def scope(chunks: DataFrame, session_id: str | None = None, file_hashes: Sequence[str] | None = None, type: str | None = None) -> DataFrame:
    """Chunks of some files or of a session, optionally of one type; pushed down to the scan."""
    out = chunks
    if file_hashes:
        wanted = F.col("file_hash").isin(*file_hashes)
        out = out.filter(wanted | (F.col("session_id") == session_id) if session_id else wanted)
    elif session_id:
        out = out.filter(F.col("session_id") == session_id)
    if type:
        out = out.filter(F.col("type") == type)
    return out


def missing_chunks(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New chunks whose file, version and index are not stored yet (nulls are equal to each other)."""
    held = stored.select(*[F.col(c).alias(f"__{c}") for c in CHUNK_KEY])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in CHUNK_KEY]
    return new.join(held, same, "left_anti")


def existing_indexes(stored: DataFrame, version: str = fv.CHUNK_VERSION) -> DataFrame:
    """Chunk indexes present per file in the current version (one row each)."""
    current = stored.filter((F.col("chunking_version") == version) & F.col("chunk_index").isNotNull())
    return current.select("file_hash", "chunk_index").distinct()


def hash_stats(chunks: DataFrame, version: str = fv.CHUNK_VERSION) -> DataFrame:
    """Per file hash: all chunks, chunks of the current version, its pages and indexes, reuse flags."""
    current = F.col("chunking_version") == version
    counted = chunks.filter(F.col("file_hash").isNotNull()).groupBy("file_hash").agg(
        F.count("*").alias("all_chunks"),
        F.count_if(current).alias("chunk_count"),
        F.countDistinct(F.when(current, F.col("page"))).alias("total_pages"),
        F.countDistinct(F.when(current, F.col("chunk_index"))).alias("index_count"),
    )
    return counted.withColumns(
        {"found": F.col("chunk_count") > 0, "version_mismatch": (F.col("all_chunks") > 0) & (F.col("chunk_count") == 0)}
    )


def resume_state(new: DataFrame, stored: DataFrame, version: str = fv.CHUNK_VERSION) -> DataFrame:
    """Per new file: chunks wanted, already present, and whether it can be reused as it is."""
    wanted = new.groupBy("file_hash").agg(F.countDistinct("chunk_index").alias("wanted"))
    present = existing_indexes(stored, version).groupBy("file_hash").agg(F.count("*").alias("present"))
    joined = wanted.join(present, "file_hash", "left").withColumn("present", F.coalesce("present", F.lit(0).cast("bigint")))
    return joined.withColumn("reused", (F.col("present") > 0) & (F.col("present") >= F.col("wanted")))


def session_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count per session; the rows are the sessions in the store."""
    return chunks.filter(F.col("session_id").isNotNull()).groupBy("session_id").agg(F.count("*").alias("chunk_count"))


def library(chunks: DataFrame, n: int = fv.LIBRARY_ROWS) -> DataFrame:
    """Indexed documents, most recently used first."""
    named = chunks.filter(F.col("file_hash").isNotNull() & F.col("source").isNotNull())
    grouped = named.groupBy("file_hash", F.col("source").alias("filename")).agg(
        F.count("*").alias("chunk_count"), F.min("created_at").alias("created_at"), F.max("last_accessed").alias("last_accessed")
    )
    return grouped.orderBy(F.desc_nulls_last("last_accessed"), "file_hash", "filename").limit(n)


def is_stale(cutoff: Column | str, either: bool = False) -> Column:
    """Older than ``cutoff``: by last use (creation when never used), or by either time."""
    limit = F.lit(cutoff) if isinstance(cutoff, str) else cutoff
    if either:
        older = lambda c: F.coalesce(F.col(c) < limit, F.lit(False))
        return older("last_accessed") | older("created_at")
    return F.coalesce(F.coalesce("last_accessed", "created_at") < limit, F.lit(False))


def age_purge(chunks: DataFrame, cutoff: str, either: bool = False) -> DataFrame:
    return chunks.filter(~is_stale(cutoff, either))


def is_orphan() -> Column:
    return F.col("file_hash").isNull() | (F.col("file_hash") == "N/A")


def orphans(chunks: DataFrame) -> DataFrame:
    """Chunks without a file hash, as a dry-run listing."""
    snippet = F.replace(F.left("text", F.lit(100)), F.lit("\n"), F.lit(" "))
    return chunks.filter(is_orphan()).select(
        "chunk_id",
        F.coalesce("session_id", F.lit("N/A")).alias("session_id"),
        F.coalesce(F.col("page").cast("string"), F.lit("N/A")).alias("page"),
        F.length("text").alias("length"),
        snippet.alias("snippet"),
    )


def remove_orphans(chunks: DataFrame) -> DataFrame:
    return chunks.filter(~is_orphan())


def purge_reason(session_id: str | None = None, file_hash: str | None = None, cutoff: str | None = None, either: bool = False) -> Column:
    """Which rule removes a chunk (session, then file, then age), or null to keep it."""
    reason = F.when(F.lit(False), F.lit(""))
    if session_id:
        reason = reason.when(F.col("session_id") == session_id, "session")
    if file_hash:
        reason = reason.when(F.col("file_hash") == file_hash, "file")
    if cutoff:
        reason = reason.when(is_stale(cutoff, either), "age")
    return reason


def purge(chunks: DataFrame, **rules) -> DataFrame:
    return chunks.filter(purge_reason(**rules).isNull())


def purge_counts(chunks: DataFrame, **rules) -> DataFrame:
    """Removed chunks per rule."""
    marked = chunks.withColumn("reason", purge_reason(**rules)).filter(F.col("reason").isNotNull())
    return marked.groupBy("reason").agg(F.count("*").alias("deleted_chunks"))


def repoint(chunks: DataFrame, moves: DataFrame) -> DataFrame:
    """Give all chunks of a file to another session; ``moves``: one ``file_hash, session_id, accessed_at`` per file."""
    target = moves.select("file_hash", F.col("session_id").alias("__s"), F.col("accessed_at").alias("__t"))
    joined = chunks.join(target, "file_hash", "left")
    return joined.withColumns(
        {"session_id": F.coalesce("__s", "session_id"), "last_accessed": F.coalesce("__t", "last_accessed")}
    ).select(*chunks.columns)


def rebuild_version(stored: DataFrame, new: DataFrame, version: str = fv.CHUNK_VERSION) -> DataFrame:
    """Store after new chunks arrive: files present only in other versions are dropped and rebuilt,
    files of the current version keep what they have, missing chunks are added."""
    files = new.select("file_hash").distinct()
    touched = stored.join(files, "file_hash", "left_semi").groupBy("file_hash")
    current = touched.agg(F.count_if(F.col("chunking_version") == version).alias("n"))
    outdated = current.filter("n = 0").select("file_hash")
    kept = stored.join(outdated, "file_hash", "left_anti")
    return kept.unionByName(missing_chunks(new, kept), allowMissingColumns=True)
