"""Registered queries over documents read as pages and stored chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import chunk_text as ct
from tracemill.functions import payload as pl
from tracemill.operators import chunking as ck
from tracemill.operators import chunkstore as cs
from tracemill.operators.ordered import top_per_group
from tracemill.operators.scan import position_block, ranked
from tracemill.plans.catalogue import CHUNKS_SQL, chunks, query, table
from tracemill.session import stage, values

# One document per (source, lang); its pages are the rows in order of doc_id.
# Every 17th page is followed by a blank one.
PAGES = """p AS (SELECT concat(source, '-', lang) AS file_hash, doc_id * 2 AS page, text FROM documents
  UNION ALL SELECT concat(source, '-', lang), doc_id * 2 + 1, ' ' FROM documents WHERE doc_id % 17 = 0)"""


def pages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    file_hash = F.concat_ws("-", "source", "lang").alias("file_hash")
    full = docs.select(file_hash, (F.col("doc_id") * 2).alias("page"), "text")
    blank = docs.filter(F.col("doc_id") % 17 == 0).select(file_hash, (F.col("doc_id") * 2 + 1).alias("page"), F.lit(" ").alias("text"))
    return full.unionByName(blank)


@query(
    "pages_bridge",
    f"""WITH {PAGES},
w AS (SELECT file_hash, page, text, lead(page) OVER o AS np, lead(text) OVER o AS nt FROM p WHERE trim(text, E' \\t\\n\\r') <> '' WINDOW o AS (PARTITION BY file_hash ORDER BY page))
SELECT file_hash, page, CASE WHEN np IS NULL THEN CAST(page AS VARCHAR) ELSE concat(page, '-', np) END AS page_label,
  sha256(concat('--- Page ', page, ' ---', chr(10), text, CASE WHEN nt IS NULL THEN '' ELSE concat(chr(10), chr(10), '--- Début page suivante (contexte) ---', chr(10), substr(nt, 1, 300)) END)) AS text_hash
FROM w""",
)
def pages_bridge(spark, sf_dir):
    """Every page followed by the head of the next page with text."""
    out = ck.bridge_pages(pages(spark, sf_dir))
    return out.select("file_hash", "page", "page_label", F.sha2("text", 256).alias("text_hash"))


# With the empty separator alone the splitter cuts plain overlapping windows.
@query(
    "chunk_windows",
    """WITH w AS (SELECT doc_id, length(text) AS n, unnest(generate_series(0, greatest(ceil((length(text) - 800) / 700.0), 0)::INT)) AS i, text FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(substr(text, i * 700 + 1, 800), '^\\s+', ''), '\\s+$', '') AS body FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS chunk_index, length(body) AS size, md5(body) AS hash FROM c WHERE body <> ''""",
)
def chunk_windows(spark, sf_dir):
    """Overlapping windows of 800 characters, 100 shared, numbered per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    split = ck.split_text(docs, size=800, overlap=100, separators=("",))
    out = split.select("doc_id", F.posexplode("pieces").alias("i", "body"))
    return out.select("doc_id", F.col("i").cast("bigint").alias("chunk_index"), F.length("body").alias("size"), F.md5("body").alias("hash"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    """Bridged pages split recursively, numbered over the document and tagged."""
    out = ck.chunk_pages(pages(spark, sf_dir))
    return out.select(
        "file_hash", "page_label", "chunk_index", F.length("text").alias("size"), "command_code", "response_code", "contains_error_table", "chunking_version"
    )


# Texts that carry command pairs and response values at known places.
TAGGED = """SELECT doc_id, concat(
  CASE doc_id % 5 WHEN 0 THEN 'Host Command EC (ED) table. ' WHEN 1 THEN 'Commands CA/CB here. ' WHEN 2 THEN 'KA and KB differ. '
    WHEN 3 THEN 'Command MY/MZ. Response Code 2 A Value ''nd'' end. ' ELSE '' END,
  CASE WHEN doc_id % 7 = 0 THEN 'PVK Parity Error listed. ' ELSE '' END, text) AS text FROM documents"""


@query(
    "chunk_tags",
    f"""WITH t AS ({TAGGED})
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'EC' WHEN 1 THEN 'CA' WHEN 2 THEN 'KA' WHEN 3 THEN 'MY' ELSE upper(nullif(regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([A-Z0-9]{{2}})\\s*(?:/|\\s+and\\s+|\\s*\\(\\s*)\\s*([A-Z0-9]{{2}})', 1), '')) END AS command_code,
  CASE doc_id % 5 WHEN 0 THEN 'ED' WHEN 1 THEN 'CB' WHEN 2 THEN 'KB' WHEN 3 THEN 'ND' ELSE upper(nullif(regexp_extract(text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}_])([A-Z0-9]{{2}})\\s*(?:/|\\s+and\\s+|\\s*\\(\\s*)\\s*([A-Z0-9]{{2}})', 2), '')) END AS response_code,
  regexp_matches(lower(text), 'parity error|pin block format has been disabled|response code|error code') AS contains_error_table,
  sha256(text) AS content_hash, CAST(length(text) // 4 AS BIGINT) AS tokens
FROM t""",
)
def chunk_tags(spark, sf_dir):
    """Command pair, stated response value, error-table flag, hash and size estimate of each chunk."""
    kind = F.col("doc_id") % 5
    lead = (
        F.when(kind == 0, "Host Command EC (ED) table. ")
        .when(kind == 1, "Commands CA/CB here. ")
        .when(kind == 2, "KA and KB differ. ")
        .when(kind == 3, "Command MY/MZ. Response Code 2 A Value 'nd' end. ")
        .otherwise("")
    )
    parity = F.when(F.col("doc_id") % 7 == 0, "PVK Parity Error listed. ").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, parity, "text").alias("text"))
    tagged = ck.tag_chunks(docs)
    return tagged.select(
        "doc_id", "command_code", "response_code", "contains_error_table", ct.content_hash("text").alias("content_hash"), pl.token_estimate("text").alias("tokens")
    )


# Stored chunks: the documents that have a label.  New chunks: all documents.
STORED_SQL = "s AS (SELECT c.* FROM c WHERE chunk_id IN (SELECT doc_id FROM labels))"


def stored_chunks(spark, sf_dir, all_chunks):
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return all_chunks.join(labelled, "chunk_id", "left_semi")


@query(
    "chunk_resume",
    f"""WITH {CHUNKS_SQL}, {STORED_SQL}
SELECT file_hash, chunk_index FROM c WHERE file_hash IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM s WHERE s.file_hash = c.file_hash AND s.chunk_index = c.chunk_index AND s.chunking_version = 'v2')""",
)
def chunk_resume(spark, sf_dir):
    """Chunks still to be embedded: new ones without a stored twin in the current version."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "file_hash", "chunk_index", "chunking_version")
    new = all_chunks.filter(F.col("file_hash").isNotNull()).withColumn("chunking_version", F.lit("v2"))
    return cs.missing_chunks(new, stored_chunks(spark, sf_dir, all_chunks)).select("file_hash", "chunk_index")


@query(
    "resume_state",
    f"""WITH {CHUNKS_SQL}, {STORED_SQL},
w AS (SELECT file_hash, count(DISTINCT chunk_index) AS wanted FROM c WHERE file_hash IS NOT NULL GROUP BY 1),
p AS (SELECT file_hash, count(DISTINCT chunk_index) AS present FROM s WHERE chunking_version = 'v2' GROUP BY 1)
SELECT w.file_hash, wanted, coalesce(present, 0) AS present, coalesce(present, 0) > 0 AND coalesce(present, 0) >= wanted AS reused FROM w LEFT JOIN p USING (file_hash)""",
)
def resume_state(spark, sf_dir):
    """Per file: wanted and present chunks, and whether it is reused as it is."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "file_hash", "chunk_index", "chunking_version").filter(F.col("file_hash").isNotNull())
    return cs.resume_state(all_chunks, stored_chunks(spark, sf_dir, all_chunks))


@query(
    "hash_stats",
    f"""WITH {CHUNKS_SQL}
SELECT file_hash, count(*) AS all_chunks, count(*) FILTER (chunking_version = 'v2') AS chunk_count,
  count(DISTINCT page) FILTER (chunking_version = 'v2') AS total_pages, count(DISTINCT chunk_index) FILTER (chunking_version = 'v2') AS index_count,
  count(*) FILTER (chunking_version = 'v2') > 0 AS found, count(*) FILTER (chunking_version = 'v2') = 0 AS version_mismatch
FROM c WHERE file_hash IS NOT NULL GROUP BY file_hash""",
)
def hash_stats(spark, sf_dir):
    """Per file hash: versions, pages, indexes, reuse flags."""
    return cs.hash_stats(chunks(spark, sf_dir, "file_hash", "chunking_version", "page", "chunk_index"))


@query(
    "rebuild_version",
    f"""WITH {CHUNKS_SQL}, {STORED_SQL},
n AS (SELECT file_hash, chunk_index FROM c WHERE file_hash IS NOT NULL),
o AS (SELECT file_hash FROM s WHERE file_hash IN (SELECT file_hash FROM n) GROUP BY 1 HAVING count(*) FILTER (chunking_version = 'v2') = 0),
k AS (SELECT file_hash, chunk_index, chunking_version FROM s WHERE file_hash IS NULL OR file_hash NOT IN (SELECT file_hash FROM o)),
u AS (SELECT * FROM k UNION ALL SELECT file_hash, chunk_index, 'v2' FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.file_hash = n.file_hash AND k.chunk_index = n.chunk_index AND k.chunking_version = 'v2'))
SELECT file_hash, chunking_version, count(*) AS chunks FROM u GROUP BY ALL""",
)
def rebuild_version(spark, sf_dir):
    """Store after a new upload: outdated files rebuilt, missing chunks added."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "file_hash", "chunk_index", "chunking_version")
    new = all_chunks.filter(F.col("file_hash").isNotNull()).withColumn("chunking_version", F.lit("v2"))
    rebuilt = cs.rebuild_version(stored_chunks(spark, sf_dir, all_chunks), new)
    return rebuilt.groupBy("file_hash", "chunking_version").agg(F.count("*").alias("chunks"))


@query(
    "scanned_documents",
    """WITH p AS (SELECT concat(source, '-', lang) AS file_hash, text FROM documents UNION ALL SELECT concat(source, '-', lang), unnest([' ', chr(10)]) FROM documents WHERE lang = 'es'),
d AS (SELECT file_hash, count(*) AS total_pages, count(*) FILTER (regexp_matches(text, '\\S')) AS pages_with_text FROM p GROUP BY 1)
SELECT file_hash, total_pages, pages_with_text, CASE WHEN total_pages > 30 THEN 'too_many_pages' ELSE 'scanned_pdf' END AS error_type
FROM d WHERE total_pages > 30 OR pages_with_text = 0 OR pages_with_text / total_pages < 0.5""",
)
def scanned_documents(spark, sf_dir):
    """Documents that cannot be indexed; in Spanish two blank pages follow every page."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "lang").alias("file_hash"), "lang", "text")
    blank = docs.filter("lang = 'es'").select("file_hash", F.explode(F.array(F.lit(" "), F.lit("\n"))).alias("text"))
    return ck.scanned_documents(docs.select("file_hash", "text").unionByName(blank), max_pages=30)


@query(
    "batch_plan",
    """WITH RECURSIVE i AS (
  SELECT source AS job, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS BIGINT) AS position, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents),
b AS (
  SELECT job, position, tokens AS used, 1 AS held, CAST(0 AS BIGINT) AS batch_no FROM i WHERE position = 0
  UNION ALL
  SELECT i.job, i.position, CASE WHEN b.held >= 8 OR b.used + i.tokens > 4000 THEN i.tokens ELSE b.used + i.tokens END,
    CASE WHEN b.held >= 8 OR b.used + i.tokens > 4000 THEN 1 ELSE b.held + 1 END,
    CASE WHEN b.held >= 8 OR b.used + i.tokens > 4000 THEN b.batch_no + 1 ELSE b.batch_no END
  FROM b JOIN i ON i.job = b.job AND i.position = b.position + 1)
SELECT job, batch_no, count(*) AS items, CAST(sum(i.tokens) AS BIGINT) AS tokens FROM b JOIN i USING (job, position) GROUP BY ALL""",
)
def batch_plan(spark, sf_dir):
    """Embedding batches of every source: at most 8 items and 4000 tokens each."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("job"), "doc_id", pl.token_estimate("text").alias("tokens"))
    numbered = ranked(docs, ["job"], ["doc_id"], position_block("doc_id"), "position").withColumn("position", F.col("position") - 1)
    planned = ck.plan_batches(stage(numbered.select("job", "position", "tokens"), "items"), max_items=8, max_tokens=4000)
    return planned.groupBy("job", "batch_no").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


@query(
    "library",
    f"""WITH {CHUNKS_SQL}
SELECT file_hash, source AS filename, count(*) AS chunk_count, min(created_at) AS created_at, max(last_accessed) AS last_accessed
FROM c WHERE file_hash IS NOT NULL AND source IS NOT NULL GROUP BY ALL ORDER BY last_accessed DESC NULLS LAST, file_hash, filename LIMIT 50""",
)
def library(spark, sf_dir):
    """Indexed documents, most recently used first."""
    return cs.library(chunks(spark, sf_dir, "file_hash", "source", "created_at", "last_accessed"))


@query("session_stats", f"WITH {CHUNKS_SQL} SELECT session_id, count(*) AS chunk_count FROM c GROUP BY 1")
def session_stats(spark, sf_dir):
    """Chunks per session."""
    return cs.session_stats(chunks(spark, sf_dir, "session_id"))


@query(
    "age_purge",
    f"""WITH {CHUNKS_SQL}
SELECT chunk_id, coalesce(last_accessed, created_at) >= '2024-02-10' AS kept_by_use,
  NOT (coalesce(last_accessed < '2024-02-10', false) OR coalesce(created_at < '2024-02-10', false)) AS kept_by_either FROM c""",
)
def age_purge(spark, sf_dir):
    """Chunks an age purge keeps, by last use and by either time."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "created_at", "last_accessed")
    return all_chunks.select(
        "chunk_id", (~cs.is_stale("2024-02-10")).alias("kept_by_use"), (~cs.is_stale("2024-02-10", True)).alias("kept_by_either")
    )


@query(
    "orphans",
    f"""WITH {CHUNKS_SQL}
SELECT chunk_id, session_id, CAST(page AS VARCHAR) AS page, length(text) AS length, replace(left(text, 100), chr(10), ' ') AS snippet
FROM c WHERE file_hash IS NULL OR file_hash = 'N/A'""",
)
def orphans(spark, sf_dir):
    """Dry-run list of chunks without a file."""
    return cs.orphans(chunks(spark, sf_dir, "chunk_id", "file_hash", "session_id", "page", "text"))


@query(
    "purge_counts",
    f"""WITH {CHUNKS_SQL},
r AS (SELECT CASE WHEN session_id = 'S3' THEN 'session' WHEN file_hash = 'H7' THEN 'file' WHEN coalesce(last_accessed, created_at) < '2024-01-20' THEN 'age' END AS reason FROM c)
SELECT reason, count(*) AS deleted_chunks FROM r WHERE reason IS NOT NULL GROUP BY 1""",
)
def purge_counts(spark, sf_dir):
    """Chunks each purge rule removes."""
    all_chunks = chunks(spark, sf_dir, "session_id", "file_hash", "created_at", "last_accessed")
    return cs.purge_counts(all_chunks, session_id="S3", file_hash="H7", cutoff="2024-01-20")


@query(
    "purge_keep",
    f"""WITH {CHUNKS_SQL}
SELECT chunk_id FROM c WHERE NOT (session_id = 'S3' OR coalesce(file_hash = 'H7', false) OR coalesce(last_accessed, created_at) < '2024-01-20')""",
)
def purge_keep(spark, sf_dir):
    """Chunks that survive a purge by session, file and age."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "session_id", "file_hash", "created_at", "last_accessed")
    return cs.purge(all_chunks, session_id="S3", file_hash="H7", cutoff="2024-01-20").select("chunk_id")


@query(
    "repoint",
    f"""WITH {CHUNKS_SQL}
SELECT chunk_id, CASE WHEN file_hash IN ('H1', 'H2', 'H3') THEN concat('new-', file_hash) ELSE session_id END AS session_id,
  CASE WHEN file_hash IN ('H1', 'H2', 'H3') THEN '2024-03-01T00:00:00' ELSE last_accessed END AS last_accessed FROM c""",
)
def repoint(spark, sf_dir):
    """Chunks of some files given to other sessions."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "file_hash", "session_id", "last_accessed")
    moves = values(
        spark, [(h, f"new-{h}", "2024-03-01T00:00:00") for h in ("H1", "H2", "H3")], "file_hash string, session_id string, accessed_at string"
    )
    return cs.repoint(all_chunks, moves).select("chunk_id", "session_id", "last_accessed")


@query(
    "chunk_scope",
    f"""WITH {CHUNKS_SQL}
SELECT chunk_id, type FROM c WHERE (file_hash IN ('H4', 'H5') OR session_id = 'S9') AND type = 'field_definition'""",
)
def chunk_scope(spark, sf_dir):
    """Chunks of two files or one session, of one type."""
    all_chunks = chunks(spark, sf_dir, "chunk_id", "file_hash", "session_id", "type")
    return cs.scope(all_chunks, "S9", ["H4", "H5"], "field_definition").select("chunk_id", "type")


@query(
    "first_pages",
    f"""WITH {PAGES}
SELECT file_hash, page, CAST(rank AS INTEGER) AS rank FROM (SELECT file_hash, page, row_number() OVER (PARTITION BY file_hash ORDER BY page) AS rank FROM p) WHERE rank <= 3""",
)
def first_pages(spark, sf_dir):
    """First three pages of each document."""
    return top_per_group(pages(spark, sf_dir).select("file_hash", "page"), ["file_hash"], [F.col("page")], 3)


@query(
    "file_stats",
    """WITH l AS (SELECT doc_id, length(text) AS char_count, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]') AS parts FROM documents),
m AS (SELECT doc_id, char_count, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END AS parts FROM l)
SELECT doc_id, CAST(len(parts) AS INTEGER) AS line_count, CAST(len([x for x in parts if regexp_matches(x, '\\S')]) AS INTEGER) AS non_empty_line_count, char_count FROM m""",
)
def file_stats(spark, sf_dir):
    """Lines, non-blank lines and characters of each text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", *[c.alias(n) for n, c in ct.file_stats("text").items()])


@query(
    "capped_text",
    """SELECT doc_id, length(text) > 15000 AS was_cut, CASE WHEN length(text) > 15000 THEN md5(left(text, 15000)) ELSE md5(text) END AS head_hash FROM documents""",
)
def capped_text(spark, sf_dir):
    """Raw texts under the context cap, with a notice when cut."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", pl.capped_raw_text("text").alias("capped"))
    was_cut = F.contains("capped", F.lit("[AVERTISSEMENT SYSTEME"))
    head = F.when(was_cut, F.left("capped", F.lit(fv.RAW_TEXT_CAP))).otherwise(F.col("capped"))
    return docs.select("doc_id", was_cut.alias("was_cut"), F.md5(head).alias("head_hash"))
