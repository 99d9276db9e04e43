"""Registered queries over security-module codes, excerpts and reference tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import hsm
from tracemill.operators import documentation as dc
from tracemill.plans.catalogue import CHUNKS_SQL, chunks, query, table
from tracemill.plans.retrieval_queries import MAP_SQL
from tracemill.session import values
from tracemill.sources import documents as sd
from tracemill.sources import refdata as rd

# Alert texts rendered from ``events``: what each says is known from its columns.
ALERT_TEXT = """CASE event_id % 7
  WHEN 0 THEN lpad(CAST(event_id % 20 AS STRING), 2, '0')
  WHEN 1 THEN concat('ED', lpad(CAST(event_id % 20 AS STRING), 2, '0'))
  WHEN 2 THEN concat('Erreur HSM détectée : Code d''erreur HSM ', lpad(CAST(event_id % 100 AS STRING), 2, '0'), '.')
  WHEN 3 THEN concat('Code Résultat HSM (HsmResultCode) : ', CAST(event_id % 900 + 100 AS STRING))
  WHEN 4 THEN 'ED'
  WHEN 5 THEN 'CA'
  ELSE concat('HsmResultCode = ', lpad(CAST(event_id % 50 AS STRING), 2, '0')) END"""
CODES_SQL = """e AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN lpad(CAST(event_id % 20 AS VARCHAR), 2, '0') WHEN 1 THEN concat('ED', lpad(CAST(event_id % 20 AS VARCHAR), 2, '0'))
    WHEN 2 THEN lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') WHEN 3 THEN CAST(event_id % 900 + 100 AS VARCHAR) WHEN 4 THEN 'ED' WHEN 5 THEN 'CA' ELSE lpad(CAST(event_id % 50 AS VARCHAR), 2, '0') END AS lookup_key,
  CASE event_id % 7 WHEN 1 THEN 'EC' WHEN 4 THEN 'EC' WHEN 5 THEN 'CA' END AS command_code,
  CASE event_id % 7 WHEN 1 THEN 'ED' WHEN 4 THEN 'ED' WHEN 5 THEN 'CB' END AS response_code,
  CASE event_id % 7 WHEN 1 THEN lpad(CAST(event_id % 20 AS VARCHAR), 2, '0') WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 0 THEN lpad(CAST(event_id % 20 AS VARCHAR), 2, '0')
    WHEN 2 THEN lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') WHEN 3 THEN CAST(event_id % 900 + 100 AS VARCHAR) ELSE lpad(CAST(event_id % 50 AS VARCHAR), 2, '0') END AS error_number
  FROM events)"""


def _alerts(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("event_id", f"{ALERT_TEXT} AS raw")


def _resolved(spark):
    return rd.resolve_codes(rd.command_pairs(spark))


@query(
    "hsm_code_parse",
    f"""WITH {CODES_SQL}
SELECT event_id, lookup_key, command_code, response_code, error_number,
  CASE WHEN event_id % 7 = 1 THEN concat('EC → ED / ', error_number) WHEN event_id % 7 = 4 THEN 'EC → ED' WHEN event_id % 7 = 5 THEN 'CA → CB' ELSE lookup_key END AS display FROM e""",
)
def hsm_code_parse(spark, sf_dir):
    """Free texts to lookup key, command, response, error number and display."""
    parsed = dc.parse_hsm_codes(_alerts(spark, sf_dir), _resolved(spark))
    return parsed.select("event_id", "lookup_key", "command_code", "response_code", "error_number", "display")


@query(
    "hsm_codes_in_texts",
    f"""WITH {CODES_SQL} SELECT event_id, lookup_key FROM e WHERE event_id % 7 IN (1, 2, 3, 4, 6)""",
)
def hsm_codes_in_texts(spark, sf_dir):
    """Codes of the texts that are about the security module."""
    return dc.codes_in_texts(_alerts(spark, sf_dir), _resolved(spark), "raw").select("event_id", "lookup_key")


@query(
    "hsm_report_codes",
    """SELECT event_id, CASE event_id % 7 WHEN 1 THEN concat('ED', lpad(CAST(event_id % 20 AS VARCHAR), 2, '0'))
  WHEN 2 THEN lpad(CAST(event_id % 100 AS VARCHAR), 2, '0') WHEN 6 THEN lpad(CAST(event_id % 50 AS VARCHAR), 2, '0') END AS code FROM events""",
)
def hsm_report_codes(spark, sf_dir):
    """Codes as the report reads them from alert texts."""
    code = hsm.report_code("raw")
    return _alerts(spark, sf_dir).select("event_id", code.alias("code"))


@query(
    "code_pairs",
    f"""WITH {MAP_SQL}, n AS (SELECT upper(left(p_name, 1)) || upper(left(split_part(p_name, ' ', 2), 1)) AS code FROM part)
SELECT n.code, coalesce(f.cmd, i.cmd) AS target_command, coalesce(f.resp, i.resp) AS target_response, count(*) AS parts
FROM n LEFT JOIN m f ON f.cmd = n.code LEFT JOIN m i ON i.resp = n.code GROUP BY ALL""",
)
def code_pairs(spark, sf_dir):
    """Command / response reading of two-letter codes taken from the initials of part names."""
    second = F.split_part("p_name", F.lit(" "), F.lit(2))
    codes = table(spark, sf_dir, "part").select(F.upper(F.concat(F.left("p_name", F.lit(1)), F.left(second, F.lit(1)))).alias("code"))
    joined = codes.join(_resolved(spark).drop("is_command"), "code", "left")
    return joined.groupBy("code", "target_command", "target_response").agg(F.count("*").alias("parts"))


ERRORS = "('05'), ('15'), ('99'), ('ED'), ('ED05'), ('EC')"


@query(
    "dictionary_entries",
    f"""WITH {CODES_SQL}, d(code) AS (VALUES {ERRORS}),
k AS (SELECT event_id, 1 AS p, lookup_key AS k FROM e UNION ALL SELECT event_id, 2, concat(coalesce(response_code, ''), coalesce(error_number, '')) FROM e
  UNION ALL SELECT event_id, 3, error_number FROM e UNION ALL SELECT event_id, 4, response_code FROM e UNION ALL SELECT event_id, 5, command_code FROM e)
SELECT event_id, arg_min(d.code, p) AS entry_code FROM k JOIN d ON d.code = k.k GROUP BY event_id""",
)
def dictionary_entries(spark, sf_dir):
    """Dictionary entry of each code, most specific key first."""
    parsed = dc.parse_hsm_codes(_alerts(spark, sf_dir), _resolved(spark)).withColumnRenamed("event_id", "query_id")
    found = dc.dictionary_entries(parsed, rd.hsm_errors(spark))
    return found.select(F.col("query_id").alias("event_id"), "entry_code")


PAGE_CODES = [("Q1", "ED05"), ("Q2", "la"), ("Q3", "IT"), ("Q4", "17")]
PAGE_VALUES = "(VALUES ('Q1', 'ED05', '05', 'ED', 'EC', 'ED05'), ('Q2', 'LA', '', 'LA', '', 'LA'), ('Q3', 'IT', '', 'IT', '', 'IT'), ('Q4', '17', '17', '', '', '17')) AS q(query_id, k, n, r, c, rn)"


@query(
    "page_hits",
    f"""WITH h AS (SELECT query_id, doc_id AS page,
    CASE WHEN n <> '' AND contains(text, n) THEN 3 ELSE 0 END + CASE WHEN r <> '' AND contains(upper(text), r) THEN 2 ELSE 0 END
    + CASE WHEN c <> '' AND contains(upper(text), c) THEN 1 ELSE 0 END + CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'response') THEN 1 ELSE 0 END AS score
  FROM documents, {PAGE_VALUES}
  WHERE regexp_matches(text, '\\S') AND ((k <> '' AND contains(upper(text), k)) OR (n <> '' AND contains(upper(text), n)) OR (r <> '' AND contains(upper(text), r)) OR (c <> '' AND contains(upper(text), c)) OR (rn <> '' AND contains(upper(text), rn)))),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page) AS rank FROM h)
SELECT query_id, page, score, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= 4""",
)
def page_hits(spark, sf_dir):
    """Best pages that contain parts of a code."""
    codes = values(spark, PAGE_CODES, "query_id string, raw string")
    parsed = dc.parse_hsm_codes(codes, _resolved(spark))
    pages = table(spark, sf_dir, "documents").select(F.lit("doc").alias("source"), F.col("doc_id").alias("page"), "text")
    return dc.page_hits(parsed, pages).select("query_id", "page", "score", "rank")


# Excerpts with known signs: a tail added to each document decides the score.
SIGNS = """concat(text, chr(10), CASE doc_id % 6 WHEN 0 THEN 'Command EC gives ED. Error code table' WHEN 1 THEN 'Response code ED' WHEN 2 THEN 'AS2805 annex' WHEN 3 THEN '''05'': refus'
  WHEN 4 THEN 'All Rights Reserved' ELSE '--- Page 3 ---' END)"""


@query(
    "best_excerpts",
    """WITH w AS (SELECT doc_id, source, doc_id % 6 AS k, CASE WHEN doc_id % 11 = 0 THEN 'CA' WHEN doc_id % 2 = 0 THEN 'EC' END AS mc, upper(text) AS up,
    regexp_split_to_array(upper(text), '[^\\p{L}\\p{N}_]+') AS words FROM documents),
s AS (SELECT doc_id, source, CAST(CASE WHEN mc = 'CA' THEN -100 ELSE 0 END
    + CASE WHEN k = 0 OR list_contains(words, 'EC') THEN 20 ELSE 0 END + CASE WHEN k IN (0, 1) OR list_contains(words, 'ED') THEN 20 ELSE 0 END
    + CASE WHEN k IN (0, 1) OR contains(up, 'ERROR CODE') OR contains(up, 'RESPONSE CODE') THEN 15 ELSE 0 END + CASE WHEN contains(up, 'NO ERROR') THEN 10 ELSE 0 END
    + CASE WHEN k = 3 OR regexp_matches(up, '''\\d{2}''\\s*:') THEN 15 ELSE 0 END + CASE WHEN k = 2 OR contains(up, 'AS2805') THEN -30 ELSE 0 END AS DOUBLE) AS score FROM w),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM s WHERE score >= -20)
SELECT source AS query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2""",
)
def best_excerpts(spark, sf_dir):
    """Two best excerpts of every source for the pair EC / ED."""
    docs = table(spark, sf_dir, "documents")
    meta = F.when(F.col("doc_id") % 11 == 0, "CA").when(F.col("doc_id") % 2 == 0, "EC")
    excerpts = docs.select(
        F.col("source").alias("query_id"),
        "doc_id",
        F.col("doc_id").alias("place"),
        F.expr(SIGNS).alias("content"),
        meta.alias("meta_command"),
        F.lit(None).cast("string").alias("meta_response"),
        F.lit("EC").alias("command_code"),
        F.lit("ED").alias("response_code"),
    )
    return dc.best_excerpts(excerpts).select("query_id", "doc_id", "score", "rank")


@query(
    "clean_excerpts",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS hash FROM documents""",
)
def clean_excerpts(spark, sf_dir):
    """Page marks and running heads put around every text and taken out again."""
    docs = table(spark, sf_dir, "documents")
    framed = F.concat(
        F.lit("--- Page 7 ---\npayShield 10K Core Host Commands\n"), "text", F.lit("\n--- Début page suivante (contexte) ---\nX All Rights Reserved")
    )
    return docs.select("doc_id", F.md5(hsm.without_page_artifacts(framed)).alias("hash"))


@query(
    "excerpts_with_error",
    """SELECT doc_id, n FROM (SELECT doc_id, text, lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') AS n FROM documents)
WHERE contains(text, n) OR contains(concat(' ', text, ' '), concat(' ', ltrim(n, '0'), ' ')) OR contains(lower(text), 'error') OR contains(lower(text), 'parity')""",
)
def excerpts_with_error(spark, sf_dir):
    """Excerpts that name an error number or are generic error tables."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lpad((F.col("doc_id") % 30).cast("string"), 2, "0").alias("n"))
    return docs.filter(hsm.names_error("text", "n")).select("doc_id", "n")


DOC_CODES = [("Q1", "ED05", "S1"), ("Q2", "CA", "S2"), ("Q3", "HsmResultCode = 99", "S3"), ("Q4", "ZZ", "none"), ("Q5", "ND", "none")]


@query("hsm_documentation")
def hsm_documentation(spark, sf_dir):
    """Documentation of codes: session chunks, any chunks, pages, dictionary."""
    codes = values(spark, DOC_CODES, "query_id string, raw string, session_id string")
    base = chunks(spark, sf_dir, "chunk_id", "file_hash", "session_id", "source", "page", "command_code", "response_code", "contains_error_table", "text")
    pages = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    docs = dc.hsm_documentation(codes, base, pages, rd.hsm_errors(spark), _resolved(spark))
    return docs.select("query_id", "origin", "rank", "label", "display", F.length("content").alias("size"))


@query(
    "hsm_doc_origins",
    f"""WITH {CHUNKS_SQL}, {MAP_SQL},
k AS (SELECT chunk_id, list_distinct(regexp_split_to_array(upper(text), '[^\\p{{L}}\\p{{N}}_]+')) AS words FROM c),
a AS (SELECT concat(m.cmd, '@', s) AS query_id, m.cmd, m.resp, s FROM m, (SELECT DISTINCT session_id AS s FROM c)),
h AS (SELECT a.query_id, a.s = c.session_id AS mine FROM a JOIN c ON true JOIN k USING (chunk_id)
  WHERE coalesce(c.command_code IN (cmd, resp), false) OR coalesce(c.response_code IN (cmd, resp), false) OR contains_error_table OR contains(lower(text), 'pvk parity error') OR list_contains(words, cmd) OR list_contains(words, resp))
SELECT query_id, CASE WHEN bool_or(mine) THEN 'rag_session' ELSE 'rag' END AS origin FROM h GROUP BY query_id""",
)
def hsm_doc_origins(spark, sf_dir):
    """Level that answers each known command in each session."""
    base = chunks(spark, sf_dir, "chunk_id", "file_hash", "session_id", "source", "page", "command_code", "response_code", "contains_error_table", "text")
    commands = F.array(*[F.lit(line.split()[0]) for line in fv.COMMAND_RESPONSES.strip().splitlines()])
    codes = base.select("session_id").distinct().select("session_id", F.explode(commands).alias("raw"))
    codes = codes.select(F.concat_ws("@", "raw", "session_id").alias("query_id"), "raw", "session_id")
    pages = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")
    docs = dc.hsm_documentation(codes, base, pages, rd.hsm_errors(spark), _resolved(spark))
    return docs.filter("origin <> 'dictionary'").select("query_id", "origin").distinct()


# --- reference tables --------------------------------------------------------


@query(
    "field_sections",
    """WITH d AS (SELECT source, doc_id AS page, CASE WHEN doc_id % 3 = 0 THEN [concat('Field ', CAST(doc_id % 128 + 1 AS VARCHAR), '—Nom ', CAST(doc_id AS VARCHAR))] ELSE [] END AS header,
    regexp_split_to_array(replace(replace(coalesce(text, ''), 'Field', 'F.'), 'field', 'f.'), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\x{2028}\\x{2029}]') AS parts FROM documents),
s AS (SELECT source, page, max(CASE WHEN len(header) > 0 THEN page END) OVER (PARTITION BY source ORDER BY page) AS section,
    list_concat(header, CASE WHEN parts[-1] = '' THEN parts[1:len(parts) - 1] ELSE parts END) AS lines FROM d),
l AS (SELECT source, section, page, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s WHERE section IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY source, section ORDER BY page, i) - 1 AS no FROM l)
SELECT source, section AS page, CAST(section % 128 + 1 AS VARCHAR) AS field_number, concat('Nom ', CAST(section AS VARCHAR)) AS field_name,
  CAST(no // 20 AS INTEGER) AS part, min(no) + 1 AS first_line, count(*) AS line_count, md5(string_agg(line, chr(10) ORDER BY no)) AS text_md5
FROM n GROUP BY source, section, no // 20""",
)
def field_sections(spark, sf_dir):
    """Field sections of every source in parts of 20 lines; every third document is a page that opens a section."""
    docs = table(spark, sf_dir, "documents")
    header = F.concat(F.lit("Field "), (F.col("doc_id") % 128 + 1).cast("string"), F.lit("—Nom "), F.col("doc_id").cast("string"), F.lit("\n"))
    body = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("Field"), F.lit("F.")), F.lit("field"), F.lit("f."))
    head = F.when(F.col("doc_id") % 3 == 0, header).otherwise("")
    pages = docs.select("source", F.col("doc_id").alias("page"), F.concat(head, body).alias("text"))
    out = sd.field_sections(pages, size=20)
    return out.select("source", "page", "field_number", "field_name", "part", "first_line", "line_count", F.md5("text").alias("text_md5"))


@query(
    "field_table",
    """WITH r AS (SELECT p_brand AS source, p_partkey, CAST(p_partkey % 140 + 1 AS INTEGER) AS number, p_name AS name, p_size AS length, p_partkey % 5 AS k FROM part)
SELECT source, CAST(number AS VARCHAR) AS number, arg_min(name, p_partkey) AS name, arg_min(length, p_partkey) AS length,
  arg_min(CASE k WHEN 0 THEN 'N' WHEN 1 THEN 'N' WHEN 2 THEN 'ANS' WHEN 3 THEN 'B' ELSE 'N' END, p_partkey) AS type_code,
  arg_min(CASE k WHEN 0 THEN '' WHEN 1 THEN 'BCD' WHEN 2 THEN '' WHEN 3 THEN 'Binary' ELSE 'BCD' END, p_partkey) AS format
FROM r WHERE number <= 128 GROUP BY source, number""",
)
def field_table(spark, sf_dir):
    """Field definitions read from table rows printed for every part (``EBCDIC`` contains ``BCD`` and counts as such)."""
    kind = F.col("p_partkey") % 5
    raw = F.when(kind == 0, "N").when(kind == 1, "AN , EBCDIC").when(kind == 2, "ANS").when(kind == 3, "B").otherwise("BCD")
    row = F.concat_ws("   ", (F.col("p_partkey") % 140 + 1).cast("string"), "p_name", F.col("p_size").cast("string"), raw)
    pages = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("source"), F.col("p_partkey").alias("page"), F.concat(F.lit("Tableau\n"), row, F.lit("\nfin")).alias("text")
    )
    return sd.field_table(pages).select("source", "number", "name", "length", "type_code", "format")


@query(
    "field_overlay",
    """WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS number, p_name AS name, p_size AS length, 'N' AS type_code FROM part WHERE p_size > 10),
e AS (SELECT CAST(p_partkey AS VARCHAR) AS number, p_type AS name, CASE WHEN p_retailprice > 950 THEN p_size ELSE p_size + 1 END AS length, CASE WHEN p_size % 4 = 0 THEN 'AN' WHEN p_size % 4 = 1 THEN 'C0' ELSE 'N' END AS type_code FROM part WHERE p_size < 40)
SELECT number, CASE WHEN s.number IS NULL OR (g.number IS NOT NULL AND (s.length <> g.length OR s.type_code <> g.type_code)) THEN g.name ELSE s.name END AS name,
  CASE WHEN s.number IS NULL OR (g.number IS NOT NULL AND (s.length <> g.length OR s.type_code <> g.type_code)) THEN g.length ELSE s.length END AS length
FROM s FULL JOIN (SELECT * FROM e WHERE type_code <> 'C0') g USING (number)""",
)
def field_overlay(spark, sf_dir):
    """Seed definitions overlaid by extracted ones (parts stand for fields)."""
    part = table(spark, sf_dir, "part")
    base = dict(number=F.col("p_partkey").cast("string"), format=F.lit(""), source=F.lit("x"))
    seed = part.filter("p_size > 10").select(
        base["number"].alias("number"), F.col("p_name").alias("name"), F.col("p_size").alias("length"), F.lit("N").alias("type_code"),
        base["format"].alias("format"), base["source"].alias("source"),
    )
    kind = F.when(F.col("p_size") % 4 == 0, "AN").when(F.col("p_size") % 4 == 1, "C0").otherwise("N")
    length = F.when(F.col("p_retailprice") > 950, F.col("p_size")).otherwise(F.col("p_size") + 1)
    extracted = part.filter("p_size < 40").select(
        base["number"].alias("number"), F.col("p_type").alias("name"), length.alias("length"), kind.alias("type_code"),
        base["format"].alias("format"), base["source"].alias("source"),
    )
    return rd.overlay_fields(seed, extracted).select("number", "name", "length")


@query(
    "sheet_lines",
    """SELECT n_name AS sheet, c_custkey AS row_no, concat('Ligne ', CAST(c_custkey AS VARCHAR), ': ', concat_ws(' | ', c_name, nullif(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END, ''), CAST(c_nationkey AS VARCHAR))) AS text
FROM customer JOIN nation ON n_nationkey = c_nationkey""",
)
def sheet_lines(spark, sf_dir):
    """Sheet rows flattened to text, empty cells skipped."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("sheet"))
    cells = table(spark, sf_dir, "customer").join(nations, "c_nationkey").select(
        "sheet",
        F.col("c_custkey").alias("row_no"),
        F.concat(F.lit(" "), "c_name").alias("a"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("b"),
        F.col("c_nationkey").alias("c"),
    )
    return sd.sheet_lines(cells, ["a", "b", "c"], keys=["sheet"])


@query(
    "function_specs",
    """WITH r AS (SELECT c_mktsegment AS function, c_custkey AS row_no, c_name AS source, CASE WHEN c_acctbal < 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS path FROM customer)
SELECT function, arg_max(source, row_no) AS source, arg_max(path, row_no) AS path, min(row_no) AS spec_no FROM r GROUP BY function""",
)
def function_specs(spark, sf_dir):
    """Spec rows cleaned: the last row of a name wins, the first one sets the order."""
    rows = table(spark, sf_dir, "customer").select(
        F.concat(F.lit(" "), "c_mktsegment", F.lit("\t")).alias("function"),
        F.concat("c_name", F.lit(" ")).alias("source"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey").cast("string")).alias("path"),
        F.lit("d").alias("description"),
        F.lit(None).cast("string").alias("exception"),
        F.col("c_custkey").alias("row_no"),
    )
    blank = rows.withColumn("function", F.lit("  "))
    return rd.clean_specs(rows.unionByName(blank)).select("function", "source", "path", "spec_no")


@query(
    "documents_union",
    """SELECT type, count(*) AS documents, count(function) AS functions, count(field_number) AS fields FROM (
  SELECT 'function' AS type, c_name AS function, NULL AS field_number FROM customer UNION ALL SELECT 'field_definition', NULL, CAST(p_partkey AS VARCHAR) FROM part) GROUP BY type""",
)
def documents_union(spark, sf_dir):
    """Function and field documents in one table."""
    specs = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("function"), F.lit("m").alias("source"), F.lit("p").alias("path"), F.lit("d").alias("description"), F.lit("e").alias("exception")
    )
    sections = table(spark, sf_dir, "part").select(
        F.lit("pdf").alias("source"), F.col("p_partkey").cast("string").alias("field_number"), F.col("p_name").alias("field_name"),
        F.lit("").alias("attributes"), F.col("p_size").alias("page"), F.col("p_type").alias("text"),
    )
    docs = sd.all_documents(sd.spec_documents(specs, "sheet"), sd.section_documents(sections))
    return docs.groupBy("type").agg(
        F.count("*").alias("documents"), F.count("function").alias("functions"), F.count("field_number").alias("fields")
    )
