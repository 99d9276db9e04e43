"""Registry of queries: a Spark callable per name and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracemill.session import configure, spread, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle SQL."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: run(configure(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


# Trace text rendered from ``events``: 8 files, one session per user, line numbers from event ids.
TRACE_COLUMNS = """
concat('F', CAST(user_id % 8 AS STRING)) AS file_id,
CAST(event_id + 1 AS BIGINT) AS line_no,
concat('2024-01-01 00:00:00.000 0001 SESS_', CAST(user_id AS STRING), '|4| ',
 CASE event_type
  WHEN 'signup' THEN concat('- M.T.I : [', CASE WHEN event_id % 10 = 0 THEN '0800' WHEN event_id % 10 = 1 THEN '1110' ELSE '0200' END, ']')
  WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN concat('- FLD (011) : (6) : [', lpad(CAST(event_id % 97 AS STRING), 6, '0'), ']') ELSE concat('INTERNAL STAN} 6 ', lpad(CAST(event_id % 97 AS STRING), 6, '0')) END
  WHEN 'click' THEN concat('- FLD (037) : (12) : [', lpad(CAST(event_id % 1009 AS STRING), 12, '0'), ']')
  WHEN 'purchase' THEN concat('- FLD (039) : (2) : [', CASE WHEN event_id % 4 = 0 THEN '05' ELSE '00' END, ']')
  ELSE concat('End Fn', CAST(event_id % 7 AS STRING), ' NOK (-1)') END) AS line
"""

# Function, security-module and milestone lines rendered from ``events``.
CALL_COLUMNS = """
concat('F', CAST(user_id % 8 AS STRING)) AS file_id,
CAST(event_id + 1 AS BIGINT) AS line_no,
concat('2024-01-01 00:00:00.000 0001 SESS_', CAST(user_id AS STRING), '|4| ',
 CASE event_id % 16
  WHEN 0 THEN '- M.T.I : [0200]'
  WHEN 1 THEN concat('End Fn', CAST(event_id % 7 AS STRING), ' NOK (-1)')
  WHEN 2 THEN concat('End Fn', CAST(event_id % 7 AS STRING), ' ( NOK )')
  WHEN 3 THEN concat('End Fn', CAST(event_id % 7 AS STRING), '(-1)')
  WHEN 4 THEN concat('Fn', CAST(event_id % 7 AS STRING), '() : résultat -1')
  WHEN 5 THEN concat('Fn', CAST(event_id % 7 AS STRING), '() returned -2')
  WHEN 6 THEN concat('End Fn', CAST(event_id % 7 AS STRING), ' OK')
  WHEN 7 THEN concat('End Fn', CAST(event_id % 7 AS STRING), '(done)')
  WHEN 8 THEN concat('TO HSM : Command=', CASE WHEN event_id % 3 = 0 THEN 'EC' ELSE 'CA' END, CAST(event_id % 5 AS STRING))
  WHEN 9 THEN concat('FROM HSM : <--ED', lpad(CAST(event_id % 20 AS STRING), 2, '0'))
  WHEN 10 THEN concat('HsmResultCode = ', CASE WHEN event_id % 3 = 0 THEN '00' ELSE lpad(CAST(event_id % 20 AS STRING), 2, '0') END)
  WHEN 11 THEN 'End IsoToTlv step'
  WHEN 12 THEN concat('INTERNAL STAN} 6 ', lpad(CAST(event_id % 997 AS STRING), 6, '0'))
  WHEN 13 THEN CASE WHEN event_id % 5 = 0 THEN 'FLD (070) : (3) : [301]' ELSE 'plain words' END
  WHEN 14 THEN concat('Exit swimon_Fn', CAST(event_id % 7 AS STRING), ' != OK')
  ELSE 'Traitement en cours' END) AS line
"""


def trace_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split_columns(TRACE_COLUMNS))


def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split_columns(CALL_COLUMNS))


def _split_columns(text: str) -> list[str]:
    """Top-level expressions of a select list (commas inside parentheses and quotes stay)."""
    out, depth, quoted, current = [], 0, False, ""
    for ch in text.strip():
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                out.append(current)
                current = ""
                continue
        current += ch
    return [*out, current]


def function_specs(spark: SparkSession) -> DataFrame:
    """A small specification that documents Fn0 to Fn4 only (the driver has no such sheet)."""
    rows = [(f"Fn{i}", f"mod{i % 2}", f"/src/fn{i}.c", f"Fonction numéro {i}", "NOK si refus", i) for i in range(5)]
    return values(
        spark, rows, "function string, source string, path string, description string, exception string, spec_no bigint"
    )


# Documents read as stored chunks; the same columns for both engines.
CHUNK_COLUMNS = """
doc_id AS chunk_id,
CASE WHEN doc_id % 23 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'N/A' ELSE concat('H', CAST(doc_id % 50 AS STRING)) END AS file_hash,
concat('S', CAST(doc_id % 20 AS STRING)) AS session_id,
source,
lang,
CAST(doc_id % 40 AS BIGINT) AS page,
CAST(floor(doc_id / 50) AS BIGINT) AS chunk_index,
CASE WHEN doc_id % 50 < 15 THEN 'v1' ELSE 'v2' END AS chunking_version,
concat('2024-01-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0'), 'T00:00:00') AS created_at,
CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat('2024-02-', lpad(CAST(doc_id % 27 + 1 AS STRING), 2, '0'), 'T00:00:00') END AS last_accessed,
CASE doc_id % 13 WHEN 0 THEN 'EC' WHEN 1 THEN 'CA' WHEN 2 THEN 'MY' ELSE NULL END AS command_code,
CASE doc_id % 13 WHEN 0 THEN 'ED' WHEN 1 THEN 'CB' WHEN 3 THEN 'ND' ELSE NULL END AS response_code,
doc_id % 31 = 0 AS contains_error_table,
CASE WHEN doc_id % 10 = 4 THEN 'field_definition' ELSE 'text' END AS type,
CASE WHEN doc_id % 10 = 4 THEN CAST(200 + doc_id % 70 AS STRING) ELSE NULL END AS field_number,
CASE WHEN doc_id % 10 = 4 THEN concat('Champ ', CAST(doc_id % 70 AS STRING)) ELSE NULL END AS field_name,
CASE WHEN doc_id % 20 = 4 THEN concat(CAST(doc_id % 7 + 1 AS STRING), ' N') ELSE '' END AS attributes,
text
"""


def chunks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents as chunks; only the named columns are computed and read."""
    out = table(spark, sf_dir, "documents").selectExpr(*_split_columns(CHUNK_COLUMNS))
    return out.select(*columns) if columns else out


CHUNKS_SQL = f"c AS (SELECT {CHUNK_COLUMNS} FROM documents)"


def sql_values(rows: list[tuple], columns: str) -> str:
    """``(VALUES …) AS t(columns)`` for an oracle."""

    def lit(v) -> str:
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({columns})"
