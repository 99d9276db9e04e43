"""Registered queries over traces rendered from ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import trace_line as tl
from tracemill.operators import events as ev
from tracemill.operators import fields as fd
from tracemill.operators import report as rp
from tracemill.operators import transactions as tr
from tracemill.operators.transactions import TX
from tracemill.plans.catalogue import call_lines, function_specs, query, table, trace_lines
from tracemill.plans.trace_report import analyze
from tracemill.session import stage
from tracemill.sources.refdata import field_reference, rows_of
from tracemill.sources.traces import trace_hints

# Oracles work on the columns of ``events``, never on the rendered text.
FACTS = """
f AS (
  SELECT concat('F', CAST(user_id % 8 AS VARCHAR)) AS file_id, CAST(event_id + 1 AS BIGINT) AS line_no,
    concat('SESS_', CAST(user_id AS VARCHAR)) AS session_id, event_id, event_type,
    event_type = 'signup' AS is_start,
    CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 10 = 0 THEN '0800' WHEN event_id % 10 = 1 THEN '1110' ELSE '0200' END END AS mti,
    CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN lpad(CAST(event_id % 97 AS VARCHAR), 6, '0') END AS stan,
    CASE WHEN event_type = 'view' AND event_id % 2 = 1 THEN lpad(CAST(event_id % 97 AS VARCHAR), 6, '0') END AS f011,
    CASE WHEN event_type = 'click' THEN lpad(CAST(event_id % 1009 AS VARCHAR), 12, '0') END AS rrn,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN '05' ELSE '00' END END AS response_code,
    CASE WHEN event_type = 'error' THEN concat('Fn', CAST(event_id % 7 AS VARCHAR)) END AS fn
  FROM events),
s AS (
  SELECT *, CAST(sum(CASE WHEN is_start THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg,
    min(line_no) OVER (PARTITION BY file_id, session_id) AS session_first
  FROM f),
a AS (
  SELECT file_id, session_id, seg, any_value(session_first) AS session_first,
    min(line_no) FILTER (event_type <> 'error' AND f011 IS NULL) AS first_line,
    max(mti) AS mti, coalesce(bool_or(mti = '0800'), false) AS is_heartbeat,
    arg_max(stan, line_no) FILTER (stan IS NOT NULL) AS stan,
    arg_max(rrn, line_no) FILTER (rrn IS NOT NULL) AS rrn,
    arg_max(response_code, line_no) FILTER (response_code IS NOT NULL) AS response_code
  FROM s GROUP BY ALL),
st AS (SELECT file_id, session_id, seg - 1 AS seg, line_no AS close_line FROM s WHERE is_start),
tx AS (
  SELECT a.*, st.close_line, coalesce(st.close_line, 4611686018427387904) AS close_key
  FROM a LEFT JOIN st USING (file_id, session_id, seg)
  WHERE is_heartbeat OR stan IS NOT NULL OR rrn IS NOT NULL)
"""

def _segmented(spark, sf_dir):
    """Segmented lines, written once because several consumers read them."""
    return stage(tr.segments(tr.line_facts(trace_lines(spark, sf_dir)), responses=True), "lines")


def _closed(segmented):
    return stage(tr.drop_ghosts(tr.assemble(segmented)), "transactions")


APPROVAL = (
    "CASE WHEN response_code IS NULL THEN 'Inconnue' WHEN response_code IN ('00', '000') THEN 'Approuvée' "
    "ELSE concat('Déclinée (Code: ', response_code, ')') END"
)


@query(
    "tx_assemble",
    f"""WITH {FACTS}
SELECT file_id, session_id, seg, first_line, close_line, mti, is_heartbeat, stan, rrn, response_code,
  {APPROVAL} AS approval FROM tx""",
)
def tx_assemble(spark, sf_dir):
    """Transactions per session with their identifiers and outcome (flagship)."""
    tx = tr.transactions(trace_lines(spark, sf_dir))
    return tx.select(
        "file_id", "session_id", "seg", "first_line", "close_line", "mti", "is_heartbeat", "stan", "rrn", "response_code", "approval"
    )


@query(
    "line_components",
    """SELECT concat('F', CAST(user_id % 8 AS VARCHAR)) AS file_id, CAST(event_id + 1 AS BIGINT) AS line_no,
  concat('SESS_', CAST(user_id AS VARCHAR)) AS session_id, '2024-01-01 00:00:00.000' AS ts_text, '4' AS level,
  CASE event_type WHEN 'signup' THEN 16 WHEN 'view' THEN CASE WHEN event_id % 2 = 1 THEN 28 ELSE 23 END
    WHEN 'click' THEN 35 WHEN 'purchase' THEN 24 ELSE 16 END AS message_length
FROM events""",
)
def line_components(spark, sf_dir):
    """Session, time, level and message of every line."""
    rows = tl.split_line(trace_lines(spark, sf_dir))
    return rows.select("file_id", "line_no", "session_id", "ts_text", "level", F.length("message").alias("message_length"))


@query(
    "line_facts",
    f"""WITH {FACTS}
SELECT file_id, CAST(sum(CASE WHEN is_start THEN 1 ELSE 0 END) AS BIGINT) AS starts,
  CAST(sum(CASE WHEN mti = '1110' THEN 1 ELSE 0 END) AS BIGINT) AS responses,
  CAST(sum(CASE WHEN mti = '0800' THEN 1 ELSE 0 END) AS BIGINT) AS heartbeats,
  count(stan) AS stans, count(rrn) AS rrns, count(response_code) AS codes, count(f011) AS dumps_011,
  CAST(sum(CASE WHEN event_type IN ('signup', 'click', 'purchase') OR f011 IS NOT NULL OR stan IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS trace_like
FROM f GROUP BY file_id""",
)
def line_facts(spark, sf_dir):
    """What the lines of each file state, counted."""
    facts = tr.line_facts(trace_lines(spark, sf_dir))
    return facts.groupBy("file_id").agg(
        F.count_if("is_start").alias("starts"),
        F.count_if(tl.is_response_start("line")).alias("responses"),
        F.count_if("is_heartbeat").alias("heartbeats"),
        F.count("stan").alias("stans"),
        F.count("rrn").alias("rrns"),
        F.count("response_code").alias("codes"),
        F.count(tl.dump_011("line")).alias("dumps_011"),
        F.count_if(tl.looks_like_trace("line")).alias("trace_like"),
    )


@query(
    "trace_hints",
    f"""WITH {FACTS}
SELECT file_id, line_no, rank FROM (
  SELECT file_id, line_no, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_no) AS INTEGER) AS rank
  FROM f WHERE event_type <> 'error') WHERE rank <= 200""",
)
def hints(spark, sf_dir):
    """First lines of each file that look like a trace."""
    return trace_hints(trace_lines(spark, sf_dir)).select("file_id", "line_no", "rank")


def _iso(field: int, key: str) -> str:
    return f"CASE {key} " + " ".join(
        f"WHEN '{r[0]}' THEN '{r[field].replace(chr(39), chr(39) * 2)}'" for r in rows_of(fv.ISO_FIELDS) if r[0] in ("011", "037", "039")
    ) + " END"


@query(
    "tx_fields",
    f"""WITH {FACTS},
v AS (SELECT file_id, session_id, seg, line_no, CASE event_type WHEN 'view' THEN '011' WHEN 'click' THEN '037' ELSE '039' END AS field_number,
  coalesce(f011, rrn, response_code) AS value FROM s WHERE coalesce(f011, rrn, response_code) IS NOT NULL)
SELECT file_id, session_id, seg, field_number, min(line_no) AS first_line, max(line_no) AS last_line, arg_max(value, line_no) AS value,
  {_iso(1, 'field_number')} AS name, {_iso(2, 'field_number')} AS description
FROM v GROUP BY file_id, session_id, seg, field_number""",
)
def tx_fields(spark, sf_dir):
    """Fields of every segment: last value, first line, dictionary name."""
    fields = fd.tx_fields(trace_lines(spark, sf_dir))
    return fields.select("file_id", "session_id", "seg", "field_number", "first_line", "last_line", "value", "name", "description")


PAIRS = f"""{FACTS},
e AS (
  SELECT *, max(CASE WHEN mti = '1110' THEN line_no END) OVER w AS open_line,
    max(CASE WHEN f011 IS NOT NULL THEN line_no END) OVER w AS l011,
    max(CASE WHEN response_code IS NOT NULL THEN line_no END) OVER w AS l039
  FROM s WINDOW w AS (PARTITION BY file_id, session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
d AS (SELECT file_id, session_id, open_line, min(line_no) AS done_line FROM e WHERE l011 > open_line AND l039 > open_line GROUP BY ALL),
p AS (
  SELECT d.*, x.f011 AS stan, y.response_code FROM d
  JOIN e z ON z.file_id = d.file_id AND z.line_no = d.done_line
  JOIN e x ON x.file_id = d.file_id AND x.line_no = z.l011
  JOIN e y ON y.file_id = d.file_id AND y.line_no = z.l039)"""


@query("response_pairs", f"WITH {PAIRS} SELECT file_id, session_id, open_line, done_line, stan, response_code FROM p")
def response_pairs(spark, sf_dir):
    """Completed 1110 responses: first line by which fields 011 and 039 were both seen."""
    return tr.response_pairs(_segmented(spark, sf_dir))


def _asof_sql(condition: str) -> str:
    return f"""WITH {PAIRS},
b AS (SELECT tx.file_id, tx.session_id, tx.seg, arg_max(p.response_code, p.done_line) AS network_response
  FROM tx JOIN p ON p.file_id = tx.file_id AND p.stan = tx.stan {condition} GROUP BY ALL)
SELECT tx.file_id, tx.session_id, tx.seg, tx.stan, b.network_response,
  CASE WHEN b.network_response IS NOT NULL THEN concat('{fv.MSG_RESPONSE_SENT[:-3]}', b.network_response, '.')
       WHEN tx.stan IS NOT NULL THEN '{fv.MSG_NO_RESPONSE}' END AS sentence
FROM tx LEFT JOIN b USING (file_id, session_id, seg)"""


def _responses(spark, sf_dir, asof):
    segmented = _segmented(spark, sf_dir)
    tx = _closed(segmented)
    found = tr.response_as_of(tx, tr.response_pairs(segmented), asof)
    return found.select("file_id", "session_id", "seg", "stan", "network_response", tr.response_event().alias("sentence"))


@query("tx_response_asof", _asof_sql("AND p.done_line <= tx.close_key"))
def tx_response_asof(spark, sf_dir):
    """Latest response to the same STAN completed before the transaction closed."""
    return _responses(spark, sf_dir, True)


@query("tx_response_whole_file", _asof_sql(""))
def tx_response_whole_file(spark, sf_dir):
    """The same over the whole file."""
    return _responses(spark, sf_dir, False)


@query(
    "file_order",
    f"""WITH {FACTS}
SELECT file_id, session_id, seg, CAST(row_number() OVER (PARTITION BY file_id ORDER BY close_key, session_first) AS BIGINT) AS tx_no FROM tx""",
)
def file_order(spark, sf_dir):
    """Place of each transaction in its file."""
    tx = _closed(tr.segments(tr.line_facts(trace_lines(spark, sf_dir))))
    return tr.file_order(tx).select("file_id", "session_id", "seg", "tx_no")


def _merge_sql(stan_keys: str = "file_id, stan") -> str:
    return f"""{FACTS},
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY close_key, session_first) AS ord FROM tx),
r1 AS (SELECT *, CASE WHEN stan IS NOT NULL THEN min(ord) OVER (PARTITION BY {stan_keys}) ELSE ord END AS stan_root FROM o),
pr AS (SELECT file_id, rrn, min(ord) AS ord FROM o WHERE stan IS NOT NULL AND rrn IS NOT NULL GROUP BY ALL),
m AS (
  SELECT r1.*, CASE WHEN r1.stan IS NULL AND q.ord IS NOT NULL AND NOT (r1.is_heartbeat AND NOT q.is_heartbeat) THEN q.stan_root ELSE r1.stan_root END AS root,
    CASE WHEN r1.stan IS NULL AND q.ord IS NOT NULL AND NOT (r1.is_heartbeat AND NOT q.is_heartbeat) THEN q.ord ELSE r1.ord END AS target,
    r1.stan IS NULL AND q.ord IS NOT NULL AND NOT (r1.is_heartbeat AND NOT q.is_heartbeat) AS orphan
  FROM r1 LEFT JOIN pr ON pr.file_id = r1.file_id AND pr.rrn = r1.rrn
  LEFT JOIN r1 q ON q.file_id = pr.file_id AND q.ord = pr.ord),
k AS (
  SELECT *, row_number() OVER (PARTITION BY file_id, root ORDER BY target, orphan, ord) AS pos FROM m),
g AS (
  SELECT file_id, root, count(*) AS parts, arg_min(rrn, pos) FILTER (rrn IS NOT NULL) AS rrn,
    arg_min(response_code, pos) FILTER (response_code IS NOT NULL) AS response_code FROM k GROUP BY ALL),
mg AS (
  SELECT o.file_id, o.session_id, o.seg, o.ord, o.close_key, o.session_first, o.mti, o.is_heartbeat, o.stan, g.rrn, g.response_code, g.parts
  FROM g JOIN o ON o.file_id = g.file_id AND o.ord = g.root)"""


@query("tx_merge", f"WITH {_merge_sql()} SELECT file_id, session_id, seg, mti, is_heartbeat, stan, rrn, response_code, parts FROM mg")
def tx_merge(spark, sf_dir):
    """Fragments joined by RRN, duplicates by STAN."""
    return _merged(spark, sf_dir, False)


@query(
    "tx_merge_split_heartbeats",
    f"WITH {_merge_sql('file_id, stan, is_heartbeat')} SELECT file_id, session_id, seg, mti, is_heartbeat, stan, rrn, response_code, parts FROM mg",
)
def tx_merge_split(spark, sf_dir):
    """The same with heartbeats kept apart from business transactions."""
    return _merged(spark, sf_dir, True)


def _merged(spark, sf_dir, split):
    tx = _closed(tr.segments(tr.line_facts(trace_lines(spark, sf_dir))))
    merged = tr.fold_merged(tr.merge_roots(tx, split))
    return merged.select("file_id", "session_id", "seg", "mti", "is_heartbeat", "stan", "rrn", "response_code", "parts")


DOCUMENTED = "fn IN ('Fn0', 'Fn1', 'Fn2', 'Fn3', 'Fn4')"
ALERT_TEXT = (
    f"concat(fn, '() a échoué (résultat : NOK (-1))', CASE WHEN {DOCUMENTED} THEN '.' "
    f"ELSE ' — fonction non documentée dans {ev.SPEC_LABEL}.' END)"
)


@query(
    "tx_failures",
    f"""WITH {FACTS}
SELECT file_id, session_id, seg, fn AS function, CASE WHEN {DOCUMENTED} THEN 'failed' ELSE 'undocumented' END AS kind,
  {ALERT_TEXT} AS alert, min(line_no) AS first_line, count(*) AS times
FROM s WHERE fn IS NOT NULL GROUP BY ALL""",
)
def tx_failures(spark, sf_dir):
    """Failed functions of every segment with their alert."""
    events = ev.chronology(trace_lines(spark, sf_dir), function_specs(spark))
    failed = events.filter(F.col("kind").isin(*ev.FAILED_KINDS))
    return failed.groupBy(*TX, F.col("name").alias("function"), "kind", "alert").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("times")
    )


NO_RESPONSE = fv.MSG_NO_RESPONSE
CALLS = f"""
x AS (
  SELECT concat('F', CAST(user_id % 8 AS VARCHAR)) AS file_id, CAST(event_id + 1 AS BIGINT) AS line_no,
    concat('SESS_', CAST(user_id AS VARCHAR)) AS session_id, event_id, event_id % 16 AS k, event_id % 7 < 5 AS doc,
    concat('Fn', CAST(event_id % 7 AS VARCHAR)) AS fn,
    CASE event_id % 16 WHEN 1 THEN 'NOK (-1)' WHEN 2 THEN '( NOK )' WHEN 3 THEN '(-1)' WHEN 4 THEN 'résultat -1' WHEN 5 THEN 'returned -2' WHEN 14 THEN '!= OK' END AS code,
    concat(CASE WHEN event_id % 3 = 0 THEN 'EC' ELSE 'CA' END, CAST(event_id % 5 AS VARCHAR)) AS cmd,
    concat('ED', lpad(CAST(event_id % 20 AS VARCHAR), 2, '0')) AS reply,
    CASE WHEN event_id % 3 = 0 THEN '00' ELSE lpad(CAST(event_id % 20 AS VARCHAR), 2, '0') END AS res
  FROM events),
y AS (
  SELECT *, CAST(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, session_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seg FROM x),
z AS (
  SELECT file_id, session_id, seg, line_no, 'mti' AS kind, '0200' AS name, 'Message Réseau Entrant (Incoming Request) MTI [0200] (Financial Request) détecté.' AS text, NULL AS alert FROM y WHERE k = 0
  UNION ALL SELECT file_id, session_id, seg, line_no, 'failed', fn, concat('ALERTE : ', fn, '() a échoué (résultat : ', code, ').'), concat(fn, '() a échoué (résultat : ', code, ').') FROM y WHERE code IS NOT NULL AND doc
  UNION ALL SELECT file_id, session_id, seg, line_no, 'undocumented', n, concat('ALERTE : ', n, '() a échoué (résultat : ', code, ') — fonction non documentée dans {ev.SPEC_LABEL}.'),
    concat(n, '() a échoué (résultat : ', code, ') — fonction non documentée dans {ev.SPEC_LABEL}.')
    FROM (SELECT *, CASE WHEN k = 14 THEN concat('swimon_', fn) ELSE fn END AS n FROM y WHERE k = 14 OR (code IS NOT NULL AND NOT doc))
  UNION ALL SELECT file_id, session_id, seg, line_no, 'succeeded', fn, concat('Fonction ', fn, '() exécutée avec succès (résultat : ', CASE WHEN k = 6 THEN 'OK' ELSE 'done' END, ').'), NULL FROM y WHERE k IN (6, 7) AND doc
  UNION ALL SELECT file_id, session_id, seg, line_no, 'to_hsm', concat('Command=', cmd), concat('Échange HSM (TO HSM) : Commande transmise au HSM -> Command=', cmd), NULL FROM y WHERE k = 8
  UNION ALL SELECT file_id, session_id, seg, line_no, 'from_hsm', reply, concat('Échange HSM (FROM HSM) : Réponse reçue du HSM -> ', reply), NULL FROM y WHERE k = 9
  UNION ALL SELECT file_id, session_id, seg, line_no, 'hsm_result', res, concat('Code Résultat HSM (HsmResultCode) : ', res),
    CASE WHEN res <> '00' THEN concat('Erreur HSM détectée : Code d''erreur HSM ', res, '.') END FROM y WHERE k = 10
  UNION ALL SELECT file_id, session_id, seg, line_no, 'step', NULL, '{fv.MSG_ISO_TO_TLV}', NULL FROM y WHERE k = 11)
"""


@query("tx_events", f"WITH {CALLS} SELECT file_id, session_id, seg, line_no, kind, name, text, alert FROM z")
def tx_events(spark, sf_dir):
    """Chronology in compact mode: one row per event."""
    events = ev.chronology(call_lines(spark, sf_dir), function_specs(spark))
    return events.select(*TX, "line_no", "kind", "name", "text", "alert")


@query(
    "tx_events_full",
    f"""WITH {CALLS},
w AS (SELECT file_id, session_id, seg, line_no, kind, text FROM z
  UNION ALL SELECT y.file_id, y.session_id, y.seg, y.line_no, 'line',
    CASE k WHEN 6 THEN concat('End ', fn, ' OK') WHEN 7 THEN concat('End ', fn, '(done)')
      WHEN 12 THEN concat('INTERNAL STAN}} 6 ', lpad(CAST(event_id % 997 AS VARCHAR), 6, '0'))
      WHEN 13 THEN CASE WHEN event_id % 5 = 0 THEN 'FLD (070) : (3) : [301]' ELSE 'plain words' END
      ELSE 'Traitement en cours' END
  FROM y WHERE k IN (12, 13, 15) OR (k IN (6, 7) AND NOT doc))
SELECT file_id, session_id, seg, line_no, kind, concat('(Ligne ', CAST(line_no AS VARCHAR), ') [2024-01-01 00:00:00.000 | 4] ', text) AS text FROM w""".replace("}}", "}"),
)
def tx_events_full(spark, sf_dir):
    """Chronology in full mode: prefixes, and the lines no rule matched."""
    events = ev.chronology(call_lines(spark, sf_dir), function_specs(spark), mode="full")
    return events.select(*TX, "line_no", "kind", "text")


@query(
    "hsm_traffic",
    f"""WITH {CALLS}
SELECT file_id, session_id, seg, kind, name, min(line_no) AS first_line, count(*) AS times, count(alert) AS alerts
FROM z WHERE kind IN ('to_hsm', 'from_hsm', 'hsm_result') GROUP BY ALL""",
)
def hsm_traffic(spark, sf_dir):
    """Security-module commands, replies and results per segment."""
    events = ev.chronology(call_lines(spark, sf_dir), None)
    hsm = events.filter(F.col("kind").isin("to_hsm", "from_hsm", "hsm_result"))
    return hsm.groupBy(*TX, "kind", "name").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("times"), F.count("alert").alias("alerts")
    )


# --- whole analysis ----------------------------------------------------------

ANALYSIS = f"""{_merge_sql()},
al AS (SELECT DISTINCT k.file_id, k.root, {ALERT_TEXT.replace('fn', 's.fn')} AS alert, s.fn FROM s JOIN k USING (file_id, session_id, seg) WHERE s.fn IS NOT NULL),
n AS (SELECT file_id, root, count(DISTINCT fn) AS n_failed, count(DISTINCT alert) AS n_alerts FROM al GROUP BY ALL),
full_mg AS (SELECT mg.*, coalesce(n.n_failed, 0) AS n_failed, coalesce(n.n_alerts, 0) AS n_alerts FROM mg LEFT JOIN n ON n.file_id = mg.file_id AND n.root = mg.ord),
kept AS (SELECT * FROM full_mg WHERE NOT is_heartbeat OR n_failed > 0 OR n_alerts > 0)"""


def _analysis(spark, sf_dir, lines=trace_lines):
    return analyze(lines(spark, sf_dir), specs=function_specs(spark))


@query(
    "tx_final",
    f"""WITH {ANALYSIS}
SELECT file_id, session_id, seg, mti, is_heartbeat, stan, rrn, response_code, parts, n_failed, n_alerts FROM kept""",
)
def tx_final(spark, sf_dir):
    """Finished transactions: merged, heartbeats without findings left out."""
    kept = _analysis(spark, sf_dir).transactions
    return kept.select("file_id", "session_id", "seg", "mti", "is_heartbeat", "stan", "rrn", "response_code", "parts", "n_failed", "n_alerts")


@query(
    "trace_summary",
    f"""WITH {ANALYSIS},
t AS (SELECT file_id, count(*) AS transactions, CAST(sum(n_alerts) AS BIGINT) AS alerts FROM kept GROUP BY ALL)
SELECT file_id, CAST(sum(CASE WHEN is_heartbeat THEN 1 ELSE 0 END) AS BIGINT) AS heartbeats, any_value(t.transactions) AS transactions,
  CAST(0 AS BIGINT) AS hsm_calls, CAST(0 AS BIGINT) AS hsm_commands, any_value(t.alerts) AS alerts
FROM full_mg JOIN t USING (file_id) GROUP BY file_id""",
)
def trace_summary(spark, sf_dir):
    """Header figures of each file."""
    return _analysis(spark, sf_dir).summary()


@query(
    "report_summary",
    f"""WITH {ANALYSIS}
SELECT file_id, count(*) AS total_transactions, count(*) FILTER (n_alerts > 0) AS suspicious_count,
  count(*) FILTER (response_code = '00') AS approved_count, count(*) FILTER (response_code = '05') AS declined_count
FROM kept WHERE NOT is_heartbeat GROUP BY file_id""",
)
def report_summary(spark, sf_dir):
    """Totals of business transactions."""
    return rp.report_summary(tr.business_only(_analysis(spark, sf_dir).transactions))


@query(
    "report_top",
    f"""WITH {ANALYSIS}
SELECT file_id, session_id, seg, n_alerts, report_no FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY n_alerts > 0 DESC, ord) AS INTEGER) AS report_no FROM kept WHERE NOT is_heartbeat)
WHERE report_no <= 20""",
)
def report_top(spark, sf_dir):
    """The 20 transactions of each file's report, those with alerts first."""
    return _analysis(spark, sf_dir).report().select("file_id", "session_id", "seg", "n_alerts", "report_no")


@query(
    "alert_badge",
    f"""WITH {ANALYSIS}
SELECT file_id, session_id, seg, greatest(n_alerts, n_failed) AS badge,
  CASE WHEN rrn IS NOT NULL THEN concat('RRN : ', rrn) WHEN stan IS NOT NULL THEN concat('STAN : ', stan) END AS title FROM kept""",
)
def alert_badge(spark, sf_dir):
    """Badge figure and title of each finished transaction."""
    from tracemill.functions.report import title

    badge = rp.alert_badge(_analysis(spark, sf_dir).transactions)
    return badge.select("file_id", "session_id", "seg", "badge", title("rrn", "stan", F.lit(None).cast("string")).alias("title"))


@query(
    "failed_functions",
    f"""WITH {ANALYSIS}
SELECT al.file_id, al.fn AS function, count(DISTINCT al.root) AS transactions
FROM al JOIN kept ON kept.file_id = al.file_id AND kept.ord = al.root GROUP BY ALL""",
)
def failed_functions(spark, sf_dir):
    """Failed functions over all finished transactions of a file."""
    result = _analysis(spark, sf_dir)
    failed = result.failed_functions().join(result.transactions.select(*TX), TX, "left_semi")
    first = rp.distinct_failed(failed)
    times = failed.groupBy("file_id", "name").agg(F.count("*").alias("transactions"))
    return first.join(times, ["file_id", "name"]).select("file_id", F.col("name").alias("function"), "transactions")


@query(
    "merged_alerts",
    f"""WITH {ANALYSIS},
pl AS (SELECT k.file_id, k.root, k.pos, s.line_no, s.fn, {ALERT_TEXT.replace('fn', 's.fn')} AS alert FROM s JOIN k USING (file_id, session_id, seg) WHERE s.fn IS NOT NULL),
fi AS (SELECT file_id, root, alert, min(pos * 10000000000 + line_no) AS place FROM pl GROUP BY ALL)
SELECT fi.file_id, o.session_id, o.seg, fi.alert, CAST(row_number() OVER (PARTITION BY fi.file_id, fi.root ORDER BY place) AS INTEGER) AS alert_no
FROM fi JOIN o ON o.file_id = fi.file_id AND o.ord = fi.root""",
)
def merged_alerts(spark, sf_dir):
    """Distinct alerts of every merged transaction, numbered in fold order."""
    alerts = _analysis(spark, sf_dir).alerts()
    number = F.row_number().over(Window.partitionBy(*TX).orderBy("first_seen"))
    return alerts.select(*TX, "alert", number.alias("alert_no"))


@query(
    "hsm_commands",
    f"""WITH {CALLS},
t AS (SELECT file_id, session_id, seg, arg_max(lpad(CAST(event_id % 997 AS VARCHAR), 6, '0'), line_no) AS stan FROM y WHERE k = 12 GROUP BY ALL),
h AS (SELECT file_id, session_id, seg FROM y WHERE k = 13 AND event_id % 5 = 0 GROUP BY ALL),
st AS (SELECT file_id, session_id, seg - 1 AS seg, line_no AS close_line FROM y WHERE k = 0),
sf AS (SELECT file_id, session_id, min(line_no) AS session_first FROM y GROUP BY ALL),
u AS (SELECT file_id, session_id, seg, stan FROM t UNION ALL SELECT h.file_id, h.session_id, h.seg, NULL FROM h ANTI JOIN t USING (file_id, session_id, seg)),
o AS (SELECT u.*, row_number() OVER (PARTITION BY file_id ORDER BY coalesce(close_line, 4611686018427387904), session_first) AS ord
  FROM u JOIN sf USING (file_id, session_id) LEFT JOIN st USING (file_id, session_id, seg)),
r AS (SELECT *, CASE WHEN stan IS NULL THEN ord ELSE min(ord) OVER (PARTITION BY file_id, stan) END AS root FROM o),
c AS (SELECT DISTINCT r.file_id, r.root, z.name FROM z JOIN r USING (file_id, session_id, seg) WHERE z.kind = 'to_hsm')
SELECT file_id, name AS command, count(*) AS transactions FROM c GROUP BY ALL""",
)
def hsm_commands(spark, sf_dir):
    """Distinct security-module commands per file with the transactions that sent them."""
    result = analyze(call_lines(spark, sf_dir), specs=function_specs(spark), keep_heartbeats=True)
    return rp.hsm_commands(result.transactions, result.hsm_calls())


@query(
    "report_lines",
    f"""WITH {ANALYSIS},
no AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ord) AS tx_no FROM kept),
pt AS (SELECT k.file_id, k.root, s.* EXCLUDE (file_id) FROM s JOIN k USING (file_id, session_id, seg)),
ch AS (SELECT file_id, root, count(*) FILTER (is_start OR f011 IS NOT NULL OR rrn IS NOT NULL OR response_code IS NOT NULL OR fn IS NOT NULL) AS lines FROM pt GROUP BY ALL),
sn AS (SELECT file_id, root, count(stan) AS sentences FROM k GROUP BY ALL)
SELECT no.file_id, tx_no, 4 AS head_lines, CAST(coalesce(lines, 0) + sentences AS BIGINT) AS chronology_lines, greatest(n_alerts, 1) AS alert_lines
FROM no LEFT JOIN ch ON ch.file_id = no.file_id AND ch.root = no.ord JOIN sn ON sn.file_id = no.file_id AND sn.root = no.ord""",
)
def report_lines(spark, sf_dir):
    """Lines of the text report per transaction and section."""
    text = _analysis(spark, sf_dir).text()
    return text.groupBy("file_id", "tx_no").agg(
        F.count_if(F.col("section") < 4).cast("int").alias("head_lines"),
        F.count_if(F.col("section") == 4).alias("chronology_lines"),
        F.count_if(F.col("section") == 5).alias("alert_lines"),
    )


# --- field conformance -------------------------------------------------------

FIELD_VALUES = """
SELECT CAST(o_orderkey AS VARCHAR) AS tx, '004' AS field_number, CAST(CAST(floor(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS value FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '003', o_orderpriority FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '11', CAST(o_orderkey * 37 AS VARCHAR) FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '039', o_orderstatus FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '049', CASE WHEN o_custkey % 3 = 0 THEN '' WHEN o_custkey % 3 = 1 THEN '978' ELSE '(vide)' END FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '002', concat('4000****', CAST(o_custkey AS VARCHAR)) FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '052', '0123456789ABCDEF' FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '008', o_orderstatus FROM orders
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), '200', o_orderstatus FROM orders
"""
NUMERIC_REASON = f"CASE WHEN regexp_matches(replace(value, '*', ''), '[^0-9]') THEN '{fv.REASON_NOT_NUMERIC}' END"
CONFORMANCE_SQL = f"""
WITH v AS ({FIELD_VALUES}),
d AS (SELECT * FROM (VALUES
  ('002', 'Primary Account Number (PAN)', '19 N', '{fv.NETWORK_SOURCE}', 19, 'N'), ('003', 'Processing Code', '6 N', '{fv.NETWORK_SOURCE}', 6, 'N'),
  ('004', 'Amount, Transaction', '12 N', '{fv.NETWORK_SOURCE}', 12, 'N'), ('008', 'Amount, Cardholder Billing Fee', '8 N', '{fv.STANDARD_SOURCE}', 8, 'N'),
  ('11', 'System Trace Audit Number (STAN)', '6 N', '{fv.NETWORK_SOURCE}', 6, 'N'), ('039', 'Response Code', '2 AN', '{fv.NETWORK_SOURCE}', 2, 'AN'),
  ('049', 'Currency Code, Transaction', '3 N', '{fv.NETWORK_SOURCE}', 3, 'N'), ('052', 'Personal Identification Number (PIN) Data', '8 B', '{fv.NETWORK_SOURCE}', 8, 'B'))
  AS t(field_number, field_name, attributes, source, max_length, expected_type)),
r AS (SELECT v.*, d.* EXCLUDE (field_number),
  CASE WHEN value IN ('', '(vide)') THEN '{fv.REASON_MISSING}' ELSE nullif(concat_ws(' et ',
    CASE WHEN expected_type = 'N' THEN {NUMERIC_REASON} END,
    CASE WHEN length(replace(value, '*', '')) > max_length THEN concat('longueur (', length(replace(value, '*', '')), ') dépasse le maximum (', max_length, ')') END), '') END AS non_conformity_type,
  CASE WHEN value IN ('', '(vide)') THEN '(vide)' ELSE value END AS observed_value
  FROM v JOIN d USING (field_number))
"""


@query(
    "field_conformance",
    CONFORMANCE_SQL
    + """SELECT tx, field_number, field_name, attributes, observed_value, expected_type,
  CASE expected_type WHEN 'N' THEN 'N (numérique)' WHEN 'AN' THEN 'AN (alphanumérique)' ELSE expected_type END AS expected_type_label,
  source, non_conformity_type,
  concat('Champ ', field_name, ' (FLD ', field_number, ') : type attendu ', attributes, ' (', source, '), valeur observée ''', observed_value, ''' — ', non_conformity_type) AS message
FROM r WHERE non_conformity_type IS NOT NULL""",
)
def field_conformance(spark, sf_dir):
    """Values of many transactions checked against the field reference."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("tx"), "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", "o_custkey"
    )
    value = lambda no, c: F.struct(F.lit(no).alias("field_number"), c.cast("string").alias("value"))
    currency = F.when(F.col("o_custkey") % 3 == 0, "").when(F.col("o_custkey") % 3 == 1, "978").otherwise("(vide)")
    fields = orders.select(
        "tx",
        F.inline(
            F.array(
                value("004", F.floor(F.col("o_totalprice") * 100).cast("bigint")),
                value("003", F.col("o_orderpriority")),
                value("11", F.col("o_orderkey") * 37),
                value("039", F.col("o_orderstatus")),
                value("049", currency),
                value("002", F.concat(F.lit("4000****"), F.col("o_custkey").cast("string"))),
                value("052", F.lit("0123456789ABCDEF")),
                value("008", F.col("o_orderstatus")),
                value("200", F.col("o_orderstatus")),
            )
        ),
    )
    bad = fd.conformance(fields, field_reference(spark))
    return bad.select(
        "tx", "field_number", "field_name", "attributes", "observed_value", "expected_type", "expected_type_label", "source",
        "non_conformity_type", "message",
    )


@query(
    "masked_pan",
    """SELECT c_custkey, concat(repeat('*', greatest(length(pan) - 4, 0)), right(pan, 4)) AS pan_masked,
  CASE WHEN c_custkey % 5 = 0 THEN 'rrn:' || c_name WHEN c_custkey % 5 = 1 THEN 'stan:' || CAST(c_custkey AS VARCHAR) ELSE 'transaction_id:T' || CAST(c_custkey AS VARCHAR) END AS match_key
FROM (SELECT *, concat('4000', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS pan FROM customer)""",
)
def masked_pan(spark, sf_dir):
    """Masked card numbers and match keys."""
    from tracemill.functions.report import match_key

    key = F.col("c_custkey")
    pan = F.concat(F.lit("4000"), F.lpad(key.cast("string"), 12, "0"))
    rrn = F.when(key % 5 == 0, F.col("c_name")).otherwise(" ")
    stan = F.when(key % 5 == 1, key.cast("string"))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tl.mask_pan(pan).alias("pan_masked"), match_key(rrn, stan, F.concat(F.lit("T"), key.cast("string"))).alias("match_key")
    )
