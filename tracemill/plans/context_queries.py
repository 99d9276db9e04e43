"""Registered queries over context selection, reports, conversations and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import payload as pl
from tracemill.functions import report as rpf
from tracemill.functions.text import strip
from tracemill.operators import context as cx
from tracemill.operators import report as rp
from tracemill.operators import store as st
from tracemill.operators.containment import literal_array
from tracemill.plans.catalogue import query, sql_values, table
from tracemill.session import stage, values

COUNT_TERMS = [("the",), ("ED",), ("NOK",), ("ther",), ("eau",)]


@query(
    "term_counts",
    f"""WITH t AS (SELECT * FROM {sql_values(COUNT_TERMS, 'term')}),
h AS (SELECT source AS file_id, doc_id, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM documents, t WHERE contains(text, term))
SELECT file_id, term, CAST(sum(n) AS BIGINT) AS occurrences, count(*) FILTER (doc_id > 0) AS transactions FROM h GROUP BY ALL""",
)
def term_counts(spark, sf_dir):
    """Exact occurrences of terms in each file and the blocks that contain them."""
    blocks = table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("block_no"), "text")
    return cx.term_counts(blocks, values(spark, COUNT_TERMS, "term string"))


CONTEXT_TERMS = ["PARITY", "ÖSTERREICH", "REGISTR"]
BUDGET = 12000


def _classed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    body = strip("text")
    return docs.select(
        F.col("source").alias("file_id"),
        F.col("doc_id").alias("block_no"),
        cx.block_class(F.col("text"), literal_array(CONTEXT_TERMS)).alias("block_class"),
        F.length(body).cast("bigint").alias("size"),
    ).filter("size > 0")


TERMS_SQL = " OR ".join(f"contains(replace(upper(text), 'ẞ', 'SS'), '{t}')" for t in CONTEXT_TERMS)
ALERTS_SQL = " OR ".join(f"contains(lower(text), '{w}')" for w in fv.ALERT_WORDS)
BUDGET_SQL = f"""RECURSIVE b AS (
  SELECT source AS file_id, doc_id AS block_no, length(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS size,
    CASE WHEN {TERMS_SQL} THEN 0 WHEN {ALERTS_SQL} THEN 1 ELSE 2 END AS block_class FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY block_class, block_no) AS n FROM b WHERE size > 0),
f AS (
  SELECT file_id, n, block_no, block_class, size, true AS taken, size + 4 AS used FROM o WHERE n = 1
  UNION ALL
  SELECT o.file_id, o.n, o.block_no, o.block_class, o.size, f.used + o.size + 4 <= {BUDGET}, CASE WHEN f.used + o.size + 4 <= {BUDGET} THEN f.used + o.size + 4 ELSE f.used END
  FROM f JOIN o ON o.file_id = f.file_id AND o.n = f.n + 1)"""


@query("context_budget", f"WITH {BUDGET_SQL} SELECT file_id, block_no, block_class, size FROM f WHERE taken")
def context_budget(spark, sf_dir):
    """Whole blocks of every source that fit the character budget."""
    return cx.select_blocks(_classed(spark, sf_dir), BUDGET)


@query(
    "context_notice",
    f"""WITH {BUDGET_SQL}, g AS (SELECT file_id, count(*) AS total, count(*) FILTER (taken) AS included FROM f GROUP BY 1)
SELECT file_id, total, included, CASE WHEN included < total THEN concat('[AVERTISSEMENT TRONCATURAGE DE CONTEXTE : ', included, '/', total, ' transactions complètes incluses (limite de {BUDGET} caractères).]')
  ELSE concat('[TRACE COMPLÈTE : ', total, '/', total, ' transactions incluses.]') END AS notice FROM g""",
)
def context_notice(spark, sf_dir):
    """How many blocks of each source were taken."""
    blocks = stage(_classed(spark, sf_dir), "blocks")
    return cx.inclusion_notice(blocks, cx.select_blocks(blocks, BUDGET), BUDGET)


@query(
    "json_prefix",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(length(concat('{"p":', l_partkey, ',"s":', l_suppkey, ',"f":"', l_returnflag, '"}')) + 2 AS BIGINT) AS size FROM lineitem),
s AS (SELECT *, CAST(sum(size) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag ROWS UNBOUNDED PRECEDING) AS BIGINT) AS json_chars FROM r)
SELECT l_orderkey, count(*) AS kept, max(json_chars) AS json_chars FROM s WHERE json_chars <= 90 GROUP BY l_orderkey""",
)
def json_prefix(spark, sf_dir):
    """Longest prefix of each order's lines whose JSON array stays short enough."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    item = F.to_json(F.struct(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_returnflag").alias("f")))
    kept = cx.json_prefix(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], item, 90)
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.max("json_chars").alias("json_chars"))


@query(
    "payload_fit",
    """WITH b AS (SELECT doc_id, text, concat('Question ', source, ' ', lang) AS question,
    greatest(length(text) // 4, 1) + greatest(length(concat('Question ', source, ' ', lang)) // 4, 1) AS t FROM documents),
e AS (SELECT *, t > 320 AS over, (t - 320) * 4 AS excess, greatest(length(text), length(question)) AS len FROM b),
x AS (SELECT *, over AND NOT len > excess + 200 AS skipped, CASE WHEN over AND len > excess + 200 THEN greatest(200, len - excess - 300) END AS cut FROM e),
y AS (SELECT *, left(text, CAST(cut AS INTEGER)) AS head FROM x),
z AS (SELECT *, CASE WHEN contains(head, chr(10)) AND length(head) - instr(reverse(head), chr(10)) > 200 THEN left(head, CAST(length(head) - instr(reverse(head), chr(10)) AS INTEGER)) ELSE head END AS body FROM y)
SELECT doc_id, skipped, md5(CASE WHEN cut IS NULL THEN text ELSE concat(body, chr(10), chr(10), '[PAYLOAD_TRUNCATED: Troncature appliquée pour le modèle small]') END) AS text_hash FROM z""",
)
def payload_fit(spark, sf_dir):
    """Question and text of each row fitted to a context of 400 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat_ws(" ", F.lit("Question"), "source", "lang").alias("question"))
    fitted = cx.fit_payload(docs, ["text", "question"], 400, "small")
    return fitted.select("doc_id", "skipped", F.md5("text").alias("text_hash"))


@query(
    "payload_fit_json",
    """WITH e AS (SELECT l_suppkey, l_orderkey, l_linenumber, concat('{"l": ', l_linenumber, ', "o": ', l_orderkey, ', "t": "a, b: c"}') AS el FROM lineitem),
b AS (SELECT l_suppkey, string_agg(el, ', ' ORDER BY l_orderkey, l_linenumber) AS body, count(*) AS n FROM e GROUP BY 1),
t AS (SELECT *, length(body) + 2 AS len, greatest((length(body) + 2) // 4, 1) AS t FROM b),
c AS (SELECT *, CASE WHEN t > 1600 AND len > (t - 1600) * 4 + 200 THEN greatest(200, len - (t - 1600) * 4 - 300) END AS cut FROM t),
r AS (SELECT l_suppkey, el, l_orderkey, l_linenumber, sum(length(el) + 2) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) AS size FROM e)
SELECT c.l_suppkey, count(el) AS items, md5(concat('[', coalesce(string_agg(el, ', ' ORDER BY r.l_orderkey, r.l_linenumber), ''), ']')) AS body_hash
FROM c LEFT JOIN r ON r.l_suppkey = c.l_suppkey AND (c.cut IS NULL OR r.size <= c.cut) GROUP BY 1""",
)
def payload_fit_json(spark, sf_dir):
    """A JSON array per supplier fitted to 2,000 tokens; what is cut stays JSON."""
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.struct("l_orderkey", "l_linenumber").alias("e"))
    element = lambda e: F.format_string('{"l": %d, "o": %d, "t": "a, b: c"}', e["l_linenumber"], e["l_orderkey"])
    body = F.array_join(F.transform(F.sort_array(F.collect_list("e")), element), ", ")
    parts = items.groupBy("l_suppkey").agg(F.concat(F.lit("["), body, F.lit("]")).alias("body"))
    fitted = cx.fit_payload(parts, ["body"], 2000)
    held = F.size(F.from_json("body", "array<struct<l: int, o: bigint>>")).cast("bigint")
    return fitted.select("l_suppkey", held.alias("items"), F.md5("body").alias("body_hash"))


@query(
    "last_turns",
    """SELECT conv_id, turn, role, CAST(recency AS INTEGER) AS recency FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS recency FROM conversations) WHERE recency <= 6""",
)
def last_turns(spark, sf_dir):
    """Last six turns of each conversation."""
    return cx.last_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "recency")


@query(
    "search_texts",
    """WITH w AS (SELECT conv_id, turn, role, text, lag(text, 1) OVER o AS p1, lag(text, 2) OVER o AS p2 FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, md5(concat_ws(' ', nullif(p2, ''), nullif(p1, ''), text)) AS search_hash FROM w WHERE role = 'user' AND text <> ''""",
)
def search_texts(spark, sf_dir):
    """Each question with the two turns before it."""
    found = cx.questions_in_context(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", F.md5("search_text").alias("search_hash"))


@query("token_diagnostics", "SELECT role AS component, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role")
def token_diagnostics(spark, sf_dir):
    """Estimated prompt tokens per kind of turn."""
    return cx.token_diagnostics(table(spark, sf_dir, "conversations").select(F.col("role").alias("component"), "text"))


# --- report ------------------------------------------------------------------

STEP = """CASE event_type WHEN 'error' THEN concat('Exécution de Fn', CAST(event_id % 7 AS STRING), 'x() : résultat -1.') WHEN 'click' THEN concat('Appel de Check', CAST(event_id % 3 AS STRING), 'Card refuse NOK')
  WHEN 'view' THEN 'Contrôle OK' WHEN 'purchase' THEN 'FN1X terminé' ELSE 'Début' END"""


@query(
    "step_functions",
    """WITH s AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN concat('Fn', CAST(event_id % 7 AS VARCHAR), 'x') WHEN 'click' THEN concat('Check', CAST(event_id % 3 AS VARCHAR), 'Card') END AS f FROM events)
SELECT user_id, f AS function, min(event_id) AS first_step FROM s WHERE f IS NOT NULL GROUP BY ALL""",
)
def step_functions(spark, sf_dir):
    """Failed functions told by chronology steps."""
    steps = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("step_no"), F.expr(STEP).alias("step"))
    return rp.step_functions(steps, ["user_id"])


@query(
    "step_status",
    """SELECT event_id, CASE event_type WHEN 'error' THEN CASE WHEN event_id % 7 = 1 THEN 'error' ELSE 'neutral' END WHEN 'view' THEN 'success' WHEN 'purchase' THEN 'error' ELSE 'neutral' END AS status FROM events""",
)
def step_status(spark, sf_dir):
    """Status of every step, given one failed function."""
    steps = table(spark, sf_dir, "events").select("event_id", F.expr(STEP).alias("step"))
    return steps.select("event_id", rpf.step_status("step", F.array(F.lit("Fn1x"))).alias("status"))


@query(
    "report_enrich",
    """WITH p AS (SELECT o_custkey % 40 AS f, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS idx, lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS rrn, o_orderpriority AS fn,
    CASE WHEN o_orderstatus = 'F' THEN '000000' END AS pc FROM orders),
k AS (SELECT f, rrn, arg_max(fn, idx) AS fn, arg_max(pc, coalesce(idx, 0)) FILTER (true) AS any_pc, max(idx) AS last FROM p GROUP BY ALL),
kk AS (SELECT k.f, k.rrn, p.fn, p.pc FROM k JOIN p ON p.f = k.f AND p.idx = k.last),
r AS (SELECT p.f, p.idx, CASE WHEN idx % 3 = 0 THEN NULL ELSE p.rrn END AS rrn, idx % 2 = 0 AS told FROM p),
m AS (SELECT r.*, CASE WHEN r.rrn IS NOT NULL THEN kk.fn ELSE p.fn END AS fn, CASE WHEN r.rrn IS NOT NULL THEN kk.pc ELSE p.pc END AS pc
  FROM r JOIN p ON p.f = r.f AND p.idx = r.idx LEFT JOIN kk ON kk.f = r.f AND kk.rrn = r.rrn)
SELECT concat('F', CAST(f AS VARCHAR)) AS file_id, CAST(idx AS BIGINT) AS idx, concat(fn, CASE WHEN told THEN ',GetOriginal' ELSE '' END, ',AuthProcess') AS failed,
  concat(fn, '() échoue', CASE WHEN told THEN ';GetOriginal() a échoué.' ELSE '' END, ';AuthProcess() a échoué.') AS alerts, pc AS processing_code,
  concat('Échec détecté sur : ', fn, CASE WHEN told THEN ', GetOriginal' ELSE '' END, ', AuthProcess.') AS hint FROM m""",
)
def report_enrich(spark, sf_dir):
    """Report rows completed with parser facts, by RRN or else by position (orders stand for transactions)."""
    orders = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("F"), (F.col("o_custkey") % 40).cast("string")).alias("file_id"), "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"
    )
    parsed = stage(
        cx.rank_positions(orders, ["file_id"], "o_orderkey", "idx").select(
            "file_id",
            "idx",
            F.lpad(F.col("o_custkey").cast("string"), 12, "0").alias("rrn"),
            F.lit(None).cast("string").alias("stan"),
            F.lit(None).cast("string").alias("transaction_id"),
            F.array("o_orderpriority").alias("failed_functions"),
            F.array(F.concat("o_orderpriority", F.lit("() échoue"))).alias("alerts"),
            F.when(F.col("o_orderstatus") == "F", "000000").alias("processing_code"),
        ),
        "parsed",
    )
    step = F.when(F.col("idx") % 2 == 0, F.lit("Exécution de GetOriginal() : résultat -1."))
    report = parsed.select(
        "file_id",
        "idx",
        F.when(F.col("idx") % 3 != 0, F.col("rrn")).alias("rrn"),
        "stan",
        "transaction_id",
        F.array(F.lit("AuthProcess")).alias("failed_functions"),
        F.array().cast("array<string>").alias("alerts"),
        F.lit(None).cast("string").alias("processing_code"),
        F.array_compact(F.array(step)).alias("steps"),
        F.lit("").alias("hint"),
    )
    out = rp.enrich_report(report, parsed)
    return out.select(
        "file_id", "idx", F.array_join("failed_functions", ",").alias("failed"), F.array_join("alerts", ";").alias("alerts"), "processing_code", "hint"
    )


# --- conversations -----------------------------------------------------------

CONV = "v AS (SELECT conv_id, role AS agent_type, turn, text, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (conv_id * 40 + turn) AS created_at FROM conversations)"


def _versions(spark, sf_dir):
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 40 + F.col("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("agent_type"), "turn", "text", at.alias("created_at"))


@query(
    "recent_conversations",
    f"""WITH {CONV} SELECT agent_type, conv_id * 1000 + turn AS id, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY agent_type ORDER BY created_at DESC, conv_id * 1000 + turn) AS rank FROM v) WHERE rank <= 10""",
)
def recent_conversations(spark, sf_dir):
    """Ten latest entries per agent."""
    rows = _versions(spark, sf_dir).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return st.recent(rows, activity="created_at").select("agent_type", "id", "rank")


@query(
    "upsert_latest",
    """SELECT user_id AS id, min(ts) AS created_at, max(ts) AS updated_at, arg_max(event_type, ts) AS title FROM events GROUP BY user_id""",
)
def upsert_latest(spark, sf_dir):
    """Change log folded to the latest version per key (older half upserted by the newer half)."""
    log = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.col("event_type").alias("title")
    )
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    return st.upsert(log.filter(F.col("created_at") < middle), log.filter(F.col("created_at") >= middle))


@query(
    "patch_rows",
    """SELECT c_custkey AS id, coalesce(o.m, c_mktsegment) AS title, c_name AS note FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS m FROM orders GROUP BY 1) o ON o_custkey = c_custkey""",
)
def patch_rows(spark, sf_dir):
    """Partial update: given values replace old ones, nulls and unknown keys do not."""
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("title"), F.col("c_name").alias("note"))
    changes = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(
        F.max("o_orderpriority").alias("title"), F.max(F.lit(None).cast("string")).alias("note")
    )
    return st.patch(old, changes)


@query(
    "delete_outcome",
    """SELECT k.id, c_custkey IS NOT NULL AS deleted FROM (SELECT DISTINCT l_partkey AS id FROM lineitem) k LEFT JOIN customer ON c_custkey = k.id""",
)
def delete_outcome(spark, sf_dir):
    """Which requested keys there was something to delete for."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return st.delete_outcome(rows, table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")))


@query(
    "delete_rows",
    """SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def delete_rows(spark, sf_dir):
    """Rows left after deleting keys."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("id"))
    return st.delete_keys(rows, urgent)


@query(
    "latest_files",
    """WITH f AS (SELECT source, lang, arg_max(text, doc_id) AS text, max(doc_id) AS added_at FROM documents GROUP BY ALL)
SELECT source AS session_id, lang AS name, added_at, length(text) AS char_count FROM f""",
)
def latest_files(spark, sf_dir):
    """Newest version of each session file with its size."""
    files = table(spark, sf_dir, "documents").select(
        F.col("source").alias("session_id"), F.col("lang").alias("name"), F.col("doc_id").alias("added_at"), F.col("text").alias("content")
    )
    return st.latest_files(files).select("session_id", "name", "added_at", "char_count")


@query(
    "conversation_titles",
    """WITH w AS (SELECT conv_id, turn, [x for x in regexp_split_to_array(text, '[\\s\\x{A0}]+') if x <> ''] AS words FROM conversations)
SELECT conv_id, turn, concat(array_to_string(words[1:8], ' '), CASE WHEN len(words) > 8 THEN '…' ELSE '' END) AS title FROM w""",
)
def conversation_titles(spark, sf_dir):
    """First eight words of every turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pl.conversation_title("text").alias("title"))


@query(
    "unique_titles",
    f"""WITH {CONV},
b AS (SELECT conv_id * 1000 + turn AS id, agent_type, created_at, left(concat('Dossier ', split_part(text, ' ', 1)), 80) AS title FROM v),
n AS (SELECT *, row_number() OVER (PARTITION BY agent_type, title ORDER BY created_at, id) AS n, strftime(created_at, '%H:%M') AS hm FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY agent_type, title, hm ORDER BY created_at, id) AS m FROM n WHERE n > 1),
o AS (SELECT *, row_number() OVER (PARTITION BY agent_type, title ORDER BY created_at, id) + 1 AS o FROM m WHERE m > 1)
SELECT id, title AS unique_title FROM n WHERE n = 1 UNION ALL SELECT id, left(concat(title, ' · ', hm), 80) FROM m WHERE m = 1
UNION ALL SELECT id, left(concat(title, ' #', CAST(o AS VARCHAR)), 80) FROM o""",
)
def unique_titles(spark, sf_dir):
    """A title per entry that its agent has not used yet."""
    rows = _versions(spark, sf_dir).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        "agent_type",
        "created_at",
        F.concat(F.lit("Dossier "), F.split_part("text", F.lit(" "), F.lit(1))).alias("title"),
    )
    return st.unique_titles(stage(rows, "titles")).select("id", "unique_title")


# --- usage -------------------------------------------------------------------

RESPONSE = """CASE WHEN event_id % 3 = 0 THEN concat('{"usage_metadata":{"input_tokens":', CAST(user_id AS STRING), ',"output_tokens":', CAST(event_id % 50 AS STRING), ',"total_tokens":0}}')
 WHEN event_id % 3 = 1 THEN concat('{"response_metadata":{"model_name":"m1","token_usage":{"prompt_tokens":', CAST(user_id AS STRING), ',"completion_tokens":', CAST(event_id % 50 AS STRING), ',"total_tokens":', CAST(user_id + event_id % 50 + 1 AS STRING), '}}}')
 ELSE '{"other":1}' END"""


def _usage(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp"), F.col("event_type").alias("agent"), "event_id", F.expr(RESPONSE).alias("response"))
    return st.usage_entries(events, "m0")


USAGE = """u AS (SELECT event_id, ts AS timestamp, event_type AS agent, CASE WHEN event_id % 3 = 1 THEN 'm1' ELSE 'm0' END AS model,
  CAST(CASE WHEN event_id % 3 < 2 THEN user_id ELSE 0 END AS BIGINT) AS input_tokens, CAST(CASE WHEN event_id % 3 < 2 THEN event_id % 50 ELSE 0 END AS BIGINT) AS output_tokens,
  CAST(CASE event_id % 3 WHEN 0 THEN user_id + event_id % 50 WHEN 1 THEN user_id + event_id % 50 + 1 ELSE 0 END AS BIGINT) AS total_tokens FROM events)"""


@query("usage_entries", f"WITH {USAGE} SELECT timestamp, agent, model, input_tokens, output_tokens, total_tokens FROM u")
def usage_entries(spark, sf_dir):
    """Token counts read from both response shapes."""
    return _usage(spark, sf_dir)


@query(
    "usage_budget",
    f"""WITH {USAGE}, s AS (SELECT agent, CAST(sum(total_tokens) AS BIGINT) AS used FROM u GROUP BY agent)
SELECT agent, used, CAST(1000000 AS BIGINT) AS budget, greatest(0, 1000000 - used) AS remaining, round(used / 1000000 * 100, 1) AS percentage FROM s""",
)
def usage_budget(spark, sf_dir):
    """Used and remaining tokens per agent."""
    return st.usage_budget(_usage(spark, sf_dir), keys=["agent"])


@query(
    "daily_usage",
    "SELECT CAST(ts AS DATE) AS usage_date, count(*) AS request_count, count(*) >= 340 AS limit_reached FROM events GROUP BY 1",
)
def daily_usage(spark, sf_dir):
    """Requests per day against a limit."""
    return st.daily_usage(table(spark, sf_dir, "events").select(F.col("ts").alias("timestamp")), limit=340)


@query("usage_tail", f"WITH {USAGE} SELECT timestamp, agent, total_tokens FROM u ORDER BY timestamp DESC LIMIT 50")
def usage_tail(spark, sf_dir):
    """Last fifty usage entries."""
    return st.usage_tail(_usage(spark, sf_dir)).select("timestamp", "agent", "total_tokens")


@query(
    "fenced_reports",
    """SELECT o_orderkey, o_custkey AS total, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_custkey AS BIGINT) END AS parsed FROM orders""",
)
def fenced_reports(spark, sf_dir):
    """Report JSON read from response text blocks, with and without code fences."""
    body = F.concat(F.lit('{"summary":{"total_transactions":'), F.col("o_custkey").cast("string"), F.lit("}}"))
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    text = F.when(F.col("o_orderstatus") == "F", fenced).when(F.col("o_orderstatus") == "P", "désolé").otherwise(body)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.array(text, F.lit(None).cast("string")).alias("blocks"))
    parsed = pl.parsed_report(pl.joined_blocks("blocks"), "summary struct<total_transactions:bigint>")
    return orders.select("o_orderkey", F.col("o_custkey").alias("total"), parsed["summary"]["total_transactions"].alias("parsed"))
