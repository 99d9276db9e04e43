"""Registered queries over documents and embeddings: keyword, vector, code and function lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import questions as qf
from tracemill.operators import documentation as dc
from tracemill.operators import retrieval as rt
from tracemill.operators.containment import contains_join
from tracemill.plans.catalogue import CHUNKS_SQL, chunks, query, sql_values, table
from tracemill.session import small, values
from tracemill.sources.refdata import command_pairs, resolve_codes

TERMS = [("ther",), ("eaux",), ("Schl",), ("parity error",), ("100%",), ("the_",), ("über",)]


@query(
    "keyword_topk",
    f"""WITH {CHUNKS_SQL}, t AS (SELECT * FROM {sql_values(TERMS, 'term')}),
h AS (SELECT term, chunk_id, row_number() OVER (PARTITION BY term ORDER BY chunk_id) AS rank FROM c JOIN t ON contains(lower(c.text), lower(t.term)))
SELECT term, chunk_id, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 5""",
)
def keyword_topk(spark, sf_dir):
    """First five chunks that contain each term, ignoring case."""
    terms = values(spark, TERMS, "term string")
    return rt.keyword_search(chunks(spark, sf_dir, "chunk_id", "text"), terms).select("term", "chunk_id", "rank")


@query(
    "keyword_in_session",
    f"""WITH {CHUNKS_SQL}, t AS (SELECT term, concat('S', CAST(i AS VARCHAR)) AS session_id FROM {sql_values(TERMS, 'term')}, generate_series(0, 19) AS g(i)),
h AS (SELECT term, session_id, chunk_id, row_number() OVER (PARTITION BY term, session_id ORDER BY chunk_id) AS rank FROM c JOIN t USING (session_id) WHERE contains(lower(c.text), lower(t.term)))
SELECT session_id, term, chunk_id, CAST(rank AS INTEGER) AS rank FROM h WHERE rank <= 3""",
)
def keyword_in_session(spark, sf_dir):
    """The same inside each session only."""
    terms = values(spark, [(t, f"S{i}") for (t,) in TERMS for i in range(20)], "term string, session_id string")
    hits = rt.keyword_search(chunks(spark, sf_dir, "chunk_id", "session_id", "text"), terms, 3, keys=("term", "session_id"))
    return hits.select("session_id", "term", "chunk_id", "rank")


@query(
    "benchmark_containment",
    """SELECT b.item_id, d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''""",
)
def benchmark_containment(spark, sf_dir):
    """Documents that contain the whole text of a benchmark item (long needle lists use grams)."""
    needles = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    return contains_join(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", needles, "item").select("item_id", "doc_id")


# Words of conversations, without the marks around them, as a long needle list.
LONG_WORDS = "regexp_extract_all(lower(text), '[a-z]{10,}')"


@query(
    "vocabulary_hits",
    f"""WITH w AS (SELECT DISTINCT unnest({LONG_WORDS}) AS word FROM conversations)
SELECT word, count(*) AS documents, min(doc_id) AS first_doc FROM documents d JOIN w ON contains(lower(d.text), w.word) GROUP BY word""",
)
def vocabulary_hits(spark, sf_dir):
    """How many documents hold each long word of the conversations: thousands of needles in one pass."""
    words = table(spark, sf_dir, "conversations").select(F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]{10,}', 0)")).alias("word")).distinct()
    hits = contains_join(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", words, "word", ignore_case=True)
    return hits.groupBy("word").agg(F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"))


# Every label's first vector asks for its nearest neighbours.
ASK = "q AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS v, label FROM embeddings GROUP BY label)"
COSINE = "list_cosine_similarity(CAST(q.v AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


def _asked(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.groupBy(F.col("label").alias("query_id")).agg(F.min_by("embedding", "vec_id").alias("vector"))


def _stored(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


@query(
    "vector_topk",
    f"""WITH {ASK}, r AS (SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, vec_id) AS rank FROM q, embeddings e)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8""",
)
def vector_topk(spark, sf_dir):
    """Eight nearest vectors of each query by cosine."""
    return rt.vector_topk(_asked(spark, sf_dir), _stored(spark, sf_dir), 8).select("query_id", "chunk_id", "rank")


@query(
    "vector_topk_scoped",
    f"""WITH {ASK}, r AS (SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, vec_id) AS rank FROM q JOIN embeddings e ON e.label = q.label)
SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def vector_topk_scoped(spark, sf_dir):
    """The same among vectors with the query's label; 16 asked, at most 10 given."""
    asked = _asked(spark, sf_dir).withColumn("label", F.col("query_id"))
    return rt.vector_topk(asked, _stored(spark, sf_dir), 16, match=("label",), max_k=10).select("query_id", "chunk_id", "rank")


@query(
    "hybrid_union",
    f"""WITH {ASK},
s AS (SELECT query_id, chunk_id, rank FROM (SELECT query_id, vec_id AS chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY {COSINE} DESC, vec_id) AS rank FROM q, embeddings e) WHERE rank <= 8),
t AS (SELECT DISTINCT label AS query_id, concat('ther', chr(CAST(97 + label AS INTEGER))) AS term FROM embeddings),
k AS (SELECT query_id, chunk_id, rank FROM (SELECT t.query_id, d.doc_id AS chunk_id, row_number() OVER (PARTITION BY t.query_id ORDER BY d.doc_id) AS rank FROM documents d JOIN t ON contains(lower(d.text), t.term)) WHERE rank <= 5),
b AS (SELECT query_id, chunk_id, 0 AS source, rank FROM k UNION ALL SELECT query_id, chunk_id, 1, rank FROM s),
x AS (SELECT b.*, regexp_replace(regexp_replace(d.text, '^\\s+', ''), '\\s+$', '') AS body FROM b JOIN documents d ON d.doc_id = b.chunk_id),
f AS (SELECT query_id, body, min((source, rank, chunk_id)) AS p FROM x GROUP BY ALL),
g AS (SELECT query_id, p, row_number() OVER (PARTITION BY query_id ORDER BY p) AS rank FROM f)
SELECT query_id, CAST(p[3] AS BIGINT) AS chunk_id, CAST(p[1] AS INTEGER) AS source, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 10""",
)
def hybrid_union(spark, sf_dir):
    """Keyword hits before vector hits, distinct by text, ten per query."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    terms = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("query_id"), F.concat(F.lit("ther"), F.char(F.lit(97) + F.col("label"))).alias("term")
    ).distinct()
    keyword = rt.keyword_search(texts, terms, 5, keys=("query_id",)).select("query_id", "chunk_id", "text", "rank")
    near = rt.vector_topk(_asked(spark, sf_dir), _stored(spark, sf_dir), 8)
    semantic = near.join(texts, "chunk_id").select("query_id", "chunk_id", "text", "rank")
    return rt.hybrid_union(keyword, semantic).select("query_id", "chunk_id", "source", "rank")


# --- command codes -----------------------------------------------------------

ASKED_CODES = ["ED", "EC", "MY", "ND", "LA", "IT", "ZZ", "CB"]
MAP_SQL = "m(cmd, resp) AS (VALUES " + ", ".join(
    "('{}', '{}')".format(*line.split()) for line in fv.COMMAND_RESPONSES.strip().splitlines()
) + ")"
TOKENS_SQL = "k AS (SELECT chunk_id, list_distinct(regexp_split_to_array(upper(text), '[^\\p{L}\\p{N}_]+')) AS words FROM c)"
LOOKUP_SQL = f"""{CHUNKS_SQL}, {MAP_SQL}, {TOKENS_SQL},
r AS (SELECT a.*, coalesce(f.cmd, i.cmd, code) AS tc, coalesce(f.resp, i.resp, code) AS tr FROM a LEFT JOIN m f ON f.cmd = code LEFT JOIN m i ON i.resp = code),
h AS (SELECT r.query_id, r.code, r.tc, r.tr, c.chunk_id,
    CASE WHEN c.response_code IN (tc, tr) OR c.command_code IN (tc, tr) THEN 1 WHEN contains_error_table OR contains(lower(text), 'pvk parity error') THEN 2
      WHEN list_contains(words, code) THEN 3 WHEN list_contains(words, tc) OR list_contains(words, tr) THEN 4 END AS class
  FROM r JOIN c ON r.session_id IS NULL OR r.session_id = c.session_id JOIN k USING (chunk_id)),
u AS (SELECT *, min(class) OVER (PARTITION BY query_id) AS best FROM h WHERE class IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY class, chunk_id) AS rank FROM u WHERE class < 4 OR best = 4)"""


def _lookup_chunks(spark, sf_dir):
    return chunks(spark, sf_dir, "chunk_id", "file_hash", "session_id", "command_code", "response_code", "contains_error_table", "text")


@query(
    "command_lookup",
    f"""WITH a(query_id, code, session_id) AS (VALUES {', '.join(f"('{c}', '{c}', NULL)" for c in ASKED_CODES)}), {LOOKUP_SQL}
SELECT query_id, tc AS target_command, tr AS target_response, chunk_id, class, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= 8""",
)
def command_lookup(spark, sf_dir):
    """Chunks for two-letter codes, read as command or response."""
    codes = values(spark, [(c, c) for c in ASKED_CODES], "query_id string, code string")
    hits = rt.command_lookup(codes, _lookup_chunks(spark, sf_dir), resolve_codes(command_pairs(spark)))
    return hits.select("query_id", "target_command", "target_response", "chunk_id", "class", "rank")


@query(
    "command_lookup_in_session",
    f"""WITH a AS (SELECT concat(code, '@', s) AS query_id, code, s AS session_id FROM (VALUES {', '.join(f"('{c}')" for c in ASKED_CODES)}) AS x(code), (SELECT DISTINCT concat('S', CAST(doc_id % 20 AS VARCHAR)) AS s FROM documents)),
{LOOKUP_SQL}
SELECT query_id, chunk_id, class, CAST(rank AS INTEGER) AS rank FROM w WHERE rank <= 3""",
)
def command_lookup_in_session(spark, sf_dir):
    """The same inside every session."""
    base = _lookup_chunks(spark, sf_dir)
    sessions = base.select("session_id").distinct()
    codes = sessions.select("session_id", F.explode(F.array(*[F.lit(c) for c in ASKED_CODES])).alias("code")).select(
        F.concat_ws("@", "code", "session_id").alias("query_id"), "code", "session_id"
    )
    hits = rt.command_lookup(codes, base, resolve_codes(command_pairs(spark)), limit=3)
    return hits.select("query_id", "chunk_id", "class", "rank")


@query(
    "spec_snippets",
    f"""WITH a(query_id, code, session_id) AS (VALUES {', '.join(f"('{c}', '{c}', NULL)" for c in ASKED_CODES)}), {LOOKUP_SQL},
n(code, code_no) AS (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(ASKED_CODES))}),
x AS (SELECT n.code_no, w.rank, regexp_replace(regexp_replace(c.text, '^\\s+', ''), '\\s+$', '') AS body,
    CASE WHEN tc <> tr THEN concat('[Code Commande ''', tc, ''' ↔ Code Réponse ''', tr, '''] ') ELSE '' END AS head
  FROM w JOIN n USING (code) JOIN c USING (chunk_id) WHERE w.rank <= 3),
f AS (SELECT body, min((code_no, rank)) AS place, arg_min(concat(head, body), (code_no, rank)) AS snippet FROM x WHERE body <> '' GROUP BY body)
SELECT CAST(rank AS INTEGER) AS rank, md5(snippet) AS snippet_hash FROM (SELECT row_number() OVER (ORDER BY place) AS rank, snippet FROM f) WHERE rank <= 4""",
)
def spec_snippets(spark, sf_dir):
    """First four distinct snippets for the codes of one question."""
    codes = values(spark, [(c, c, i) for i, c in enumerate(ASKED_CODES)], "query_id string, code string, code_no int")
    base = _lookup_chunks(spark, sf_dir)
    hits = rt.command_lookup(codes.select("query_id", "code"), base, resolve_codes(command_pairs(spark)), limit=3)
    read = hits.drop("code").join(codes, "query_id").join(base.select("chunk_id", "text"), "chunk_id")
    out = rt.spec_snippets(read.withColumn("question_id", F.lit("Q")))
    return out.select("rank", F.md5("snippet").alias("snippet_hash"))


# --- questions ---------------------------------------------------------------


@query(
    "question_codes",
    """WITH q AS (SELECT conv_id, turn, text, CASE (conv_id + turn) % 6 WHEN 0 THEN concat('Que signifie le code de réponse ED pour le champ 0', CAST(turn + 1 AS VARCHAR), ' ?')
    WHEN 1 THEN 'la commande EC est-elle valide ?' WHEN 2 THEN 'commande dont la réponse est CB' WHEN 3 THEN 'Résume-moi l''ensemble avec FLD 039'
    WHEN 4 THEN 'le code ''KA'' ou "KB"' ELSE 'rien à signaler' END AS question FROM conversations)
SELECT conv_id, turn,
  CASE (conv_id + turn) % 6 WHEN 0 THEN 'ED' WHEN 1 THEN 'EC' WHEN 2 THEN 'CB' WHEN 3 THEN '' WHEN 4 THEN 'KA,KB' ELSE '' END AS codes,
  CASE (conv_id + turn) % 6 WHEN 0 THEN CAST(turn + 1 AS VARCHAR) WHEN 3 THEN '39' END AS field_number,
  CASE (conv_id + turn) % 6 WHEN 3 THEN 16 ELSE 8 END AS k FROM q""",
)
def question_codes(spark, sf_dir):
    """Codes, field number and breadth of questions asked in conversations."""
    turns = table(spark, sf_dir, "conversations")
    kind = (F.col("conv_id") + F.col("turn")) % 6
    question = (
        F.when(kind == 0, F.concat(F.lit("Que signifie le code de réponse ED pour le champ 0"), (F.col("turn") + 1).cast("string"), F.lit(" ?")))
        .when(kind == 1, "la commande EC est-elle valide ?")
        .when(kind == 2, "commande dont la réponse est CB")
        .when(kind == 3, "Résume-moi l'ensemble avec FLD 039")
        .when(kind == 4, "le code 'KA' ou \"KB\"")
        .otherwise("rien à signaler")
    )
    asked = turns.select("conv_id", "turn", question.alias("q"))
    return asked.select(
        "conv_id",
        "turn",
        F.array_join(qf.code_tokens("q"), ",").alias("codes"),
        qf.first_field_number("q").alias("field_number"),
        qf.chunks_wanted("q").alias("k"),
    )


@query(
    "question_terms",
    f"""WITH w AS (SELECT conv_id, turn, unnest(regexp_extract_all(replace(upper(text), 'ẞ', 'SS'), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM conversations),
s AS (SELECT unnest(string_split('{fv.TERM_STOPWORDS}', ' ')) AS word)
SELECT conv_id, turn, count(DISTINCT word) AS terms FROM w WHERE length(word) >= 2 AND word NOT IN (SELECT word FROM s) GROUP BY ALL""",
)
def question_terms(spark, sf_dir):
    """Number of search terms of every turn (codes, short words and plain words united)."""
    stopwords = F.array(*[F.lit(w) for w in fv.TERM_STOPWORDS.split()])
    asked = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.array_except(qf.search_terms("text"), stopwords).alias("t")
    )
    return asked.select("conv_id", "turn", F.size("t").cast("bigint").alias("terms")).filter("terms > 0")


@query(
    "field_search_terms",
    """WITH f AS (SELECT DISTINCT CAST(l_linenumber AS VARCHAR) AS n FROM lineitem)
SELECT n, t AS term FROM (SELECT n, unnest(list_distinct([concat('Field ', n), concat('Field', n), concat('Champ ', n), concat('Champ', n), concat('FLD ', lpad(n, 3, '0')), concat('FLD', lpad(n, 3, '0')), concat('FLD ', n)])) AS t FROM f)""",
)
def field_search_terms(spark, sf_dir):
    """Spellings under which each field number is searched."""
    numbers = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("string").alias("n")).distinct()
    return numbers.select("n", F.explode(qf.field_search_terms(F.col("n"))).alias("term"))


# --- function specifications -------------------------------------------------

SPEC_QUERIES = [
    (1, "nation key of customers"),
    (2, "Supplier#000000007 refuse"),
    (3, "automobile building"),
    (4, "rien"),
]
SPEC_SQL = f"""sp AS (SELECT c_name AS function, c_mktsegment AS description, concat(c_mktsegment, ' nation ', CAST(c_nationkey AS VARCHAR)) AS exception, c_custkey AS spec_no FROM customer
  UNION ALL SELECT s_name, 'supplier building', 'refuse', s_suppkey + 1000000000 FROM supplier),
qq AS (SELECT query_id, lower(query) AS q, [x for x in regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') if length(x) > 2] AS words FROM {sql_values(SPEC_QUERIES, 'query_id, query')}),
sc AS (SELECT query_id, function, spec_no, CAST(coalesce(list_sum([
    CASE WHEN contains(lower(function), w) THEN 10 ELSE 0 END + CASE WHEN contains(lower(description), w) THEN 3 ELSE 0 END + CASE WHEN contains(lower(exception), w) THEN 2 ELSE 0 END for w in words]), 0) AS INTEGER)
  + CASE WHEN contains(q, lower(function)) THEN 20 ELSE 0 END AS score FROM sp, qq)"""


def _specs(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("function"),
        F.col("c_mktsegment").alias("description"),
        F.concat(F.col("c_mktsegment"), F.lit(" nation "), F.col("c_nationkey").cast("string")).alias("exception"),
        F.col("c_custkey").alias("spec_no"),
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("function"),
        F.lit("supplier building").alias("description"),
        F.lit("refuse").alias("exception"),
        (F.col("s_suppkey") + 1000000000).alias("spec_no"),
    )
    return customers.unionByName(suppliers).withColumns({"source": F.lit("mod"), "path": F.lit("/src")})


@query(
    "spec_score_topk",
    f"""WITH {SPEC_SQL}
SELECT query_id, function, score, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, spec_no, function) AS rank FROM sc WHERE score >= 8) WHERE rank <= 4""",
)
def spec_score_topk(spark, sf_dir):
    """Best function specs per question by word points."""
    queries = values(spark, SPEC_QUERIES, "query_id int, query string")
    return rt.spec_score_topk(queries, _specs(spark, sf_dir)).select("query_id", "function", "score", "rank")


@query(
    "accept_hits",
    f"""WITH {SPEC_SQL},
hv AS (SELECT 1 AS query_id, c_name AS function, row_number() OVER (ORDER BY c_custkey) AS rank FROM customer UNION ALL SELECT 2, s_name, row_number() OVER (ORDER BY s_suppkey) FROM supplier),
hh AS (SELECT * FROM hv WHERE rank <= 8),
ok AS (SELECT DISTINCT query_id FROM hh JOIN (SELECT query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM {sql_values(SPEC_QUERIES, 'query_id, query')}) USING (query_id)
  WHERE len([w for w in ws if contains(lower(function), w)]) > 0),
kw AS (SELECT query_id, function, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, spec_no, function) AS rank FROM sc WHERE score >= 8 AND query_id NOT IN (SELECT query_id FROM ok))
SELECT query_id, function, CAST(rank AS INTEGER) AS rank, 'vector' AS origin FROM hh WHERE query_id IN (SELECT query_id FROM ok)
UNION ALL SELECT query_id, function, CAST(rank AS INTEGER), 'keyword' FROM kw WHERE rank <= 8""",
)
def accept_hits(spark, sf_dir):
    """Vector hits kept where they name a function of the question, else keyword-scored specs."""
    queries = values(spark, SPEC_QUERIES, "query_id int, query string")
    first = lambda name, key, column, q: table(spark, sf_dir, name).select(
        F.lit(q).alias("query_id"), F.col(column).alias("function"), F.col(key).alias("k")
    )
    hits = rt.limit_per(
        first("customer", "c_custkey", "c_name", 1).unionByName(first("supplier", "s_suppkey", "s_name", 2)), ["query_id"], ["k"], 8
    ).select("query_id", "rank", "function")
    return rt.accept_hits(queries, hits, _specs(spark, sf_dir)).select("query_id", "function", "rank", "origin")


@query(
    "specs_in_alerts",
    """SELECT o.o_orderkey, s.s_name AS function FROM (SELECT o_orderkey, concat('Erreur ', lower(c_name), ' via SUPPLIER#', lpad(CAST(o_orderkey % 90 AS VARCHAR), 9, '0'), ' refusée') AS alert
  FROM orders JOIN customer ON c_custkey = o_custkey) o JOIN (SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer) s ON contains(lower(alert), lower(s.s_name))""",
)
def specs_in_alerts(spark, sf_dir):
    """Documented functions named in alert texts, ignoring case."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    names = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    number = F.lpad((F.col("o_orderkey") % 90).cast("string"), 9, "0")
    alerts = orders.join(names, "c_custkey").select(
        "o_orderkey", F.concat(F.lit("Erreur "), F.lower("c_name"), F.lit(" via SUPPLIER#"), number, F.lit(" refusée")).alias("alert")
    )
    return dc.specs_in_alerts(alerts, _specs(spark, sf_dir)).select("o_orderkey", "function")


@query(
    "function_docs",
    """WITH n AS (SELECT DISTINCT concat('Supplier#', lpad(CAST(l_suppkey + 40 AS VARCHAR), 9, '0')) AS function FROM lineitem),
h AS (SELECT concat('Supplier#', lpad(CAST(l_suppkey + 40 AS VARCHAR), 9, '0')) AS function, count(DISTINCT l_linenumber) FILTER (l_linenumber <= 3) AS m FROM lineitem GROUP BY 1)
SELECT n.function, CASE WHEN s.s_name IS NOT NULL THEN 'spec' WHEN h.m > 0 THEN 'session' ELSE 'not_found' END AS doc_source,
  CAST((s.s_name IS NOT NULL)::INT + coalesce(h.m, 0) AS BIGINT) AS parts
FROM n LEFT JOIN supplier s ON s.s_name = n.function LEFT JOIN h ON h.function = n.function""",
)
def function_docs(spark, sf_dir):
    """Documentation of functions: specification first, session excerpts always added."""
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("l_suppkey") + 40).cast("string"), 9, "0")).alias("function")
    lines = table(spark, sf_dir, "lineitem")
    names = lines.select(name).distinct()
    returned = lines.select(name, F.col("l_linenumber").alias("rank")).distinct()
    hits = returned.withColumns({"source": F.lit("doc"), "page": F.col("rank"), "text": F.lit("extrait")})
    docs = dc.function_documentation(names, _specs(spark, sf_dir), hits)
    return docs.groupBy("function", "doc_source").agg(F.count("part").alias("parts"))


@query(
    "field_definitions",
    f"""WITH {CHUNKS_SQL},
q AS (SELECT conv_id * 1000 + turn AS query_id, CASE WHEN (conv_id + turn) % 3 = 0 THEN concat('Que dit Field 0', CAST(200 + (conv_id * 7 + turn) % 90 AS VARCHAR), ' ?') ELSE 'PAN' END AS query,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN CAST(200 + (conv_id * 7 + turn) % 90 AS VARCHAR) END AS n FROM conversations),
d AS (SELECT * FROM c WHERE type = 'field_definition'),
e AS (SELECT query_id, min(d.chunk_id) AS chunk_id FROM q JOIN d ON d.field_number = q.n GROUP BY 1),
s AS (SELECT query_id, (SELECT min(chunk_id) FROM d) AS chunk_id FROM q WHERE query_id NOT IN (SELECT query_id FROM e))
SELECT query_id, x.chunk_id, origin, d.field_number, d.field_name FROM (SELECT *, 'number' AS origin FROM e UNION ALL SELECT *, 'semantic' FROM s) x JOIN d USING (chunk_id)""",
)
def field_definitions(spark, sf_dir):
    """Field sections by number, else the nearest section."""
    kind = (F.col("conv_id") + F.col("turn")) % 3
    number = (F.lit(200) + (F.col("conv_id") * 7 + F.col("turn")) % 90).cast("string")
    queries = table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"),
        F.when(kind == 0, F.concat(F.lit("Que dit Field 0"), number, F.lit(" ?"))).otherwise("PAN").alias("query"),
    )
    sections = chunks(spark, sf_dir, "chunk_id", "type", "field_number", "field_name", "attributes", "source", "text")
    nearest = sections.filter("type = 'field_definition'").agg(F.min("chunk_id").alias("chunk_id")).withColumn("one", F.lit(1))
    semantic = queries.select("query_id", F.lit(1).alias("one")).join(small(nearest), "one").select(
        "query_id", "chunk_id", F.lit(1).alias("rank")
    )
    out = rt.field_definitions(queries, sections, semantic)
    return out.select("query_id", "chunk_id", "origin", "field_number", "field_name")


@query(
    "field_lookup_in_chunks",
    f"""WITH {CHUNKS_SQL},
w AS (SELECT DISTINCT session_id, CAST(200 + chunk_id % 80 AS VARCHAR) AS field_number FROM c),
x AS (SELECT chunk_id, session_id, concat('Field ', CAST(200 + chunk_id % 60 AS VARCHAR), ' ', text) AS text, field_name, attributes, source FROM c),
m AS (SELECT w.session_id, w.field_number, arg_min(x.field_name, x.chunk_id) AS fn, min(x.chunk_id) AS first_chunk,
    arg_min(CASE WHEN trim(attributes) <> '' THEN attributes ELSE coalesce(regexp_extract(x.text, '(\\d+)\\s+([ANSB]{{1,3}})\\b'), '') END, x.chunk_id) AS at
  FROM w JOIN x ON x.session_id = w.session_id AND contains(lower(x.text), concat('field ', w.field_number)) GROUP BY ALL)
SELECT session_id, field_number, first_chunk FROM m""",
)
def field_lookup_in_chunks(spark, sf_dir):
    """First chunk of its own session that names each field."""
    base = chunks(spark, sf_dir, "chunk_id", "session_id", "text")
    wanted = base.select("session_id", (F.lit(200) + F.col("chunk_id") % 80).cast("string").alias("field_number")).distinct()
    texts = base.withColumn("text", F.concat(F.lit("Field "), (F.lit(200) + F.col("chunk_id") % 60).cast("string"), F.lit(" "), "text"))
    terms = wanted.withColumn("term", F.concat(F.lit("Field "), "field_number"))
    hits = rt.keyword_search(texts, terms, 1, keys=("session_id", "field_number"))
    return hits.select("session_id", "field_number", F.col("chunk_id").alias("first_chunk"))


@query(
    "first_level",
    f"""WITH {CHUNKS_SQL},
h AS (SELECT concat('Q', CAST(chunk_id % 12 AS VARCHAR)) AS query_id, CASE WHEN lang = 'fr' AND chunk_id % 12 < 6 THEN 0 ELSE 1 END AS level, chunk_id, left(text, 120) AS head, page, source FROM c),
b AS (SELECT *, min(level) OVER (PARTITION BY query_id) AS best FROM h)
SELECT query_id, level, min(chunk_id) AS chunk_id FROM b WHERE level = best GROUP BY query_id, level, head, page, source""",
)
def first_level(spark, sf_dir):
    """Hits of the first level that found anything, near-identical ones once."""
    base = chunks(spark, sf_dir, "chunk_id", "lang", "text", "page", "source")
    twelfth = F.col("chunk_id") % 12
    hits = base.select(
        F.concat(F.lit("Q"), twelfth.cast("string")).alias("query_id"),
        F.when((F.col("lang") == "fr") & (twelfth < 6), 0).otherwise(1).alias("level"),
        F.col("chunk_id").alias("place"),
        "chunk_id",
        "text",
        "page",
        "source",
    )
    return rt.first_level(hits).select("query_id", "level", "chunk_id")


