"""Finding chunks: by keyword, vector, command code, field number and function words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import chunk_text as ct
from tracemill.functions import questions as qs
from tracemill.functions.text import strip
from tracemill.operators.containment import contained, contains_join, literal_array, needle_lists
from tracemill.operators.ordered import top_per_group
from tracemill.session import bounded_rows, small, stage

#: Query vectors up to this many travel to every task; more are joined block by block.
TASK_QUERIES = 4096
BLOCK_CHUNKS = 100_000
#: Codes asked for up to this many are cut out of the texts' words by one literal.
LITERAL_TOKENS = 2000


def keyword_search(chunks: DataFrame, terms: DataFrame, limit: int = 5, keys: Sequence[str] = ("term",)) -> DataFrame:
    """First ``limit`` chunks (by id) whose text contains each term, ignoring case.

    ``terms`` may carry ``session_id``; then only that session's chunks count.
    """
    hits = contains_join(chunks, "text", terms.select("term").distinct(), "term", ignore_case=True)
    on = ["term"] + [c for c in ("session_id",) if c in terms.columns]
    # Nothing beyond the first hits of a term can be used, so they are cut before anything is joined.
    first = top_per_group(hits, on, [F.col("chunk_id")], limit, "__n").drop("__n")
    return top_per_group(first.join(small(terms), on), list(keys), [F.col("chunk_id")], limit)


# --- vectors -----------------------------------------------------------------


def _unit(vectors: Sequence) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norm == 0, 1.0, norm)


def _best(sims: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` most similar, ties by id; ``-inf`` never counts."""
    live = np.flatnonzero(np.isfinite(sims))
    if len(live) > k:
        cut = np.partition(sims[live], len(live) - k)[len(live) - k]
        live = live[sims[live] >= cut]
    return live[np.lexsort((ids[live], -sims[live]))][:k]


def _local_topk(q: pd.DataFrame, batches: Iterator[pd.DataFrame], k: int, match: Sequence[str]) -> pd.DataFrame:
    """Top ``k`` of the given chunk batches for every query row; keeps only ``k`` per query between batches."""
    parts = []
    qv, qm = _unit(q["vector"]), [q[f"__q_{c}"].to_numpy() for c in match]
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for pdf in batches:
        if pdf.empty:
            continue
        cv, ids = _unit(pdf["embedding"]), pdf["chunk_id"].to_numpy()
        for lo in range(0, len(q), 256):
            sims = qv[lo : lo + 256] @ cv.T
            for c, wanted in zip(match, qm):
                want = wanted[lo : lo + 256, None]
                has = pdf[c].to_numpy()[None, :]
                sims = np.where(pd.isnull(want) | (want == has), sims, -np.inf)
            for i in range(sims.shape[0]):
                pick = _best(sims[i], ids, k)
                s, d = sims[i][pick], ids[pick]
                if lo + i in held:
                    s, d = np.concatenate([held[lo + i][0], s]), np.concatenate([held[lo + i][1], d])
                    again = _best(s, d, k)
                    s, d = s[again], d[again]
                held[lo + i] = (s, d)
    for i, (s, d) in held.items():
        parts.append(pd.DataFrame({"query_id": q["query_id"].iloc[i], "chunk_id": d, "similarity": s}))
    return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "chunk_id": [], "similarity": []})


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int, match: Sequence[str] = (), max_k: int | None = None) -> DataFrame:
    """The ``k`` chunks most similar (cosine) to each query: ``query_id, chunk_id, similarity, rank``.

    ``queries``: ``query_id, vector`` plus the ``match`` columns that must agree with
    the chunk (null matches any).  Every task keeps only its own best ``k`` per query,
    so the shuffle carries ``k`` rows per task and query, never all pairs.
    """
    k = min(k, max_k) if max_k else k
    match = list(match)
    asked = queries.select("query_id", "vector", *[F.col(c).alias(f"__q_{c}") for c in match])
    stored = chunks.select("chunk_id", "embedding", *match).filter(F.col("embedding").isNotNull())
    qid, cid = queries.schema["query_id"].dataType.simpleString(), chunks.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {qid}, chunk_id {cid}, similarity double"
    rows = bounded_rows(asked, TASK_QUERIES)
    if rows is not None:
        table = pd.DataFrame([r.asDict() for r in rows], columns=asked.columns)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if len(table):
                yield _local_topk(table, batches, k, match)

        near = stored.mapInPandas(scan, schema)
    else:
        nq = -(-queries.count() // TASK_QUERIES)
        nc = -(-chunks.count() // BLOCK_CHUNKS)
        side = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        q = asked.withColumn("__qb", side("query_id", nq)).withColumn("__cb", every(nc))
        c = stored.withColumn("__cb", side("chunk_id", nc)).withColumn("__qb", every(nq))

        def meet(qpdf: pd.DataFrame, cpdf: pd.DataFrame) -> pd.DataFrame:
            return _local_topk(qpdf.reset_index(drop=True), iter([cpdf]), k, match)

        near = q.groupBy("__qb", "__cb").cogroup(c.groupBy("__qb", "__cb")).applyInPandas(meet, schema)
    return top_per_group(near, ["query_id"], [F.desc("similarity"), F.col("chunk_id")], k)


# --- function specifications -------------------------------------------------


def _word_points(specs: DataFrame, words: DataFrame) -> DataFrame:
    """Specs with ``__points``: of each asked word found in them, its points; and a row number ``__spec``."""
    lists = needle_lists(words)
    fields = [("function", fv.SPEC_NAME_POINTS), ("description", fv.SPEC_DESCRIPTION_POINTS), ("exception", fv.SPEC_EXCEPTION_POINTS)]
    found = {f"__{c}": F.coalesce(contained(F.lower(c), lists), F.array().cast("array<string>")) for c, _ in fields}

    def points(w: Column) -> Column:
        return sum((F.when(F.array_contains(f"__{c}", w), n).otherwise(0) for c, n in fields), F.lit(0))

    hits = F.array_distinct(F.concat(*found))
    return specs.withColumns(found).select(
        *specs.columns,
        F.monotonically_increasing_id().alias("__spec"),
        F.map_from_entries(F.transform(hits, lambda w: F.struct(w, points(w)))).alias("__points"),
    )


def spec_score_topk(queries: DataFrame, specs: DataFrame, k: int = 4) -> DataFrame:
    """Best function specs per query text: ``query_id, score, rank`` and the spec columns; ``query_id`` is unique.

    Points per query word found in name, description and exception, more when the whole name is in the query.  Specs are
    indexed by the words asked for.  A query's words are ordered from rare to common; the common ones that cannot give the
    least score together bring no candidates, and a pair is built once, at its rarest word, if its bound reaches that score.
    """
    asked = queries.select("query_id", F.lower("query").alias("q"), F.explode(qs.spec_keywords("query")).alias("w"))
    asked = asked.groupBy("query_id", "q", "w").agg(F.count("*").cast("int").alias("m"))
    indexed = stage(_word_points(specs, asked.select("w").distinct()), "specs")
    postings = indexed.select("__spec", "spec_no", "function", "__points", F.explode("__points").alias("w", "points"))
    bounds = postings.groupBy("w").agg(F.count("*").alias("specs"), F.max("points").alias("most"))
    ordered = asked.join(small(bounds), "w").groupBy("query_id", "q").agg(
        F.array_sort(F.collect_list(F.struct("specs", "w", "m", (F.col("m") * F.col("most")).alias("bound")))).alias("ws")
    )

    def total(words: Column, of) -> Column:
        return F.aggregate(words, F.lit(0), lambda acc, x: acc + of(x))

    rest = total(F.slice("ws", F.col("i") + 2, F.size("ws")), lambda x: x["bound"])
    words = ordered.select("query_id", "q", "ws", F.posexplode("ws").alias("i", "x")).withColumn("rest", rest)
    leads = words.filter(F.col("x.bound") + F.col("rest") >= fv.SPEC_MIN_SCORE).select(
        "query_id", "q", "ws", "rest", F.col("x.w").alias("w"), F.col("x.m").alias("m"), F.transform(F.slice("ws", 1, F.col("i")), lambda x: x["w"]).alias("before")
    )
    score = total(F.col("ws"), lambda x: x["m"] * F.coalesce(F.col("__points")[x["w"]], F.lit(0)))
    name = F.lower("function")
    by_word = (
        postings.join(small(leads), "w")
        .filter(F.col("m") * F.col("points") + F.col("rest") >= fv.SPEC_MIN_SCORE)
        .filter(~F.arrays_overlap("before", F.map_keys("__points")) & ~F.coalesce(F.contains("q", name), F.lit(False)))
        .select("query_id", "__spec", "spec_no", "function", score.alias("score"))
        .filter(F.col("score") >= fv.SPEC_MIN_SCORE)
    )
    names = indexed.select("__spec", "spec_no", "function", "__points", name.alias("name"))
    texts = queries.select("query_id", F.lower("query").alias("q")).filter("q IS NOT NULL").distinct()
    held = F.array_append(contained(F.col("q"), needle_lists(names.filter("name <> ''").select("name").distinct())), F.lit(""))
    whole = texts.select("query_id", "q", F.explode(held).alias("name")).join(ordered, ["query_id", "q"], "left").drop("q")
    by_name = names.join(small(whole), "name").select(
        "query_id", "__spec", "spec_no", "function", (F.coalesce(score, F.lit(0)) + fv.SPEC_WHOLE_NAME_POINTS).alias("score")
    )
    best = top_per_group(by_word.unionByName(by_name), ["query_id"], [F.desc("score"), F.col("spec_no"), F.col("function")], k)
    return best.drop("spec_no", "function").join(indexed.drop("__points"), "__spec").select("query_id", "score", *specs.columns, "rank")


def accept_hits(queries: DataFrame, hits: DataFrame, specs: DataFrame, k: int = 8) -> DataFrame:
    """Vector hits of a query when one of them is about a function the query names, else keyword-scored specs.

    ``queries``: ``query_id, query``; ``hits``: ``query_id, rank, function`` (at most k per query).
    """
    words = queries.select("query_id", F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit(r"(?U)\w+"), F.lit(0))).alias("words"))
    func = F.lower(strip("function"))
    named = hits.join(words, "query_id").withColumn(
        "about", (func != "") & F.exists("words", lambda w: F.contains(func, w))
    )
    accepted = named.filter("about").select("query_id").distinct()
    kept = hits.join(accepted, "query_id", "left_semi").select("query_id", "function", "rank", F.lit("vector").alias("origin"))
    missed = queries.join(accepted, "query_id", "left_anti")
    scored = spec_score_topk(missed, specs, k).select("query_id", "function", "rank", F.lit("keyword").alias("origin"))
    return kept.unionByName(scored)


# --- command codes -----------------------------------------------------------


def command_lookup(codes: DataFrame, chunks: DataFrame, resolved: DataFrame, limit: int = 8, loose: bool = False) -> DataFrame:
    """Chunks that document a code, read as a command or as a response.

    ``codes``: ``query_id, code`` and optional ``session_id``, ``file_hash`` (null: anywhere).
    ``resolved``: :func:`~tracemill.sources.refdata.resolve_codes`.  Rank classes: 1 the
    chunk's own codes, 2 error tables, 3 the code as a word of the text (``loose``: as
    any part of the text); 4 the other code of the pair, only when nothing else was
    found.  Every match is an equi-join on (scope, token).
    """
    optional = {c: F.col(c) if c in codes.columns else F.lit(None).cast("string") for c in ("session_id", "file_hash")}
    scopes = F.array_compact(
        F.array(F.concat(F.lit("S:"), optional["session_id"]), F.concat(F.lit("H:"), optional["file_hash"]))
    )
    asked = (
        codes.withColumn("code", F.upper(strip("code")))
        .filter(F.col("code") != "")
        .withColumn("__scopes", F.when(optional["session_id"].isNull(), F.array(F.lit("*"))).otherwise(scopes))
        .join(resolved.select("code", "target_command", "target_response"), "code", "left")
        .withColumns(
            {
                "target_command": F.coalesce("target_command", "code"),
                "target_response": F.coalesce("target_response", "code"),
            }
        )
        .select("query_id", "code", "target_command", "target_response", F.explode("__scopes").alias("scope"))
    )
    asked = stage(asked, "asked")
    # What the chunks offer: (scope, token, class).  Only codes someone asked about leave the scan.
    own = F.array_distinct(F.array_compact(F.array("command_code", "response_code")))
    pair = asked.select(F.explode(F.array("target_command", "target_response")).alias("token")).distinct()
    where = F.array_compact(
        F.array(F.lit("*"), F.concat(F.lit("S:"), "session_id"), F.concat(F.lit("H:"), "file_hash"))
    )
    base = chunks.withColumn("__where", where)
    few = bounded_rows(pair, LITERAL_TOKENS)
    narrow = (lambda a: F.array_intersect(a, literal_array([r[0] for r in few]))) if few is not None else (lambda a: a)
    by_meta = base.select("chunk_id", "__where", F.explode(narrow(own)).alias("token"), F.lit(1).alias("class"))
    if loose:
        words = contains_join(base.select("chunk_id", "__where", "text"), "text", pair, "token", ignore_case=True)
        by_word = words.select("chunk_id", "__where", "token", F.lit(3).alias("class"))
    else:
        by_word = base.select("chunk_id", "__where", F.explode(narrow(ct.word_tokens("text"))).alias("token"), F.lit(3).alias("class"))
    offered = (
        by_meta.unionByName(by_word)
        .join(pair, "token", "left_semi")
        .select("chunk_id", "token", "class", F.explode("__where").alias("scope"))
    )
    # Whatever ranks behind ``limit`` chunks of its own scope, token and class ranks behind them for every query.
    offered = top_per_group(offered.distinct(), ["scope", "token", "class"], [F.col("chunk_id")], limit, "__n").drop("__n")
    wanted = asked.select(
        "query_id",
        "scope",
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("target_command").alias("token"), (F.col("target_command") == F.col("code")).alias("asked")),
                    F.struct(F.col("target_response").alias("token"), (F.col("target_response") == F.col("code")).alias("asked")),
                )
            )
        ).alias("t"),
    ).select("query_id", "scope", "t.token", "t.asked")
    token_hits = offered.join(wanted, ["scope", "token"]).select(
        "query_id", "chunk_id", F.when((F.col("class") == 3) & ~F.col("asked"), 4).otherwise(F.col("class")).alias("class")
    )
    # Error tables answer every code; a query never needs more than the first ``limit`` of its scope.
    tables = base.filter(F.col("contains_error_table") | F.contains(F.lower("text"), F.lit(fv.PARITY_ERROR)))
    tables = top_per_group(
        tables.select("chunk_id", F.explode("__where").alias("scope")), ["scope"], [F.col("chunk_id")], limit, "__n"
    )
    table_hits = tables.join(asked.select("query_id", "scope").distinct(), "scope").select(
        "query_id", "chunk_id", F.lit(2).alias("class")
    )
    best = token_hits.unionByName(table_hits).groupBy("query_id", "chunk_id").agg(F.min("class").alias("class"))
    first_class = best.groupBy("query_id").agg(F.min("class").alias("__first"))
    usable = best.join(first_class, "query_id").filter((F.col("class") < 4) | (F.col("__first") == 4)).drop("__first")
    ranked = top_per_group(usable, ["query_id"], [F.col("class"), F.col("chunk_id")], limit)
    targets = asked.select("query_id", "code", "target_command", "target_response").distinct()
    return ranked.join(targets, "query_id")


def annotate_pair(hits: DataFrame, text: str = "text") -> DataFrame:
    """Put the command / response correspondence in front of a hit's text, unless it already states it."""
    differs = F.col("target_command") != F.col("target_response")
    stated = F.contains(F.col(text), F.concat(F.lit("Code Commande: "), "target_command"))
    head = F.format_string(fv.MSG_CODE_PAIR, F.col("target_command"), F.col("target_response"))
    return hits.withColumn(text, F.when(differs & ~stated, F.concat(head, F.col(text))).otherwise(F.col(text)))


def spec_snippets(hits: DataFrame, n: int = 4) -> DataFrame:
    """First ``n`` distinct snippets per question from command hits (``question_id, code_no, rank, text`` and targets)."""
    differs = F.col("target_command") != F.col("target_response")
    head = F.when(differs, F.format_string("[Code Commande '%s' ↔ Code Réponse '%s'] ", "target_command", "target_response")).otherwise("")
    clean = hits.withColumn("__t", strip("text")).filter(F.col("__t") != "")
    first = clean.groupBy("question_id", "__t").agg(
        F.min_by(F.concat(head, F.col("__t")), F.struct("code_no", "rank")).alias("snippet"),
        F.min(F.struct("code_no", "rank")).alias("place"),
    )
    return top_per_group(first, ["question_id"], [F.col("place")], n).select("question_id", "rank", "snippet")


# --- field definitions -------------------------------------------------------


def field_definitions(queries: DataFrame, sections: DataFrame, semantic: DataFrame) -> DataFrame:
    """Field section for each query: by the number it mentions, else its nearest section.

    ``queries``: ``query_id, query``; ``sections``: ``chunk_id, type, field_number, …``;
    ``semantic``: ``query_id, chunk_id, rank`` restricted to field definitions.
    """
    numbered = sections.filter("type = 'field_definition'")
    by_number = numbered.groupBy("field_number").agg(F.min("chunk_id").alias("chunk_id"))
    asked = queries.select("query_id", qs.first_field_number("query").alias("field_number"))
    exact = asked.join(by_number, "field_number").select("query_id", "chunk_id", F.lit("number").alias("origin"))
    near = (
        semantic.filter("rank = 1")
        .join(exact, "query_id", "left_anti")
        .select("query_id", "chunk_id", F.lit("semantic").alias("origin"))
    )
    wanted = exact.unionByName(near)
    return wanted.join(numbered.select("chunk_id", "field_number", "field_name", "attributes", "source", "text"), "chunk_id")


# --- combining hits ----------------------------------------------------------


def hybrid_union(keyword: DataFrame, semantic: DataFrame, n: int = fv.MERGED_CHUNKS) -> DataFrame:
    """Keyword hits, then semantic hits, distinct by text: ``query_id, chunk_id, text, rank`` in and out."""
    both = keyword.select("query_id", "chunk_id", "text", F.lit(0).alias("source"), "rank").unionByName(
        semantic.select("query_id", "chunk_id", "text", F.lit(1).alias("source"), "rank")
    )
    place = F.struct("source", "rank", "chunk_id")
    unique = both.groupBy("query_id", strip("text").alias("text")).agg(F.min(place).alias("p"))
    out = top_per_group(unique, ["query_id"], [F.col("p")], n)
    return out.select("query_id", "rank", F.col("p.chunk_id").alias("chunk_id"), F.col("p.source").alias("source"), "text")


def first_level(hits: DataFrame, key: str = "query_id", identity: Sequence[Column] | None = None, order: Sequence[str] = ("place", "chunk_id")) -> DataFrame:
    """Hits of the first level (lowest ``level``) that found anything, distinct by head of text, page and source."""
    lowest = hits.groupBy(key).agg(F.min("level").alias("__level"))
    kept = hits.join(lowest, key).filter("level = __level").drop("__level")
    same = identity or [F.left("text", F.lit(120)).alias("__head"), F.col("page"), F.col("source")]
    rest = [c for c in hits.columns if c != key]
    first = kept.groupBy(F.col(key), *same).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__h"))
    return first.select(key, "__h.*")


def limit_per(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return top_per_group(df, list(keys), [F.col(c) for c in order], n)


