"""Documentation of functions and security-module codes: cascades from the best source down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import hsm
from tracemill.functions.text import strip
from tracemill.operators.containment import contains_join
from tracemill.operators.ordered import top_per_group
from tracemill.operators.retrieval import command_lookup, first_level, spec_score_topk
from tracemill.session import small, stage

SPEC_SOURCE = "spécification des fonctions"


def parse_hsm_codes(raw: DataFrame, resolved: DataFrame, text: str = "raw") -> DataFrame:
    """Normalise free texts to ``lookup_key, command_code, response_code, error_number, display``.

    ``resolved`` has one row per known two-letter code (a fixed-size table).
    """
    parts = hsm.split_token("__token")
    staged = raw.withColumn("__token", hsm.raw_token(text)).withColumns(parts)
    # The response part is read as a response first, then as a command.
    pairs = resolved.select("code", "target_command", "target_response", "is_command")
    inverse = pairs.groupBy(F.col("target_response").alias("__resp")).agg(F.max("target_command").alias("__by_response"))
    forward = pairs.filter("is_command").select(F.col("code").alias("__cmd"), F.col("target_response").alias("__by_command"))
    code = F.coalesce("response_code", "lookup_key")
    joined = (
        staged.withColumn("__code", code)
        .join(small(inverse), F.col("__code") == F.col("__resp"), "left")
        .join(small(forward), F.col("__code") == F.col("__cmd"), "left")
    )
    as_response, as_command = F.col("__by_response").isNotNull(), F.col("__by_command").isNotNull()
    command = F.when(as_response, F.col("__by_response")).when(as_command, F.col("__code"))
    response = F.when(as_response, F.col("__code")).when(as_command, F.col("__by_command")).otherwise(F.col("response_code"))
    out = joined.withColumns({"command_code": command, "response_code": response})
    shown = hsm.display("lookup_key", "command_code", "response_code", "error_number")
    return out.withColumns(
        {"lookup_key": F.coalesce("lookup_key", F.lit("")), "display": F.coalesce(shown, F.col("lookup_key"), F.lit(""))}
    ).drop("__token", "__code", "__resp", "__cmd", "__by_response", "__by_command")


def codes_in_texts(texts: DataFrame, resolved: DataFrame, text: str = "text") -> DataFrame:
    """Code found in each text that is about the security module at all."""
    return parse_hsm_codes(texts.filter(hsm.mentions_code(text)), resolved, text).filter("lookup_key != ''")


def dictionary_entries(parsed: DataFrame, errors: DataFrame, key: str = "query_id") -> DataFrame:
    """First dictionary entry under the keys of a parsed code, most specific key first.

    Each key is tried as it is, in upper case and without leading zeros.
    """
    pair = F.concat(F.coalesce("response_code", F.lit("")), F.coalesce("error_number", F.lit("")))
    keys = [F.col("lookup_key"), F.col("display"), pair, F.col("error_number"), F.col("response_code"), F.col("command_code")]
    tried = F.flatten(F.array(*[F.array(k, F.upper(k), F.ltrim(k, F.lit("0"))) for k in keys]))
    probes = parsed.select(key, F.posexplode(tried).alias("pos", "code")).filter(F.col("code").isNotNull() & (F.col("code") != ""))
    found = probes.join(errors, "code")
    rest = F.struct(*errors.columns)
    best = found.groupBy(key).agg(F.min_by(rest, "pos").alias("e"))
    return best.select(key, *[F.col(f"e.{c}").alias("entry_code" if c == "code" else c) for c in errors.columns])


def page_hits(parsed: DataFrame, pages: DataFrame, n: int = 4, key: str = "query_id") -> DataFrame:
    """Best ``n`` pages that contain any part of a code, by score then page."""
    pair = F.concat(F.coalesce("response_code", F.lit("")), F.coalesce("error_number", F.lit("")))
    parts = F.array_distinct(F.array_compact(F.array("lookup_key", "error_number", "response_code", "command_code", pair)))
    asked = parsed.select(key, "command_code", "response_code", "error_number", F.explode(parts).alias("needle")).filter("needle != ''")
    found = contains_join(pages.filter(strip("text") != ""), "text", asked, "needle", ignore_case=True)
    scored = found.withColumn("score", hsm.page_score("text", "command_code", "response_code", "error_number"))
    once = scored.dropDuplicates([key, "source", "page"])
    best = top_per_group(once, [key], [F.desc("score"), F.col("page"), F.col("source")], n)
    return best.select(key, "rank", "source", "page", "score", "command_code", "response_code", F.left(strip("text"), F.lit(2500)).alias("content"))


def best_excerpts(excerpts: DataFrame, n: int = 2, key: str = "query_id", min_score: float = fv.EXCERPT_MIN_SCORE) -> DataFrame:
    """Cleaned excerpts scored against ``command_code`` / ``response_code``; weak ones left out, best ``n`` kept.

    The excerpt's own codes are ``meta_command`` and ``meta_response``; ``place`` breaks ties.
    """
    clean = excerpts.withColumn("content", hsm.without_page_artifacts("content"))
    scored = clean.withColumn(
        "score", hsm.excerpt_score("content", "meta_command", "meta_response", "command_code", "response_code")
    )
    return top_per_group(scored.filter(F.col("score") >= min_score), [key], [F.desc("score"), F.col("place")], n)


def label(source: Column, page: Column) -> Column:
    shown = F.concat(source, F.lit(" (p. "), page.cast("string"), F.lit(")"))
    return F.when(page.isNotNull(), shown).otherwise(source)


def excerpt_text(number: Column, source: Column, page: Column, function: Column, content: Column, cap: int = 2500) -> Column:
    """Excerpt block: label line with source, page and function, then the content."""
    head = F.concat(
        F.format_string("--- Extrait %d (Source: %s", number, F.coalesce(source, F.lit("Inconnu"))),
        F.coalesce(F.concat(F.lit(", Page: "), page.cast("string")), F.lit("")),
        F.coalesce(F.concat(F.lit(", Fonction: "), function), F.lit("")),
        F.lit(") ---\n"),
    )
    return F.concat(head, F.left(strip(content), F.lit(cap)))


def hsm_documentation(codes: DataFrame, chunks: DataFrame, pages: DataFrame, errors: DataFrame, resolved: DataFrame, n: int = 5) -> DataFrame:
    """Documentation rows of each code: ``query_id, origin, rank, label, content`` and the parsed code.

    ``codes``: ``query_id, raw`` and optional ``session_id``.  Session chunks come first,
    then chunks of any session, then pages (only for codes without any chunk); the
    dictionary entry is always added.
    """
    has_session = "session_id" in codes.columns
    parsed = stage(parse_hsm_codes(codes, resolved).filter("lookup_key != ''"), "codes")
    lookup_letters = F.when(F.rlike("lookup_key", F.lit("^[A-Z]{2}")), F.left("lookup_key", F.lit(2))).otherwise(F.col("lookup_key"))
    tokens = F.array_distinct(F.array_compact(F.array("response_code", "command_code", lookup_letters)))
    usual = F.array(*[F.lit(c) for c in fv.NUMBER_ONLY_RESPONSES])
    tokens = F.when(F.col("error_number").isNotNull() & F.col("response_code").isNull(), F.array_union(tokens, usual)).otherwise(tokens)
    anywhere = F.struct(F.lit(1).alias("level"), F.lit(None).cast("string").alias("scope"))
    mine = F.struct(F.lit(0).alias("level"), strip("session_id").alias("scope")) if has_session else anywhere
    asked = (
        parsed.select("query_id", F.posexplode(tokens).alias("token_no", "code"), *(["session_id"] if has_session else []))
        .withColumn("s", F.explode(F.array_distinct(F.array(mine, anywhere))))
        .filter((F.col("s.level") == 1) | (F.col("s.scope") != ""))
    )
    named = asked.select(
        F.struct("query_id", "token_no", F.col("s.level").alias("level")).alias("query_id"), "code", F.col("s.scope").alias("session_id")
    )
    hits = command_lookup(named, chunks, resolved, limit=6)
    found = hits.select(
        F.col("query_id.query_id").alias("query_id"),
        F.struct(F.col("query_id.token_no").alias("token_no"), F.col("rank").alias("rank")).alias("place"),
        "chunk_id",
        F.col("query_id.level").alias("level"),
    )
    texts = chunks.select(
        "chunk_id", "text", "source", "page", F.col("command_code").alias("meta_command"), F.col("response_code").alias("meta_response")
    )
    numbers = parsed.select("query_id", "error_number", "command_code", "response_code", "display")
    read = found.join(texts, "chunk_id").join(numbers, "query_id").filter(hsm.names_error("text", "error_number"))
    shown = stage(top_per_group(first_level(read), ["query_id"], [F.col("place"), F.col("chunk_id")], n), "excerpts")
    from_chunks = shown.select(
        "query_id",
        F.when(F.col("level") == 0, "rag_session").otherwise("rag").alias("origin"),
        "rank",
        label(F.coalesce("source", F.lit("Référentiel HSM")), F.col("page")).alias("label"),
        F.left(strip("text"), F.lit(2500)).alias("content"),
    )
    missed = parsed.join(from_chunks.select("query_id").distinct(), "query_id", "left_anti")
    from_pages = page_hits(missed, pages).select(
        "query_id", F.lit("page").alias("origin"), "rank", label(F.col("source"), F.col("page")).alias("label"), "content"
    )
    from_errors = dictionary_entries(parsed, errors).select(
        "query_id",
        F.lit("dictionary").alias("origin"),
        F.lit(1).alias("rank"),
        F.col("source").alias("label"),
        F.concat_ws("\n", "title", "description", "meaning", "diagnostic_hint").alias("content"),
    )
    rows = from_chunks.unionByName(from_pages).unionByName(from_errors)
    return rows.join(parsed.select("query_id", "lookup_key", "display", "command_code", "response_code", "error_number"), "query_id")


def spec_block(function: str = "function") -> Column:
    """Text block of one function-spec row."""
    return F.format_string(
        "### Fonction %s (source: %s, path: %s)\nDescription : %s\nCodes retour / Exceptions :\n%s",
        F.col(function),
        F.col("source"),
        F.col("path"),
        F.col("description"),
        F.col("exception"),
    )


def specs_for_functions(names: DataFrame, specs: DataFrame) -> DataFrame:
    """Spec rows of named functions, with their text block."""
    return names.join(specs, "function").withColumn("block", spec_block())


def specs_in_alerts(alerts: DataFrame, specs: DataFrame, text: str = "alert") -> DataFrame:
    """Spec rows whose function is named anywhere in an alert text, ignoring case."""
    return contains_join(alerts, text, specs, "function", ignore_case=True).withColumn("block", spec_block())


def function_documentation(names: DataFrame, specs: DataFrame, session_hits: DataFrame) -> DataFrame:
    """Documentation parts of each function: ``function, doc_source, part, label, content``.

    A documented function is described by its spec row (or by the best keyword matches
    when that row says nothing); session excerpts (``function, rank, source, page, text``,
    at most three used) are always added.  ``doc_source`` names the best level that answered.
    """
    asked = names.select("function").distinct()
    spec_rows = specs_for_functions(asked, specs)
    said = F.concat_ws("", "source", "path", "description", "exception") != ""
    from_spec = spec_rows.filter(said).select(
        "function", F.lit(0).alias("level"), F.lit(1).alias("part"), F.lit(SPEC_SOURCE).alias("label"), F.col("block").alias("content")
    )
    silent = spec_rows.filter(~said).select(F.col("function").alias("query_id"), F.col("function").alias("query"))
    by_words = spec_score_topk(silent, specs, 3).select(
        F.col("query_id").alias("function"), F.lit(0).alias("level"), F.col("rank").alias("part"), F.lit(SPEC_SOURCE).alias("label"), spec_block().alias("content")
    )
    from_session = session_hits.filter("rank <= 3").join(asked, "function", "left_semi").select(
        "function",
        F.lit(1).alias("level"),
        F.col("rank").alias("part"),
        label(F.coalesce("source", F.lit(fv.SESSION_SOURCE)), F.col("page")).alias("label"),
        F.left(strip("text"), F.lit(600)).alias("content"),
    )
    parts = from_spec.unionByName(by_words).unionByName(from_session)
    best = parts.groupBy("function").agg(F.min("level").alias("best"))
    status = asked.join(best, "function", "left").select(
        "function", F.when(F.col("best") == 0, "spec").when(F.col("best") == 1, "session").otherwise("not_found").alias("doc_source")
    )
    return status.join(parts.select("function", "part", "label", "content"), "function", "left")
