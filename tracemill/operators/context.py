"""Deterministic context for a question: exact counts, budgeted blocks, fitted payloads, recent turns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import payload as pl
from tracemill.functions.text import occurrences
from tracemill.operators.containment import contains_join
from tracemill.operators.ordered import top_per_group
from tracemill.operators.scan import BLOCK, Running, block_scan, position_block, ranked


def term_hits(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """``file_id, block_no, term, occurrences`` for every block that contains a term (case-sensitive).

    ``terms``: ``term`` and optional ``file_id`` (only that file is asked).  Block 0 is
    the text before the first transaction.
    """
    found = contains_join(blocks, "text", terms.select("term").distinct(), "term")
    if "file_id" in terms.columns:
        found = found.join(terms.select("file_id", "term").distinct(), ["file_id", "term"], "left_semi")
    return found.select("file_id", "block_no", "term", occurrences("text", "term").alias("occurrences"))


def term_counts(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Exact occurrences of each term in each file and the number of transactions that contain it.

    The transactions themselves are the rows of :func:`term_hits`.
    """
    return (
        term_hits(blocks, terms)
        .groupBy("file_id", "term")
        .agg(F.sum("occurrences").alias("occurrences"), F.count_if(F.col("block_no") > 0).alias("transactions"))
    )


RELEVANT, ALERT, OTHER = 0, 1, 2


def block_class(text: Column, relevant_terms: Column, alert_words: Sequence[str] = fv.ALERT_WORDS) -> Column:
    """0 when a search term occurs (ignoring case), 1 when an alert word does, else 2."""
    up, low = F.upper(text), F.lower(text)
    alert = F.lit(False)
    for word in alert_words:
        alert = alert | F.contains(low, F.lit(word))
    relevant = F.exists(relevant_terms, lambda t: F.contains(up, t))
    return F.when(relevant, RELEVANT).when(alert, ALERT).otherwise(OTHER)


def select_blocks(
    blocks: DataFrame,
    budget: int = fv.CONTEXT_CHARS,
    header_chars: str | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Blocks that fit the character budget, taken in (class, number) order, never cut.

    ``blocks``: ``file_id, block_no, block_class, size``.  A block that does not fit is
    skipped and later, smaller ones may still fit; the very first is taken regardless.

    What is left of the budget only shrinks, so among blocks of one exact size those
    taken are the first ones, at most ``budget / size`` of them.  Ranking within
    (file, size) therefore leaves a candidate list whose length depends on the budget
    alone, and the sequential choice runs over that list.
    """
    cost = F.col("size") + fv.BLOCK_SEPARATOR_CHARS
    start = F.coalesce(F.col(header_chars) + fv.HEADER_ALLOWANCE, F.lit(0)) if header_chars else F.lit(0)
    costed = blocks.select("file_id", "block_no", "block_class", "size", cost.cast("bigint").alias("cost"), start.cast("bigint").alias("start"))
    place = ranked(
        costed.filter(F.col("cost") <= budget),
        ["file_id", "cost"],
        ["block_class", "block_no"],
        [F.col("block_class"), position_block("block_no", block)],
        "n",
    )
    likely = place.filter(F.col("n") * F.col("cost") <= budget).drop("n")
    first = costed.groupBy("file_id").agg(F.min(F.struct("block_class", "block_no", "size", "cost", "start")).alias("f"))
    first = first.select("file_id", "f.block_no", "f.block_class", "f.size", "f.cost", "f.start")
    candidates = likely.unionByName(first).dropDuplicates(["file_id", "block_no"])
    file_type = blocks.schema["file_id"].dataType.simpleString()

    def choose(key, pdf):
        pdf = pdf.sort_values(["block_class", "block_no"])
        used, taken = int(pdf["start"].iloc[0]), []
        for i, c in enumerate(pdf["cost"]):
            fits = used + c <= budget
            if fits or not taken:
                taken.append(i)
                used += int(c)
                if not fits:
                    break
        return pdf.iloc[taken][["file_id", "block_no", "block_class", "size"]]

    return candidates.groupBy("file_id").applyInPandas(
        choose, f"file_id {file_type}, block_no bigint, block_class int, size bigint"
    )


def inclusion_notice(blocks: DataFrame, selected: DataFrame, budget: int = fv.CONTEXT_CHARS) -> DataFrame:
    """Per file: blocks taken, blocks in all, and the sentence that says so."""
    total = blocks.groupBy("file_id").agg(F.count("*").alias("total"))
    taken = selected.groupBy("file_id").agg(F.count("*").alias("included"))
    both = total.join(taken, "file_id", "left").withColumn("included", F.coalesce("included", F.lit(0).cast("bigint")))
    part = F.format_string(
        f"[AVERTISSEMENT TRONCATURAGE DE CONTEXTE : %d/%d transactions complètes incluses (limite de {budget} caractères).]",
        "included",
        "total",
    )
    whole = F.format_string("[TRACE COMPLÈTE : %d/%d transactions incluses.]", "total", "total")
    return both.withColumn("notice", F.when(F.col("included") < F.col("total"), part).otherwise(whole))


def json_prefix(rows: DataFrame, keys: Sequence[str], order: Sequence[str], item: Column, cap: int, block: int = BLOCK) -> DataFrame:
    """Rows of each group that form the longest prefix whose JSON array stays within ``cap`` characters.

    An array of n items takes the items, ``", "`` between them and two brackets.  The
    first ``order`` column is a numeric position; further ones break ties.
    """
    sized = rows.withColumn("__size", (F.length(item) + 2).cast("bigint"))
    total = block_scan(sized, list(keys), list(order), position_block(order[0], block), [Running("json_chars", "sum", "__size")])
    return total.filter(F.col("json_chars") <= cap).drop("__size")


def fit_payload(df: DataFrame, parts: Sequence[str], max_tokens: int, model: str = "") -> DataFrame:
    """Text columns ``parts`` of each row fitted to a model's context.

    A row over 80 % of ``max_tokens`` has its longest part cut by the excess (JSON parts by
    their items, so that they stay JSON); a row where that would destroy the part is marked ``skipped``.  Adds ``estimated_tokens``.
    """
    tokens = lambda: sum((F.when(F.col(p).isNull(), 0).otherwise(pl.token_estimate(p, 1)) for p in parts), F.lit(0))
    limit = int(max_tokens * fv.SAFE_SHARE)
    longest = F.greatest(*[F.coalesce(F.length(p), F.lit(0)) for p in parts]) if len(parts) > 1 else F.length(parts[0])
    work = df.withColumn("__t", tokens()).withColumn("__len", longest)
    excess = (F.col("__t") - limit) * fv.CHARS_PER_TOKEN
    over, can_cut = F.col("__t") > limit, F.col("__len") > excess + fv.MIN_CUT
    target = F.greatest(F.lit(fv.MIN_CUT), F.col("__len") - excess - fv.CUT_MARGIN).cast("int")
    work = work.withColumns({"skipped": over & ~can_cut, "__cut": F.when(over & can_cut, target)})
    not_yet = F.lit(True)
    cut = {}
    for p in parts:
        is_longest = F.coalesce(F.length(p), F.lit(0)) == F.col("__len")
        cut[p] = F.when(F.col("__cut").isNotNull() & not_yet & is_longest, pl.cut_part(p, F.col("__cut"), model)).otherwise(F.col(p))
        not_yet = not_yet & ~is_longest
    return work.withColumns(cut).withColumn("estimated_tokens", tokens()).drop("__t", "__len", "__cut")


def last_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """Last ``n`` turns of each conversation in order (``recency`` 1 is the newest)."""
    return top_per_group(turns, ["conv_id"], [F.desc("turn")], n, "recency")


def questions_in_context(turns: DataFrame, before: int = 2) -> DataFrame:
    """Each user turn with the ``before`` turns in front of it joined to one search text.

    Every turn also reports itself to the next ``before`` positions, so each question
    meets its context in a group of at most ``before + 1`` rows.  ``turn`` counts from 0 without gaps.
    """
    places = F.transform(F.sequence(F.lit(0), F.lit(before)), lambda d: F.struct((F.col("turn") + d).alias("at"), (-d).alias("back")))
    told = turns.filter(F.length("text") > 0).select("conv_id", "role", "text", F.explode(places).alias("p"))
    met = told.groupBy("conv_id", F.col("p.at").alias("turn")).agg(
        F.max(F.when(F.col("p.back") == 0, F.col("role"))).alias("role"),
        F.max(F.when(F.col("p.back") == 0, F.col("text"))).alias("question"),
        F.array_sort(F.collect_list(F.struct(F.col("p.back").alias("back"), F.col("text").alias("text")))).alias("__parts"),
    )
    joined = F.array_join(F.transform("__parts", lambda x: x["text"]), " ")
    return met.filter("role = 'user'").select("conv_id", "turn", "question", joined.alias("search_text"))


def token_diagnostics(parts: DataFrame) -> DataFrame:
    """Estimated prompt tokens per component (``component, text``)."""
    return parts.groupBy("component").agg(F.sum(pl.token_estimate("text")).alias("tokens"))


def rank_positions(df: DataFrame, keys: Sequence[str], position: str, out: str, block: int = BLOCK) -> DataFrame:
    """0-based gapless position in each group, for inputs whose positions have gaps."""
    numbered = ranked(df, list(keys), [position], position_block(position, block), out)
    return numbered.withColumn(out, F.col(out) - 1)


