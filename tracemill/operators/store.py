"""Conversations, session files and usage entries as tables with latest-per-key semantics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import chunk_text as ct
from tracemill.functions import payload as pl
from tracemill.operators.ordered import latest_per_key, top_per_group
from tracemill.operators.scan import Running, block_scan, position_block, ranked


def upsert(old: DataFrame, new: DataFrame, key: str = "id", activity: str = "updated_at", created: str = "created_at") -> DataFrame:
    """Old and new versions folded to the latest per key; the first creation time is kept.

    At equal activity the new version wins, among several new ones the one with the larger hash.
    """
    marked = lambda df, is_new: df.withColumn("__new", F.lit(is_new))
    both = marked(old, False).unionByName(marked(new, True), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "__new"]
    rest = [c for c in columns if c not in (key, created)]
    order = F.struct(activity, "__new", F.xxhash64(*rest).alias("__tie"))
    folded = both.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r"), F.min(created).alias(created))
    return folded.select(key, created, "__r.*").select(*columns)


def patch(old: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Columns of ``changes`` (one row per key) replace old values; null keeps the old value, unknown keys are ignored."""
    fields = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__n_{c}") for c in fields])
    joined = old.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"__n_{c}", c) for c in fields}).select(*old.columns)


def delete_keys(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return df.join(keys.select(key).distinct(), key, "left_anti")


def delete_outcome(df: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Per requested key, whether there was anything to delete."""
    asked = keys.select(key).distinct()
    present = df.select(key).distinct().withColumn("deleted", F.lit(True))
    return asked.join(present, key, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


def get_rows(df: DataFrame, keys: Sequence, key: str = "id") -> DataFrame:
    return df.filter(F.col(key).isin(*keys))


def recent(conversations: DataFrame, n: int = 10, group: str = "agent_type", activity: str = "last_activity", key: str = "id") -> DataFrame:
    return top_per_group(conversations, [group], [F.desc(activity), F.col(key)], n)


def latest_files(files: DataFrame, order: Sequence[str] = ("added_at",)) -> DataFrame:
    """Newest version of each ``(session_id, name)`` with line and character counts of its content."""
    newest = latest_per_key(files, ["session_id", "name"], list(order))
    return newest.withColumns(ct.file_stats("content"))


#: Characters kept free for a suffix: two and the digits of a number.
TITLE_ROOM = 10


def unique_titles(
    conversations: DataFrame,
    existing: DataFrame | None = None,
    max_len: int = fv.TITLE_CHARS,
    key: str = "id",
    block_seconds: int = 3600,
) -> DataFrame:
    """A title per conversation (``agent_type, title, created_at`` timestamp) that its agent has not used yet.

    The first conversation with a title keeps it, the first further one of a given
    minute gets `` · HH:MM``, all others ``#2``, ``#3`` … in order of creation, as far as needed.
    ``existing`` titles count as used, in all three forms, and so do the plain titles of
    the other new conversations.  A title is cut so that its suffix fits; titles that
    agree up to ``TITLE_ROOM`` characters before the limit share their minutes and numbers.
    No two conversations of an agent get one title, nor one that exists.
    """
    stem = lambda c: F.left(c, F.lit(max_len - TITLE_ROOM))

    def ending(suffix: Column) -> Column:
        return F.concat(F.left(F.col("__base"), F.lit(max_len) - F.length(suffix)), suffix)

    base = F.left("title", F.lit(max_len))
    seconds = F.unix_seconds(F.col("created_at").cast("timestamp"))
    work = conversations.withColumns({"__base": base, "__stem": stem(base), "__s": seconds, "__clock": F.date_format("created_at", "HH:mm")})
    plain = work.select("agent_type", F.col("__base").alias("__t"), F.lit(False).alias("__old"))
    if existing is not None:
        plain = plain.unionByName(existing.select("agent_type", F.col("title").alias("__t"), F.lit(True).alias("__old")))
    taken = plain.filter("__t IS NOT NULL").groupBy("agent_type", "__t").agg(F.max("__old").alias("__old"))

    def used(rows: DataFrame, title: Column, old: bool) -> DataFrame:
        """``rows`` with ``__used``: is this title taken (by a stored conversation, or by a new one as well)?"""
        there = taken.filter("__old") if old else taken
        there = there.select(F.col("agent_type").alias("__agent"), "__t", F.lit(True).alias("__found"))
        on = F.col("agent_type").eqNullSafe(F.col("__agent")) & (F.col("__want") == F.col("__t"))
        found = rows.withColumn("__want", title).join(there, on, "left")
        return found.withColumn("__used", F.coalesce("__found", F.lit(False))).drop("__want", "__agent", "__t", "__found")

    when = [position_block("__s", block_seconds)]
    numbered = used(ranked(work, ["agent_type", "__base"], ["created_at", key], when, "__n"), F.col("__base"), True)
    extra = (F.col("__n") > 1) | F.col("__used")
    first = numbered.filter(~extra).withColumn("unique_title", F.col("__base"))
    timed = ending(F.concat(F.lit(" · "), F.col("__clock")))
    again = used(ranked(numbered.filter(extra).drop("__used"), ["agent_type", "__stem", "__clock"], ["created_at", key], when, "__m"), timed, False)
    at_minute = (F.col("__m") == 1) & ~F.col("__used")
    of_minute = again.filter(at_minute).withColumn("unique_title", timed)
    rest = ranked(again.filter(~at_minute), ["agent_type", "__stem"], ["created_at", key], when, "__o")

    # The n-th conversation left over takes the n-th free number.  Before the j-th used number u there are u - 1 - j free ones:
    # laid in one sequence with the conversations, each of these has to skip the used numbers that come before it.
    number = F.regexp_extract("__t", r"(?s)\A(.*) #([1-9][0-9]{0,7})\z", 2).try_cast("bigint")
    numbers = taken.select("agent_type", stem(F.regexp_replace("__t", r"(?s) #[0-9]+\z", "")).alias("__stem"), number.alias("__no"))
    numbers = ranked(numbers.filter("__no >= 2").distinct(), ["agent_type", "__stem"], ["__no"], position_block("__no"), "__j")
    skips = numbers.select("agent_type", "__stem", (F.col("__no") - 1 - F.col("__j")).alias("__at"), F.lit(1).alias("__side"), F.lit(1).cast("bigint").alias("__skip"))
    asked = rest.withColumns({"__at": F.col("__o").cast("bigint"), "__side": F.lit(0), "__skip": F.lit(0).cast("bigint")})
    both = asked.unionByName(skips, allowMissingColumns=True)
    passed = block_scan(both, ["agent_type", "__stem"], ["__at", "__side"], position_block("__at"), [Running("__skipped", "sum", "__skip")])
    counted = ending(F.concat(F.lit(" #"), (F.col("__at") + 1 + F.col("__skipped")).cast("string")))
    rest = passed.filter("__side = 0").withColumn("unique_title", counted)
    columns = [*conversations.columns, "unique_title"]
    return first.select(*columns).unionByName(of_minute.select(*columns)).unionByName(rest.select(*columns))


# --- usage -------------------------------------------------------------------


def usage_entries(responses: DataFrame, default_model: str, text: str = "response") -> DataFrame:
    """Usage rows of raw responses: ``timestamp, agent, model`` and the three token counts."""
    spent = responses.withColumn("u", pl.token_usage(text))
    return spent.select(
        "timestamp",
        "agent",
        F.coalesce("u.model", F.lit(default_model)).alias("model"),
        "u.input_tokens",
        "u.output_tokens",
        "u.total_tokens",
    )


def usage_budget(usage: DataFrame, budget: int = fv.TOKEN_BUDGET, keys: Sequence[str] = ()) -> DataFrame:
    used = F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint")
    total = usage.groupBy(*keys).agg(used.alias("used")) if keys else usage.agg(used.alias("used"))
    share = F.round(F.col("used") / budget * 100, 1) if budget > 0 else F.lit(0.0)
    return total.withColumns(
        {
            "budget": F.lit(budget).cast("bigint"),
            "remaining": F.greatest(F.lit(0).cast("bigint"), F.lit(budget).cast("bigint") - F.col("used")),
            "percentage": share,
        }
    )


def daily_usage(usage: DataFrame, limit: int = fv.DAILY_REQUESTS, time: str = "timestamp") -> DataFrame:
    """Requests per day and whether the daily limit is reached."""
    counted = usage.groupBy(F.to_date(time).alias("usage_date")).agg(F.count("*").alias("request_count"))
    return counted.withColumn("limit_reached", F.col("request_count") >= limit)


def usage_tail(usage: DataFrame, n: int = 50, order: Sequence[str] = ("timestamp",)) -> DataFrame:
    """Last ``n`` usage entries, oldest first; equal times go by the other columns."""
    full = [*order, *[c for c in usage.columns if c not in order]]
    newest: list[Column] = [F.desc(c) for c in full]
    return usage.orderBy(*newest).limit(n).orderBy(*full)
