"""Ordered-set helpers: first-seen distinct values, top-k per group, latest per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str = "first_seen") -> DataFrame:
    """One row per distinct ``value`` of a group with the smallest ``order`` at which it occurs.

    The order travels as data, so the result never depends on shuffle order.
    """
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(F.struct(*order)).alias(out))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """First ``n`` rows of each group.

    ``row_number() <= n`` lets Spark cut every map partition to ``n`` rows per
    group before the shuffle, so a hot group reaches its task already small.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(out, place).filter(F.col(out) <= n)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last version of each key (map-side combined, no window); equal times go by the hash of the row."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*rest), F.struct(*order, F.xxhash64(*rest).alias("__tie")))
    return df.groupBy(*keys).agg(packed.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def ordered_union(*arrays: Column) -> Column:
    """Distinct elements of several arrays, first occurrence first, blanks and nulls left out."""
    both = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    clean = F.transform(both, lambda x: F.trim(x))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "")))
