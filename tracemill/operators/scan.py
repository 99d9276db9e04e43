"""Ordered running aggregates over groups of any size.

A plain ``Window.partitionBy(keys).orderBy(position)`` puts a whole group into one
task.  Here a group is cut into blocks of consecutive positions:

1. each block is reduced to one row (map-side combined, so a hot group is small
   before it is shuffled);
2. a window over those few block rows yields what precedes each block;
3. that value re-enters the data as one *carry row* at the head of its block, and
   an ordinary window over ``(keys, block)`` finishes the work.

No task ever holds more than one block, and the detail rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions per block: the most rows of one group that a single task sorts.
BLOCK = 1 << 20

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """``out`` = ``how`` of ``value`` over the rows up to this one.

    ``before=True`` leaves the current row out.
    """

    out: str
    how: str
    value: str
    before: bool = False


@dataclass(frozen=True)
class Total:
    """``out`` = ``how`` of ``value`` over the whole group."""

    out: str
    how: str
    value: str


def position_block(position: Column | str, size: int = BLOCK) -> Column:
    c = F.col(position) if isinstance(position, str) else position
    return F.floor(c / F.lit(size)).cast("bigint")


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | Sequence[Column],
    measures: Sequence[Running | Total],
) -> DataFrame:
    """Add the ``measures`` to ``df``.

    ``block`` must never fall as ``order`` grows inside a group (a coarser position; of
    several, a later one may only cut rows that are equal in what the earlier ones cut).
    """
    blocks = [block] if isinstance(block, Column) else list(block)
    names = [f"__b{i}" for i in range(len(blocks))]
    columns = df.columns
    tagged = df.select("*", *[b.alias(n) for b, n in zip(blocks, names)])

    reduced = tagged.groupBy(*keys, *names).agg(
        *[_AGG[m.how](m.value).alias(f"__r_{m.out}") for m in measures]
    )
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = reduced.select(
        *keys,
        *names,
        *[
            _AGG[m.how](f"__r_{m.out}").over(earlier if isinstance(m, Running) else whole).alias(f"__c_{m.out}")
            for m in measures
        ],
    )
    if all(isinstance(m, Running) for m in measures):
        carried = carried.filter(reduce(or_, [F.col(f"__c_{m.out}").isNotNull() for m in measures]))

    rows = tagged.select("*", F.lit(1).alias("__row")).unionByName(
        carried.select("*", F.lit(0).alias("__row")), allowMissingColumns=True
    )
    local = Window.partitionBy(*keys, *names)
    ordered = local.orderBy("__row", *order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    prior = ordered.rowsBetween(Window.unboundedPreceding, -1)

    out = []
    for m in measures:
        carry = F.col(f"__c_{m.out}")
        if isinstance(m, Total):
            out.append(F.max(carry).over(local).alias(m.out))
        else:
            value = F.when(F.col("__row") == 1, F.col(m.value)).otherwise(carry)
            out.append(_AGG[m.how](value).over(prior if m.before else upto).alias(m.out))
    kept = [c for c in columns if c not in {m.out for m in measures}]
    return rows.select(*kept, "__row", *out).filter("__row = 1").drop("__row")


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | Sequence[Column], out: str) -> DataFrame:
    """1-based position of each row in its group, for groups of any size."""
    one = df.withColumn("__one", F.lit(1).cast("bigint"))
    return block_scan(one, keys, order, block, [Running(out, "sum", "__one")]).drop("__one")
