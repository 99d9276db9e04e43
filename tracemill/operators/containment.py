"""Which texts contain which needles, without pairing every text with every needle.

All needles are searched at once by an Aho-Corasick automaton inside Arrow tasks: one walk over a text, whatever their
number.  Only the text column crosses to Python and only the needles found come back; no text is shuffled.  Needles beyond
``AUTOMATON_BYTES`` are dealt to several automata, which walk the same texts one after the other; a worker holds one of
them at a time.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill.session import bounded_rows, small, stage

#: Bytes that one automaton may take in a worker, by the nodes of its tree.
AUTOMATON_BYTES = 96 << 20
#: Bytes of a node with its link, and of a needle besides its text.
NODE_BYTES, NEEDLE_BYTES = 56, 16
#: Needle lists up to this many are fetched without measuring them first.
FEW_NEEDLES = 2000
_SEP = "\x1f"
_BUILT: dict[str, tuple] = {}


class Needles(NamedTuple):
    """A needle list as one Arrow array of strings, and the name of its automaton."""

    name: str
    held: Broadcast


def literal_array(values: list[str]) -> Column:
    """A constant array of strings (one literal, folded by the optimizer)."""
    if not values:
        return F.array().cast("array<string>")
    return F.split(F.lit(_SEP.join(values)), _SEP)


def needle_lists(needles: DataFrame, *order: str) -> list[Needles]:
    """The distinct, non-empty strings of the first column of ``needles``, by ``order`` and themselves, in broadcast lists.

    The automaton of a list takes at most about ``AUTOMATON_BYTES``; strings reach the driver one partition at a time.
    """
    spark = needles.sparkSession
    rows = bounded_rows(needles, FEW_NEEDLES)
    if rows is None:
        rows = stage(needles, "needles").orderBy(*order, needles.columns[0]).toLocalIterator()
    else:
        rows = sorted(rows, key=lambda r: (*[r[o] for o in order], r[0]))

    def sent(part: list[str]) -> Needles:
        return Needles(uuid.uuid4().hex, spark.sparkContext.broadcast(pa.array(part, pa.string())))

    out, part, size, last = [], [], 0, ""
    for r in rows:
        if size > AUTOMATON_BYTES:
            out.append(sent(part))
            part, size, last = [], 0, ""
        # Needles share the nodes of a common beginning: at least that with the needle before.
        new = len(r[0]) - len(os.path.commonprefix((last, r[0])))
        part.append(r[0])
        size += len(r[0].encode()) + NEEDLE_BYTES + NODE_BYTES * new
        last = r[0]
    return [*out, sent(part)] if part else out


def _automaton(needles: Needles):
    """The automaton of a needle list and the needles' lengths; a worker holds that of the list it used last, and no other while it builds one."""
    if needles.name not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, needle in enumerate(needles.held.value):
            built.add_word(needle.as_py(), i)
        built.make_automaton()
        _BUILT[needles.name] = (built, pc.utf8_length(needles.held.value).to_numpy())
    return _BUILT[needles.name]


def _found(automaton, lengths, text: str) -> list[str]:
    """The needles in ``text`` in the order of their list, cut out of the text itself."""
    ends = {i: end + 1 for end, i in automaton.iter(text)}
    return [text[ends[i] - int(lengths[i]) : ends[i]] for i in sorted(ends)]


def _finder(lists: list[Needles]):
    @F.arrow_udf("array<string>")
    def find(texts: pa.Array) -> pa.Array:
        found = [None if not t.is_valid else [] for t in texts]
        for needles in lists:
            automaton, lengths = _automaton(needles)
            for t, held in zip(texts, found):
                if held is not None:
                    held += _found(automaton, lengths, t.as_py())
        return pa.array(found, pa.list_(pa.string()))

    return find


def contained(text: Column, lists: list[Needles]) -> Column:
    """The needles that occur in ``text``, as an array in the order of the lists (null for a null text)."""
    return _finder(lists)(text) if lists else F.array().cast("array<string>")


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str, ignore_case: bool = False) -> DataFrame:
    """Rows of ``texts`` joined to the rows of ``needles`` whose ``needle`` occurs in ``text``; empty needles never do.

    The texts are read once for every needle list.
    """

    def fold(c: Column) -> Column:
        return F.lower(c) if ignore_case else c

    keyed = needles.filter(F.length(needle) > 0).withColumn("__key", fold(F.col(needle)))
    lists = needle_lists(keyed.select("__key").distinct())
    passes = [texts.withColumn("__key", F.explode(contained(fold(F.col(text)), part))) for part in ([n] for n in lists)]
    hits = reduce(DataFrame.unionByName, passes or [texts.withColumn("__key", F.explode(contained(F.col(text), [])))])
    return hits.join(small(keyed), "__key").drop("__key")
