"""Expressions over a question: codes, search terms, field numbers, breadth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, col
from tracemill.operators.containment import literal_array


def _words(text: str) -> Column:
    return literal_array(text.split())


def code_tokens(question: Column | str) -> Column:
    """Two-letter codes of a question: explicit phrases first, then every two-letter word but the common ones."""
    q = col(question)
    phrased = [F.regexp_extract_all(q, F.lit(p), F.lit(1)) for p in fv.CODE_PHRASES]
    explicit = F.transform(F.concat(*phrased), lambda c: F.upper(c))
    bare = F.array_except(F.regexp_extract_all(F.upper(q), F.lit(fv.CODE_WORD), F.lit(0)), _words(fv.CODE_STOPWORDS))
    return F.array_distinct(F.concat(explicit, bare))


def term_words(question: Column | str, stopwords: str) -> Column:
    """Upper-case alphanumeric words of 2 to 6 characters that are not stopwords, in order."""
    found = F.regexp_extract_all(F.upper(col(question)), F.lit(fv.TERM_WORD), F.lit(0))
    return F.filter(found, lambda w: ~F.array_contains(_words(stopwords), w))


def search_terms(question: Column | str) -> Column:
    """Every term used to call a block relevant: codes, short words and all other words, upper case."""
    q = col(question)
    plain = F.filter(
        F.regexp_extract_all(F.lower(q), F.lit(r"(?U)\w+"), F.lit(0)),
        lambda w: (F.length(w) >= 2) & ~F.array_contains(_words(fv.TERM_STOPWORDS.lower()), w),
    )
    upper = F.transform(plain, lambda w: F.upper(w))
    return F.array_union(F.array_union(code_tokens(q), term_words(q, fv.TERM_STOPWORDS)), upper)


def count_terms(question: Column | str) -> Column:
    """Terms whose exact occurrences are counted: codes, then short words not yet named."""
    return F.array_union(code_tokens(question), term_words(question, fv.COUNT_STOPWORDS))


def field_numbers(question: Column | str) -> Column:
    return F.regexp_extract_all(col(question), F.lit(fv.FIELD_MENTION), F.lit(1))


def first_field_number(text: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(text), fv.FIELD_MENTION, 1), F.lit(""))


def field_search_terms(number: Column) -> Column:
    """Spellings under which a field number is searched in chunk text."""
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    spelled = [
        F.concat(F.lit("Field "), number),
        F.concat(F.lit("Field"), number),
        F.concat(F.lit("Champ "), number),
        F.concat(F.lit("Champ"), number),
        F.concat(F.lit("FLD "), padded),
        F.concat(F.lit("FLD"), padded),
        F.concat(F.lit("FLD "), number),
    ]
    return F.array_distinct(F.array(*spelled))


def is_broad(question: Column | str) -> Column:
    low = F.lower(col(question))
    found = F.lit(False)
    for words in fv.BROAD_WORDS:
        found = found | F.contains(low, F.lit(words))
    return found


def chunks_wanted(question: Column | str) -> Column:
    return F.when(is_broad(question), fv.BROAD_K).otherwise(fv.NARROW_K)


def spec_keywords(query: Column | str) -> Column:
    """Lower-case words longer than two characters, repeats included."""
    return F.filter(F.regexp_extract_all(F.lower(col(query)), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: F.length(w) > 2)


def search_text(failed: Column, prompt: Column | str) -> Column:
    """Query text: the failed functions, else the prompt, else a default."""
    return F.coalesce(F.nullif(F.array_join(failed, " "), F.lit("")), blank_to_null(prompt), F.lit(fv.DEFAULT_SEARCH))
