"""Security-module codes and documentation excerpts as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import col, empty_to_null, quote_regex, strip, words_of


def raw_token(text: Column | str) -> Column:
    """Code token of a free text: what the code pattern captures first, else the last word."""
    t = strip(text)
    groups = [empty_to_null(F.regexp_extract(t, fv.HSM_CODE, i)) for i in range(1, 7)]
    last_word = F.btrim(F.element_at(words_of(t), -1), F.lit(fv.HSM_TOKEN_TRIM))
    token = F.upper(strip(F.coalesce(*groups, last_word)))
    return F.when(t != "", F.translate(token, "_- ", ""))


def split_token(token: Column | str) -> dict[str, Column]:
    """``lookup_key``, ``response_code`` and ``error_number`` a token stands for (before the command map)."""
    t = col(token)
    both = F.rlike(t, F.lit(r"^[A-Z]{2}\d{2}$"))
    letters = F.rlike(t, F.lit(r"^[A-Z]{2}$"))
    number = F.rlike(t, F.lit(r"^\d{1,3}$"))
    padded = F.when(F.length(t) < 2, F.lpad(t, 2, "0")).otherwise(t)
    return {
        "lookup_key": F.when(number, padded).otherwise(t),
        "response_code": F.when(both, F.left(t, F.lit(2))).when(letters, t),
        "error_number": F.when(both, F.right(t, F.lit(2))).when(number, padded),
    }


def display(key: Column | str, command: Column | str, response: Column | str, number: Column | str) -> Column:
    k, c, r, n = col(key), col(command), col(response), col(number)
    arrow = F.concat(c, F.lit(" → "), r, F.coalesce(F.concat(F.lit(" / "), n), F.lit("")))
    return (
        F.when(r.isNotNull() & n.isNotNull() & ~F.startswith(k, r), F.concat(r, n))
        .when(r.isNotNull() & c.isNotNull(), arrow)
        .otherwise(k)
    )


def mentions_code(text: Column | str) -> Column:
    """Whether a text is about a security-module code at all."""
    t = col(text)
    return F.contains(F.lower(t), F.lit("hsm")) | F.rlike(t, F.lit(fv.HSM_CODE_SHAPE))


def report_code(text: Column | str) -> Column:
    """Code named in a report text: first pattern that matches; two bare digits mean ``EDnn`` where ``ed`` is mentioned."""
    t = col(text)
    gate = F.contains(F.lower(t), F.lit("hsm")) | F.rlike(t, F.lit(fv.HSM_REPORT_SHAPE))
    found = F.coalesce(*[empty_to_null(F.regexp_extract(t, p, 1)) for p in fv.HSM_REPORT_CODES])
    token = F.regexp_replace(F.upper(found), r"[_\-\s]", "")
    bare = F.rlike(token, F.lit(r"^\d{2}$")) & F.contains(F.lower(t), F.lit("ed"))
    return F.when(gate, F.when(bare, F.concat(F.lit("ED"), token)).otherwise(token))


def without_page_artifacts(text: Column | str) -> Column:
    """Text without page marks, running heads and injected correspondence lines."""

    def is_artifact(line: Column) -> Column:
        bare, found = strip(line), F.lit(False)
        for pattern in fv.PAGE_ARTIFACTS:
            found = found | F.rlike(bare, F.lit(pattern))
        return found

    kept = F.filter(F.split(col(text), "\n"), lambda line: ~is_artifact(line))
    return strip(F.array_join(kept, "\n"))


def excerpt_score(content: Column | str, meta_command: Column | str, meta_response: Column | str, command: Column | str, response: Column | str) -> Column:
    """How well an excerpt documents a command / response pair."""
    text = F.upper(F.coalesce(col(content), F.lit("")))
    mc, mr = F.upper(col(meta_command)), F.upper(col(meta_response))
    c, r = empty_to_null(command), empty_to_null(response)

    def points(condition: Column, value: float) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0.0)

    def word(code: Column) -> Column:
        return F.contains(text, code) & F.rlike(text, F.concat(F.lit(r"(?U)\b"), quote_regex(code), F.lit(r"\b")))

    has = lambda s: F.contains(text, F.lit(s))
    other_response = (F.coalesce(mr, F.lit("")) != "") & ~mr.eqNullSafe(r)
    return (
        points(c.isNotNull() & (mc != "") & (mc != c), fv.SCORE_OTHER_CODE)
        + points(c.isNotNull() & other_response, fv.SCORE_OTHER_CODE)
        + points(word(c), fv.SCORE_CODE_TOKEN)
        + points(word(r), fv.SCORE_CODE_TOKEN)
        + points(has("ERROR CODE") | has("RESPONSE CODE"), fv.SCORE_ERROR_TABLE)
        + points(has("NO ERROR"), fv.SCORE_NO_ERROR)
        + points(F.rlike(text, F.lit(fv.CODE_ROW)), fv.SCORE_CODE_ROW)
        + points(has("AS2805") & ~F.coalesce(c.isin("A0", "A2"), F.lit(False)), fv.SCORE_OTHER_CHAPTER)
        + points(has("VERIFY AN INTERCHANGE PIN USING THE ABA PVV METHOD") & has("275"), fv.SCORE_CONTENTS_PAGE)
    )


def names_error(content: Column | str, number: Column | str) -> Column:
    """Excerpt names the error number, or is a generic error table; true when no number is asked for."""
    t, n = col(content), col(number)
    short = F.ltrim(n, F.lit("0"))
    spaced = F.contains(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), short, F.lit(" ")))
    low = F.lower(t)
    generic = F.contains(low, F.lit("error")) | F.contains(low, F.lit("parity"))
    return F.coalesce(n.isNull() | F.contains(t, n) | spaced | generic, F.lit(True))


def page_score(text: Column | str, command: Column | str, response: Column | str, number: Column | str) -> Column:
    t = col(text)
    up, low = F.upper(t), F.lower(t)

    def points(condition: Column, value: int) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(0)

    return (
        points(F.contains(t, col(number)), 3)
        + points(F.contains(up, col(response)), 2)
        + points(F.contains(up, col(command)), 1)
        + points(F.contains(low, F.lit("error")) | F.contains(low, F.lit("response")), 1)
    )
