"""Expressions over page and chunk text, and the splitter used per document."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, col, extract, lines_of


def content_hash(content: Column | str) -> Column:
    """SHA-256 of a text (UTF-8) or binary column, in hex."""
    return F.sha2(col(content), 256)


def file_stats(content: Column | str) -> dict[str, Column]:
    lines = lines_of(content)
    return {
        "line_count": F.size(lines),
        "non_empty_line_count": F.size(F.filter(lines, lambda x: blank_to_null(x).isNotNull())),
        "char_count": F.length(col(content)),
    }


def command_code(text: Column | str) -> Column:
    return F.upper(extract(text, fv.COMMAND_PAIR, 1))


def response_code(text: Column | str) -> Column:
    """Response code stated as a value, else the second half of the first command pair."""
    return F.coalesce(F.upper(extract(text, fv.RESPONSE_VALUE, 1)), F.upper(extract(text, fv.COMMAND_PAIR, 2)))


def has_error_table(text: Column | str) -> Column:
    low = F.lower(col(text))
    found = F.lit(False)
    for words in fv.ERROR_TABLE_WORDS:
        found = found | F.contains(low, F.lit(words))
    return found


def word_tokens(text: Column | str) -> Column:
    """Distinct alphanumeric words of a text, upper case."""
    return F.array_distinct(F.regexp_extract_all(F.upper(col(text)), F.lit(r"(?U)\b([A-Z0-9]+)\b"), F.lit(1)))


def split_spans(text: str, size: int, overlap: int, separators: Sequence[str] = fv.SEPARATORS) -> list[str]:
    """Recursive splitting of one text into pieces of at most ``size`` characters.

    The text is cut at the first separator it contains (the separator stays at the
    head of what follows), neighbouring parts are packed up to ``size`` with up to
    ``overlap`` characters repeated, and a part that is itself too long is cut again
    with the remaining separators.  Works on positions found one after the other: besides
    the pieces, only the parts of one window are held.
    """
    out: list[str] = []

    def emit(lo: int, hi: int) -> None:
        piece = text[lo:hi].strip()
        if piece:
            out.append(piece)

    def parts(lo: int, hi: int, sep: str) -> Iterator[tuple[int, int]]:
        if not sep:
            yield from zip(range(lo, hi), range(lo + 1, hi + 1))
            return
        at = text.find(sep, lo, hi)
        while at >= 0:
            if at > lo:
                yield lo, at
            lo, at = at, text.find(sep, at + len(sep), hi)
        if hi > lo:
            yield lo, hi

    def slide(lo: int, hi: int) -> None:
        """What packing single characters comes to: windows at even steps."""
        step = size - max(0, min(overlap, size - 1))
        while lo + size < hi:
            emit(lo, lo + size)
            lo += step
        emit(lo, hi)

    def cut(lo: int, hi: int, level: int) -> None:
        while level < len(separators) - 1 and separators[level] and text.find(separators[level], lo, hi) < 0:
            level += 1
        sep = separators[level]
        if not sep and size > 0:
            slide(lo, hi)
            return
        window: deque[tuple[int, int]] = deque()
        held = 0
        for a, b in parts(lo, hi, sep):
            width = b - a
            if width < size:
                if window and held + width > size:
                    emit(window[0][0], window[-1][1])
                    while window and (held > overlap or held + width > size):
                        start, end = window.popleft()
                        held -= end - start
                window.append((a, b))
                held += width
                continue
            if window:
                emit(window[0][0], window[-1][1])
                window.clear()
                held = 0
            if level + 1 < len(separators):
                cut(a, b, level + 1)
            else:
                out.append(text[a:b])
        if window:
            emit(window[0][0], window[-1][1])

    if text:
        cut(0, len(text), 0)
    return out
