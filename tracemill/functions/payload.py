"""Sizes, caps and payload parsing as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, col, lines_of, strip, words_of


def token_estimate(text: Column | str, at_least: int = 0) -> Column:
    size = F.floor(F.length(col(text)) / fv.CHARS_PER_TOKEN)
    return F.coalesce(F.greatest(size, F.lit(at_least)), F.lit(0)).cast("bigint")


def capped_raw_text(text: Column | str, cap: int = fv.RAW_TEXT_CAP) -> Column:
    """Unstructured text cut at ``cap`` characters with a notice of the full size."""
    t = col(text)
    note = F.format_string(
        "\n\n[AVERTISSEMENT SYSTEME DE TRONCATURAGE TECHNIQUE : texte brut de %d lignes et %d caractères, "
        "tronqué aux %d premiers caractères.]",
        F.size(lines_of(t)),
        F.length(t),
        F.lit(cap),
    )
    return F.when(F.length(t) > cap, F.concat(F.left(t, F.lit(cap)), note)).otherwise(t)


def cut_at_line(text: Column | str, cap: Column | int, model: str = "") -> Column:
    """First ``cap`` characters, cut back to the last line end when that leaves more than 200, with a notice."""
    t = col(text)
    head = F.left(t, F.lit(cap) if isinstance(cap, int) else cap)
    after_last = F.instr(F.reverse(head), F.lit("\n"))
    last_newline = F.when(after_last > 0, F.length(head) - after_last).otherwise(-1)
    cut = F.when(last_newline > fv.MIN_CUT, F.left(head, last_newline)).otherwise(head)
    return F.concat(cut, F.lit(f"\n\n[PAYLOAD_TRUNCATED: Troncature appliquée pour le modèle {model}]"))


def spaced_json(compact: Column) -> Column:
    """JSON text with one space after every comma and colon outside strings."""
    tokens = F.regexp_extract_all(compact, F.lit(r'"(?:[^"\\]|\\.)*"|[^"]+'), F.lit(0))
    apart = lambda t: F.replace(F.replace(t, F.lit(","), F.lit(", ")), F.lit(":"), F.lit(": "))
    return F.array_join(F.transform(tokens, lambda t: F.when(F.startswith(t, F.lit('"')), t).otherwise(apart(t))), "")


def cut_json_array(text: Column | str, cap: Column) -> Column:
    """The longest prefix of a JSON array whose text stays within ``cap`` characters; null for anything else.

    Items are written as text up to the first that does not fit, and no further.
    """
    parts = F.try_variant_get(F.try_parse_json(col(text)), "$", "array<variant>")
    # Read and written twice: only then do all spellings of a number end as one.
    written = lambda v: spaced_json(F.to_json(F.try_parse_json(F.to_json(v))))
    # Brackets and the separators between items: two characters more for every item.
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def add(acc, item):
        # A one-element array names the new size, which is then found once per item and not for every use.
        size = F.array(F.when(acc["open"], acc["size"] + F.length(written(item)) + 2))

        def after(s):
            fits = F.coalesce(s <= cap, F.lit(False))
            return F.struct(F.when(fits, s).otherwise(acc["size"]).alias("size"), (acc["n"] + fits.cast("int")).alias("n"), fits.alias("open"))

        return F.get(F.transform(size, after), F.lit(0))

    held = F.aggregate(parts, start, add, lambda acc: acc["n"])
    return F.concat(F.lit("["), F.array_join(F.transform(F.slice(parts, F.lit(1), held), written), ", "), F.lit("]"))


def cut_json_object(text: Column | str, cap: Column) -> Column:
    """A JSON object with every list cut to its first half (one item at least); null for anything else.

    What is still longer than ``cap`` loses its tail and is then no longer JSON.
    """
    fields = F.map_entries(F.from_json(F.to_json(F.try_parse_json(col(text))), "map<string, variant>"))

    def halved(v):
        whole = F.from_json(F.to_json(v), "array<variant>")
        half = F.slice(whole, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(whole) / 2).cast("int")))
        listed = F.concat(F.lit("["), F.array_join(F.transform(half, lambda x: spaced_json(F.to_json(x))), ", "), F.lit("]"))
        is_list = F.startswith(F.to_json(v), F.lit("[")) & (F.size(whole) > 0)
        return F.when(is_list, listed).otherwise(spaced_json(F.to_json(v)))

    quoted = lambda k: F.concat(F.lit('"'), F.regexp_replace(k, r'(["\\])', r"\\$1"), F.lit('"'))
    body = F.array_join(F.transform(fields, lambda e: F.concat(quoted(e["key"]), F.lit(": "), halved(e["value"]))), ", ")
    return F.left(F.concat(F.lit("{"), body, F.lit("}")), cap)


def cut_part(text: Column | str, cap: Column, model: str = "") -> Column:
    """A prompt part cut to ``cap`` characters: JSON arrays and objects by their items, other text at a line end."""
    t = strip(text)
    enclosed = lambda a, b: F.startswith(t, F.lit(a)) & F.endswith(t, F.lit(b))
    as_json = F.when(enclosed("[", "]"), cut_json_array(t, cap)).when(enclosed("{", "}"), cut_json_object(t, cap))
    return F.coalesce(as_json, cut_at_line(text, cap, model))


def conversation_title(question: Column | str, words: int = fv.TITLE_WORDS) -> Column:
    found = words_of(question)
    short = F.concat_ws(" ", F.slice(found, F.lit(1), F.lit(words)))
    return F.when(F.size(found) > words, F.concat(short, F.lit("…"))).otherwise(short)


USAGE_SCHEMA = (
    "usage_metadata struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>, "
    "response_metadata struct<model_used:string,model_name:string,"
    "token_usage:struct<prompt_tokens:bigint,completion_tokens:bigint,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>,"
    "usage:struct<prompt_tokens:bigint,completion_tokens:bigint,input_tokens:bigint,output_tokens:bigint,total_tokens:bigint>>"
)


def token_usage(response_json: Column | str) -> Column:
    """``input_tokens, output_tokens, total_tokens, model`` from either response shape; the total is filled in."""
    r = F.from_json(col(response_json), USAGE_SCHEMA)
    new, old = r["usage_metadata"], F.coalesce(r["response_metadata"]["token_usage"], r["response_metadata"]["usage"])
    zero = F.lit(0).cast("bigint")

    def pick(modern: str, *classic: str) -> Column:
        older = F.coalesce(*[F.nullif(old[c], zero) for c in classic], zero)
        return F.when(new.isNotNull(), F.coalesce(new[modern], zero)).otherwise(older)

    spent_in, spent_out = pick("input_tokens", "prompt_tokens", "input_tokens"), pick("output_tokens", "completion_tokens", "output_tokens")
    total = pick("total_tokens", "total_tokens")
    return F.struct(
        spent_in.alias("input_tokens"),
        spent_out.alias("output_tokens"),
        F.when(total == 0, spent_in + spent_out).otherwise(total).alias("total_tokens"),
        F.coalesce(r["response_metadata"]["model_used"], r["response_metadata"]["model_name"]).alias("model"),
    )


def joined_blocks(blocks: Column | str) -> Column:
    """Text of a response given as an array of text blocks."""
    return F.array_join(F.transform(col(blocks), lambda b: F.coalesce(b, F.lit(""))), "\n")


def without_fences(text: Column | str) -> Column:
    """Text without a surrounding code fence."""
    t = strip(text)
    opened = F.regexp_replace(t, r"(?i)^```(?:json)?\s*", "")
    bare = strip(F.regexp_replace(opened, r"\s*```$", ""))
    return F.when(F.startswith(t, F.lit("```")), bare).otherwise(t)


def parsed_report(text: Column | str, schema: str) -> Column:
    """Report struct of a response text, or null when it is not a JSON object of that shape."""
    body = without_fences(text)
    looks = F.get_json_object(body, "$.summary").isNotNull() | F.get_json_object(body, "$.transactions").isNotNull()
    return F.when(looks, F.from_json(body, schema))


def non_blank(text: Column | str) -> Column:
    return blank_to_null(text).isNotNull()
