"""Reference rows and sections read from page text and sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, empty_to_null, lines_of, strip
from tracemill.operators.report import PART_LINES, reassemble
from tracemill.operators.scan import Running, block_scan, position_block

#: Pages per block when sections are followed through a document.
PAGE_BLOCK = 4096


def page_lines(pages: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Lines of page text; ``(page, i)`` is their position in the document."""
    return pages.select(*keys, "page", F.posexplode(lines_of("text")).alias("i", "line"))


def field_section_lines(pages: DataFrame, keys: Sequence[str] = ("source",), block: int = PAGE_BLOCK) -> DataFrame:
    """Lines of sections opened by a line ``Field N—Name``; later lines belong to it until the next one.

    ``section`` is the position ``(page, i)`` of the header line.
    """
    keys = list(keys)
    lines = page_lines(pages, keys)
    number = empty_to_null(F.regexp_extract("line", fv.FIELD_HEADER, 1))
    headed = lines.withColumn("__no", number).withColumn("__at", F.when(F.col("__no").isNotNull(), F.struct("page", "i")))
    scanned = block_scan(headed, keys, ["page", "i"], position_block("page", block), [Running("section", "max", "__at")])
    return scanned.filter(F.col("section").isNotNull()).drop("__at")


def field_sections(pages: DataFrame, keys: Sequence[str] = ("source",), block: int = PAGE_BLOCK, size: int = PART_LINES) -> DataFrame:
    """Sections with their text, number, name and page; one of more than ``size`` lines is several rows (column ``part``).

    See :func:`field_section_lines` for the lines, :func:`~tracemill.sources.sinks.write_texts` for whole texts in files.
    """
    keys = list(keys)
    inside = field_section_lines(pages, keys, block)
    heads = inside.filter(F.col("__no").isNotNull()).select(
        *keys,
        "section",
        F.col("__no").alias("field_number"),
        strip(F.regexp_extract("line", fv.FIELD_HEADER, 2)).alias("field_name"),
        F.col("page").alias("__page"),
    )
    texts = reassemble(inside.withColumn("text", F.col("line")), [*keys, "section"], ["page", "i"], size=size)
    return texts.join(heads, [*keys, "section"]).withColumnRenamed("__page", "page").withColumn("attributes", F.lit(""))


def normal_type(raw: Column) -> Column:
    """Type code of a table cell: BCD is N (also inside EBCDIC), ASCII is ANS, else the longest known prefix."""
    t = F.upper(strip(raw))
    known = F.nullif(F.regexp_extract(t, "^(" + "|".join(fv.FIELD_TYPES) + ")", 1), F.lit(""))
    return (
        F.when(F.contains(t, F.lit("BCD")), "N")
        .when(F.contains(t, F.lit("ASCII")), "ANS")
        .otherwise(F.coalesce(known, F.left(F.element_at(F.split(t, r"\s+"), 1), F.lit(3))))
    )


def encoding(raw: Column) -> Column:
    t = F.upper(raw)
    return (
        F.when(F.contains(t, F.lit("BCD")), "BCD")
        .when(F.contains(t, F.lit("ASCII")), "ASCII")
        .when(F.contains(t, F.lit("BINARY")) | (t == "B"), "Binary")
        .otherwise("")
    )


def field_table(pages: DataFrame, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Field definitions from table rows of page text; the first row of a field number wins."""
    keys = list(keys)
    low, high = fv.FIELD_NUMBERS
    lines = page_lines(pages, keys)
    pick = lambda i: F.coalesce(
        empty_to_null(F.regexp_extract("line", fv.FIELD_ROW, i)), empty_to_null(F.regexp_extract("line", fv.FIELD_ROW_SHORT, i))
    )
    rows = lines.select(*keys, "page", "i", pick(1).alias("number"), strip(pick(2)).alias("name"), pick(3).cast("int").alias("length"), strip(pick(4)).alias("raw"))
    good = rows.filter(F.col("number").cast("int").between(low, high) & (F.col("name") != "") & F.col("length").isNotNull())
    body = F.struct("name", "length", normal_type(F.col("raw")).alias("type_code"), encoding(F.col("raw")).alias("format"), "page")
    first = good.groupBy(*keys, "number").agg(F.min_by(body, F.struct("page", "i")).alias("f"))
    return first.select(*keys, "number", "f.*")


def sheet_lines(cells: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("source", "sheet"), row: str = "row_no") -> DataFrame:
    """Rows of a sheet as ``Ligne n: a | b``, empty cells skipped, empty rows left out."""
    joined = F.concat_ws(" | ", *[strip(F.col(c).cast("string")) for c in columns])
    rows = cells.select(*keys, row, joined.alias("__t")).filter(blank_to_null("__t").isNotNull())
    return rows.select(*keys, row, F.format_string("Ligne %d: %s", F.col(row), F.col("__t")).alias("text"))


def spec_documents(specs: DataFrame, source: str) -> DataFrame:
    """Function-spec rows as documents of the chunk store."""
    text = F.format_string(
        "Fonction %s (module %s, fichier %s)\nDescription : %s\nConditions : %s",
        F.col("function"), F.col("source"), F.col("path"), F.col("description"), F.col("exception"),
    )
    return specs.select(F.lit(source).alias("source"), F.lit("function").alias("type"), "function", F.col("source").alias("module"), text.alias("text"))


def section_documents(sections: DataFrame) -> DataFrame:
    return sections.select("source", F.lit("field_definition").alias("type"), "field_number", "field_name", "attributes", "page", "text")


def all_documents(*parts: DataFrame) -> DataFrame:
    """Documents of every kind in one table; columns a kind lacks are null."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """A pages table (``file_hash, session_id, source, page, text``) in Parquet."""
    return spark.read.parquet(path)
