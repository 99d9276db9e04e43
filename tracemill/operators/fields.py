"""Message fields of transactions and their conformance to the field reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions import conformance as cf
from tracemill.functions import trace_line as tl
from tracemill.operators.containment import contains_join
from tracemill.operators.ordered import top_per_group
from tracemill.operators.transactions import TX, in_segments, line_facts, segments
from tracemill.session import small
from tracemill.sources.refdata import field_key, lookup


def field_said() -> Column:
    """What a line says about a field: ``no, last_line, value, declared_length, field_prefix``; null where it names none."""
    line = F.col("line")
    said = F.struct(
        tl.field_number(line).alias("no"),
        F.col("line_no").alias("last_line"),
        tl.field_value(line).alias("value"),
        tl.field_declared_length(line).alias("declared_length"),
        tl.field_prefix(line).alias("field_prefix"),
    )
    return F.when(~F.col("is_start") & F.contains(line, F.lit("[")) & tl.field_number(line).isNotNull(), said)


def fold_fields(told: DataFrame) -> DataFrame:
    """Fields of each transaction from the lines that name one (``TX, line_no, said``)."""
    told = told.withColumn("field_number", F.col("said.no"))
    folded = told.groupBy(*TX, "field_number").agg(F.min("line_no").alias("first_line"), F.max(F.col("said").dropFields("no")).alias("said"))
    return name_fields(folded.select(*TX, "field_number", "first_line", "said.*"))


def tx_fields(lines: DataFrame) -> DataFrame:
    """Fields of each segment of ``file_id, line_no, line``: last value stated, first line seen, name and description."""
    facts = line_facts(lines)
    told = facts.withColumn("said", field_said()).filter(F.col("said").isNotNull())
    return fold_fields(in_segments(told.select("file_id", "session_id", "line_no", "said"), segments(facts)))


def name_fields(fields: DataFrame) -> DataFrame:
    """Add the dictionary ``name`` and ``description`` of ``field_number``."""
    no = F.col("field_number")
    padded = F.when(F.length(no) < 3, F.lpad(no, 3, "0")).otherwise(no)
    by = lambda i: F.coalesce(lookup(fv.ISO_FIELDS, padded, i), lookup(fv.ISO_FIELDS, no, i))
    return fields.withColumns(
        {
            "name": F.coalesce(by(1), F.concat_ws(" ", "field_prefix", no)),
            "description": F.coalesce(by(2), F.lit(fv.FIELD_UNKNOWN)),
        }
    )


def merge_fields(fields: DataFrame, places: DataFrame) -> DataFrame:
    """Fields of merged transactions: the first part of the fold that states a field wins."""
    rest = [c for c in fields.columns if c not in (*TX, "field_number")]
    placed = fields.join(places, TX)
    best = placed.groupBy("file_id", "root_session_id", "root_seg", "field_number").agg(
        F.min_by(F.struct(*rest), F.struct("place", "first_line")).alias("f")
    )
    return best.select(
        "file_id",
        F.col("root_session_id").alias("session_id"),
        F.col("root_seg").alias("seg"),
        "field_number",
        "f.*",
    )


def document_definitions(wanted: DataFrame, chunks: DataFrame) -> DataFrame:
    """Definitions of fields no dictionary knows, from document chunks.

    ``wanted``: distinct ``session_id, field_number``.  The session's own chunks come
    first (first chunk naming ``Field n``); what they leave open is filled from field
    sections anywhere, found by number.
    """
    terms = wanted.select("session_id", "field_number", F.concat(F.lit("Field "), "field_number").alias("term"))
    needles = terms.select("term").distinct()
    texts = chunks.select("session_id", "chunk_id", "text", "field_name", "attributes", "source")
    hits = contains_join(texts, "text", needles, "term", ignore_case=True)
    first = top_per_group(hits, ["session_id", "term"], [F.col("chunk_id")], 1)
    mine = terms.join(first, ["session_id", "term"])
    session_level = mine.select(
        "session_id",
        "field_number",
        F.col("field_name").alias("s_name"),
        F.coalesce(F.nullif(F.trim("attributes"), F.lit("")), cf.type_text("text")).alias("s_attributes"),
        F.coalesce("source", F.lit(fv.SESSION_SOURCE)).alias("s_source"),
    )
    sections = chunks.filter("type = 'field_definition'").groupBy("field_number").agg(
        F.min_by(
            F.struct(
                F.col("field_name").alias("g_name"),
                F.coalesce(F.nullif(F.trim("attributes"), F.lit("")), cf.type_text("text")).alias("g_attributes"),
                F.col("source").alias("g_source"),
            ),
            "chunk_id",
        ).alias("g")
    )
    both = wanted.join(session_level, ["session_id", "field_number"], "left").join(sections, "field_number", "left")
    complete = F.col("s_name").isNotNull() & F.col("s_attributes").isNotNull()
    use_global = ~complete & F.col("g").isNotNull()
    return both.select(
        "session_id",
        "field_number",
        F.when(use_global, F.coalesce("g.g_name", "s_name")).otherwise(F.col("s_name")).alias("field_name"),
        F.when(use_global, F.coalesce("g.g_attributes", "s_attributes")).otherwise(F.col("s_attributes")).alias("attributes"),
        F.when(use_global, F.coalesce("g.g_source", "s_source", F.lit(fv.GLOBAL_SOURCE))).otherwise(F.col("s_source")).alias("source"),
    )


def with_expected_type(definitions: DataFrame) -> DataFrame:
    """Definitions with ``expected_type, max_length, expected_type_label`` read from ``attributes`` once.

    The type is null where none is stated, and for field 52 where it is declared numeric (it holds hexadecimal digits).
    """
    number = "field_key" if "field_key" in definitions.columns else "field_number"
    typed = definitions.withColumns(
        {"max_length": cf.expected_length("attributes"), "expected_type": cf.expected_type("attributes")}
    )
    exempt = F.coalesce(cf.is_exempt(field_key(number), "expected_type"), F.lit(False))
    strict = typed.withColumn("expected_type", F.when(~exempt, F.col("expected_type")))
    return strict.withColumn("expected_type_label", cf.type_label("expected_type"))


def conformance(fields: DataFrame, reference: DataFrame, chunks: DataFrame | None = None, doc_session: str | None = None) -> DataFrame:
    """Format violations of ``fields`` (any table with ``field_number, value``).

    A number the reference knows is never looked up elsewhere, whether or not its entry
    states a usable type.  Numbers it does not know are looked up once per distinct
    number in the document chunks, if given.
    """
    keyed = fields.withColumn("field_key", field_key("field_number"))
    entries = with_expected_type(reference).drop("priority").withColumn("__known", F.lit(True))
    known = keyed.join(small(entries), "field_key", "left")
    if chunks is not None:
        open_numbers = (
            known.filter(F.col("__known").isNull())
            .select("field_number")
            .distinct()
            .withColumn("session_id", F.lit(doc_session))
        )
        found = document_definitions(open_numbers, chunks).drop("session_id").withColumns(
            {
                "field_name": F.coalesce("field_name", F.concat(F.lit("Field "), "field_number")),
                "source": F.coalesce("source", F.lit(fv.SESSION_SOURCE)),
            }
        )
        columns = [c for c in with_expected_type(found).columns if c != "field_number"]
        late = with_expected_type(found).select("field_number", *[F.col(c).alias(f"__{c}") for c in columns])
        known = (
            known.join(late, "field_number", "left")
            .withColumns({c: F.coalesce(c, f"__{c}") for c in columns})
            .drop(*[f"__{c}" for c in columns])
        )
    typed = known.drop("__known").filter(F.col("expected_type").isNotNull())
    bad = typed.filter(cf.violates("value", "expected_type", "max_length")).withColumns(
        {
            "observed_value": cf.observed("value"),
            "non_conformity_type": cf.reasons("value", "expected_type", "max_length"),
        }
    )
    return bad.withColumn("message", cf.message()).drop("field_key", "max_length")
