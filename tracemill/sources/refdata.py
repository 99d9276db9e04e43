"""Reference tables: shipped values, user files, and the overlay of the two.

All shipped tables have a fixed number of rows (tens), so they may be broadcast or
folded into a literal map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill import fixed_values as fv
from tracemill.functions.text import blank_to_null, strip
from tracemill.session import values


def rows_of(table: str) -> list[list[str]]:
    return [line.split("|") for line in table.strip().splitlines()]


def lookup(table: str, key: Column, field: int) -> Column:
    """Value of a fixed table for ``key`` as a literal-map expression (null when absent)."""
    rows = rows_of(table)
    keys = F.split(F.lit("|".join(r[0] for r in rows)), r"\|")
    values = F.split(F.lit("|".join(r[field] for r in rows)), r"\|")
    return F.try_element_at(F.map_from_arrays(keys, values), key)


def _table(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return values(spark, rows_of(table), schema)


def message_types(spark: SparkSession) -> DataFrame:
    return _table(spark, fv.MESSAGE_TYPES, "code string, description string")


def iso_fields(spark: SparkSession) -> DataFrame:
    return _table(spark, fv.ISO_FIELDS, "number string, name string, description string")


def read_iso_reference(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``{mti: {code: text}, fields: {NNN: {name, description}}}`` as two tables."""
    schema = "mti map<string,string>, fields map<string,struct<name:string,description:string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    mti = doc.select(F.explode("mti").alias("code", "description"))
    fields = doc.select(F.explode("fields").alias("number", "f")).select("number", "f.name", "f.description")
    return mti, fields


def field_key(number: Column | str) -> Column:
    """The one spelling of a field number used as a join key: no leading zeros, ``0`` for all zeros."""
    c = F.col(number) if isinstance(number, str) else number
    return F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))


def network_fields(spark: SparkSession) -> DataFrame:
    """Seed of the network specification: ``number, name, length, type_code, format, source``."""
    rows = [(n, name, int(size), kind, enc, fv.NETWORK_SOURCE) for n, name, size, kind, enc in rows_of(fv.NETWORK_FIELDS)]
    return values(spark, rows, "number string, name string, length int, type_code string, format string, source string")


def read_network_fields(spark: SparkSession, path: str) -> DataFrame:
    """A generated network specification (JSON with a ``fields`` object) read back."""
    schema = "fields map<string,struct<name:string,length:int,type_code:string,format:string,source:string>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    return doc.select(F.explode("fields").alias("number", "f")).select("number", "f.*")


def overlay_fields(seed: DataFrame, extracted: DataFrame) -> DataFrame:
    """Seed rows replaced by extracted ones where length or type differ, extracted extras added.

    Extracted rows count only with a length and a type of the known type domain.
    """
    names = ["name", "length", "type_code", "format", "source"]
    good = extracted.filter((F.col("length") > 0) & F.col("type_code").isin(*fv.FIELD_TYPES))
    s = seed.select("number", F.struct(*names).alias("s"))
    e = good.select("number", F.struct(*names).alias("e"))
    differs = F.col("e").isNotNull() & (
        (F.col("s.length") != F.col("e.length")) | (F.col("s.type_code") != F.col("e.type_code"))
    )
    chosen = F.when(F.col("s").isNull() | differs, F.col("e")).otherwise(F.col("s"))
    return s.join(e, "number", "full_outer").select("number", chosen.alias("f")).select("number", "f.*")


def standard_fields(spark: SparkSession) -> DataFrame:
    rows = [(n, name, attributes, fv.STANDARD_SOURCE) for n, name, attributes in rows_of(fv.STANDARD_FIELDS)]
    return values(spark, rows, "number string, name string, attributes string, source string")


def field_reference(spark: SparkSession, network: DataFrame | None = None) -> DataFrame:
    """One definition per field number, the network specification before the standard dictionary.

    ``field_key, field_name, attributes, source, priority``; a fixed-size table.
    """
    net = (network if network is not None else network_fields(spark)).select(
        field_key("number").alias("field_key"),
        F.col("name").alias("field_name"),
        F.format_string("%d %s", "length", "type_code").alias("attributes"),
        F.col("source"),
        F.lit(0).alias("priority"),
    )
    std = standard_fields(spark).select(
        field_key("number").alias("field_key"),
        F.col("name").alias("field_name"),
        "attributes",
        "source",
        F.lit(1).alias("priority"),
    )
    packed = F.struct("priority", "field_name", "attributes", "source")
    best = net.unionByName(std).groupBy("field_key").agg(F.min(packed).alias("d"))
    return best.select("field_key", "d.field_name", "d.attributes", "d.source", "d.priority")


def command_pairs(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``command_code, response_code``; the shipped pairs, or a JSON object ``{command: response}``."""
    if path is None:
        rows = [line.split() for line in fv.COMMAND_RESPONSES.strip().splitlines()]
        return values(spark, rows, "command_code string, response_code string")
    raw = spark.read.text(path, wholetext=True)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,string>")).alias("command_code", "response_code"))
    default = values(spark, [fv.DEFAULT_COMMAND], "command_code string, response_code string")
    return pairs.unionByName(default.join(pairs.select(F.lit(1).alias("__any")).limit(1), F.lit(True), "left_anti"))


def resolve_codes(pairs: DataFrame) -> DataFrame:
    """Both readings of every two-letter code: ``code, target_command, target_response, is_command``.

    A code that is a command wins over the same code read as a response; of several
    commands with one response the last in code order wins.
    """
    forward = pairs.select(
        F.col("command_code").alias("code"),
        F.col("command_code").alias("target_command"),
        F.col("response_code").alias("target_response"),
        F.lit(0).alias("level"),
    )
    inverse = (
        pairs.groupBy(F.col("response_code").alias("code"))
        .agg(F.max("command_code").alias("target_command"))
        .select("code", "target_command", F.col("code").alias("target_response"), F.lit(1).alias("level"))
    )
    packed = F.struct("level", "target_command", "target_response")
    best = forward.unionByName(inverse).groupBy("code").agg(F.min(packed).alias("r"))
    return best.select("code", "r.target_command", "r.target_response", (F.col("r.level") == 0).alias("is_command"))


def hsm_errors(spark: SparkSession, path: str | None = None) -> DataFrame:
    """``code, title, description, meaning, diagnostic_hint, source``; without a file the known codes, untold."""
    schema = "code string, title string, description string, meaning string, diagnostic_hint string, source string"
    if path is None:
        bare = [(c, f"Code HSM {c}", "", "", "", fv.HSM_ERROR_SOURCE) for c in fv.HSM_ERROR_CODES]
        return values(spark, bare, schema)
    entry = "struct<title:string,description:string,meaning:string,error_meaning:string,diagnostic_hint:string,source:string>"
    raw = spark.read.text(path, wholetext=True)
    rows = raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("code", "e"))
    return rows.select(
        "code",
        F.coalesce("e.title", F.concat(F.lit("Code HSM "), F.col("code"))).alias("title"),
        F.coalesce("e.description", F.lit("")).alias("description"),
        F.coalesce(F.nullif("e.meaning", F.lit("")), "e.error_meaning", F.lit("")).alias("meaning"),
        F.coalesce("e.diagnostic_hint", F.lit("")).alias("diagnostic_hint"),
        F.coalesce("e.source", F.lit(fv.HSM_ERROR_SOURCE)).alias("source"),
    )


SPEC_COLUMNS = ("function", "source", "path", "description", "exception")


def clean_specs(rows: DataFrame, position: str = "row_no") -> DataFrame:
    """Function-spec rows trimmed, unnamed rows left out, the last row of a name kept.

    ``spec_no`` is the place of the name's first row: the order in which functions are tried.
    """
    named = rows.filter(blank_to_null("function").isNotNull()).select(
        strip("function").alias("function"),
        *[F.coalesce(strip(c), F.lit("")).alias(c) for c in SPEC_COLUMNS[1:]],
        F.col(position).alias("__at"),
    )
    body = F.struct(*SPEC_COLUMNS[1:])
    return (
        named.groupBy("function")
        .agg(F.max_by(body, "__at").alias("b"), F.min("__at").alias("spec_no"))
        .select("function", "b.*", "spec_no")
    )


def read_function_specs(spark: SparkSession, path: str) -> DataFrame:
    """A function-spec sheet exported as CSV (header row, up to five columns); a missing file is an empty table."""
    schema = ", ".join(f"{c} string" for c in SPEC_COLUMNS)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    if not exists:
        return spark.createDataFrame([], schema + ", spec_no bigint")
    rows = spark.read.schema(schema).csv(path, header=True, multiLine=True, enforceSchema=True)
    return clean_specs(rows.withColumn("row_no", F.monotonically_increasing_id()))
