"""Text files: separated values, rule sheets, configuration files, address books."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.plans.rules import RULE_TYPES, ColumnRule, TableRule

# Separators a file may use, in order of preference: fixed values.
SEPARATORS = [",", ";", "\t", "|", "#"]
# Windows code page 1252 differs from Latin 1 in these places: the controls of Latin 1, and what the code page has there.
_CODE_PAGE = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("windows-1252")
_CONTROLS = _CODE_PAGE.encode("windows-1252").decode("latin-1")

# Columns of a rule sheet with the name they get here and their default: fixed values.
SHEET_COLUMNS = {
    "TABLE_NAME": ("table_name", ""),
    "COLUMN_NAME": ("column_name", ""),
    "ROW_COUNT": ("row_count", "max"),
    "DATA_TYPE": ("data_type", ""),
    "NULLABLE": ("nullable", ""),
    "COLUMN_ID": ("column_id", "0"),
    "COMMENTS": ("comments", ""),
    "Description": ("description", ""),
    "PKconstraintName": ("pk_constraint", ""),
    "SCHEMA": ("schema_name", ""),
    "TARGETSCHEMA": ("target_schema", ""),
    "Retain NULL": ("retain_null", "TRUE"),
    "RetainEmptyString": ("retain_empty", "FALSE"),
    "Preview": ("preview", "FALSE"),
    "Min": ("min", ""),
    "max": ("max", ""),
    "Masking Rule": ("masking_rule", ""),
    "Rule set by": ("rule_set_by", ""),
    "Rule Reasoning": ("rule_reasoning", ""),
    "COMPLETED": ("completed", ""),
    "StringFormat": ("string_format", ""),
    "UseValue": ("use_value", ""),
}

# Fields of a column in a configuration file with their type and default: fixed values.
CONFIG_FIELDS = {
    "type": ("string", "None"),
    "ignore": ("boolean", False),
    "unmask": ("boolean", False),
    "min": ("string", None),
    "max": ("string", None),
    "stringFormatPattern": ("string", None),
    "useValue": ("string", None),
    "useGenderColumn": ("string", None),
    "operator": ("string", None),
    "preview": ("boolean", False),
    "retainNullValues": ("boolean", True),
    "retainEmptyStringValues": ("boolean", False),
    "useLocalValueMappings": ("boolean", False),
    "useGlobalValueMappings": ("boolean", False),
    "unique": ("boolean", False),
    "separator": ("string", None),
}


def detect_separator(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The separator that occurs most often in the heading line."""
    head = spark.read.text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))


def other_encoding(spark: SparkSession, path: str | Sequence[str]) -> tuple[list[str], list[str]]:
    """The files that are UTF-8, and those with a line that is not. One look at the bytes; one name per file reaches the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"))
    found = {r["file"]: r["valid"] for r in lines.groupBy("file").agg(F.bool_and("valid").alias("valid")).collect()}
    return sorted(f for f, v in found.items() if v), sorted(f for f, v in found.items() if not v)


def _code_page(text: Column) -> Column:
    """Text read byte by byte, with the characters that the code page has in place of controls."""
    return F.translate(text, _CONTROLS, _CODE_PAGE)


def scan_csv(spark: SparkSession, path: str | Sequence[str], schema: str | None = None, encoding: str | None = None) -> DataFrame:
    """Text files with a heading; the separator is detected, all columns are text unless a schema is given.

    Without an encoding each file is UTF-8, or, if a line of it is not, of the Windows code page of western Europe; a folder may hold both.
    """
    def read(files, charset: str) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", detect_separator(spark, files)).option("encoding", charset)
        return (reader.schema(schema) if schema else reader).csv(files)

    if encoding:
        return read(path, encoding)
    plain, others = other_encoding(spark, path)
    if not others:
        return read(path, "UTF-8")
    old = read(others, "ISO-8859-1")
    table = str.maketrans(_CONTROLS, _CODE_PAGE)
    text = {f.name for f in old.schema.fields if isinstance(f.dataType, T.StringType)}
    old = old.select(*[(_code_page(F.col(f"`{c}`")) if c in text else F.col(f"`{c}`")).alias(c.translate(table)) for c in old.columns])
    return read(plain, "UTF-8").unionByName(old, allowMissingColumns=True) if plain else old


def normalize_headers(df: DataFrame) -> DataFrame:
    """Runs of other characters in column names become one underscore; empty text becomes null."""
    cleaned = df.toDF(*[re.sub(r"[^a-zA-Z0-9_.]+", "_", c) for c in df.columns])
    text = {f.name for f in cleaned.schema.fields if isinstance(f.dataType, T.StringType)}
    name = lambda c: F.col(f"`{c}`")
    return cleaned.select(*[F.nullif(name(c), F.lit("")).alias(c) if c in text else name(c) for c in cleaned.columns])


def export_csv(df: DataFrame, path: str) -> None:
    """Heading, every field quoted, commas."""
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def rule_sheet(df: DataFrame) -> DataFrame:
    """Rule sheet columns under their names here; missing columns and nulls get the defaults."""
    present = {c.lower(): c for c in df.columns}

    def cell(source: str, name: str, default: str):
        if source.lower() not in present:
            return F.lit(default).alias(name)
        return F.coalesce(F.col(f"`{present[source.lower()]}`").cast("string"), F.lit(default)).alias(name)

    return df.select(*[cell(source, name, default) for source, (name, default) in SHEET_COLUMNS.items()])


def config_columns(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured column of JSON configuration files, with the declared defaults."""
    fields = [T.StructField("name", T.StringType())]
    fields += [T.StructField(f, T._parse_datatype_string(kind)) for f, (kind, _) in CONFIG_FIELDS.items()]
    fields.append(T.StructField("sourceColumns", T.ArrayType(T.StringType())))
    fields.append(T.StructField("valueMappings", T.MapType(T.StringType(), T.StringType())))
    table = T.StructType(
        [
            T.StructField("name", T.StringType()), T.StructField("primaryKeyColumn", T.StringType()),
            T.StructField("schema", T.StringType()), T.StructField("targetSchema", T.StringType()),
            T.StructField("rowCount", T.StringType()), T.StructField("columns", T.ArrayType(T.StructType(fields))),
        ]
    )
    schema = T.StructType([T.StructField("tables", T.ArrayType(table))])
    tables = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("tables").alias("t"))
    rows = tables.select("t", F.posexplode("t.columns").alias("position", "c"))
    return rows.select(
        F.col("t.name").alias("table_name"),
        F.col("t.primaryKeyColumn").alias("primary_key"),
        F.col("c.name").alias("column_name"),
        (F.col("position") + 1).alias("position"),
        *[F.coalesce(F.col(f"c.{f}"), F.lit(default).cast(kind)).alias(f) for f, (kind, default) in CONFIG_FIELDS.items()],
        F.col("c.sourceColumns").alias("sourceColumns"),
        F.coalesce("c.valueMappings", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("valueMappings"),
    ).withColumn("type", _known_type(F.col("type")))


def _known_type(name: Column) -> Column:
    """The canonical rule type; an unknown one stops the job."""
    listed = F.create_map(*[F.lit(x) for t in RULE_TYPES for x in (t.lower(), t)])
    return F.coalesce(F.try_element_at(listed, F.lower(F.trim(name))), F.raise_error(F.concat(F.lit("unknown rule type "), name)))


def load_config(spark: SparkSession, path: str) -> list[TableRule]:
    """Table rules of a JSON configuration file; field names are matched without regard to case.

    A configuration is as small as the schema it describes; it is read whole.
    """
    text = spark.read.text(path, wholetext=True).first()[0]
    document = json.loads(text.lstrip("\ufeff"), object_pairs_hook=lambda pairs: {k.lower(): v for k, v in pairs})
    return [_table_rule(table) for table in document["tables"]]


def _table_rule(table: dict) -> TableRule:
    key = tuple(k.strip() for k in (table.get("primarykeycolumn") or "").split(",") if k.strip())
    rows = table.get("rowcount")
    return TableRule(
        table["name"], key, tuple(_column_rule(c) for c in table.get("columns", [])), None if rows is None else str(rows),
        table.get("schema") or "", table.get("targetschema") or "",
    )


def _column_rule(column: dict) -> ColumnRule:
    def value(field: str):
        default = CONFIG_FIELDS[field][1]
        found = column.get(field.lower())
        return default if found is None else found

    def text(field: str) -> str | None:
        found = value(field)
        return None if found in (None, "") else str(found)

    return ColumnRule(
        column["name"], value("type"), ignore=value("ignore"), unmask=value("unmask"), min=text("min"), max=text("max"),
        pattern=text("stringFormatPattern"), use_value=text("useValue"), preview=value("preview"), operator=text("operator"),
        retain_null=value("retainNullValues"), retain_empty=value("retainEmptyStringValues"),
        value_mappings=column.get("valuemappings") or {}, local_mapping=value("useLocalValueMappings"),
        global_mapping=value("useGlobalValueMappings"), unique=value("unique"), gender_column=text("useGenderColumn"),
        separator=value("separator"), source_columns=tuple(column.get("sourcecolumns") or ()),
    )


def address_book(spark: SparkSession, paths: str | Sequence[str], coordinates: bool = False) -> DataFrame:
    """Address records ``(city_pcs, full_addr)`` out of many address-book files, with latitude and longitude if they are wanted."""
    more = [F.col(c).try_cast("double").alias(c) for c in ("latitude", "longitude")] if coordinates else []
    return spark.read.option("header", True).csv(paths).select("city_pcs", "full_addr", *more).where(F.col("full_addr").isNotNull())
