"""Profiling: what columns a table has, which values they span, which types they carry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import sqltext
from veilspark.operators.stacking import stack_rows
from veilspark.sources.scratch import kept, source_mark

# Type names of the catalog: fixed values.
_TYPE_TEXT = {
    T.StringType: "VARCHAR",
    T.LongType: "NUMBER(19,0)",
    T.IntegerType: "INT",
    T.ShortType: "SMALLINT",
    T.DoubleType: "FLOAT",
    T.FloatType: "FLOAT",
    T.BooleanType: "BIT",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampType: "TIMESTAMP",
    T.TimestampNTZType: "TIMESTAMP",
    T.ArrayType: "ARRAY",
}
_SPAN_TYPES = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def type_text(kind: T.DataType) -> str:
    """Catalog name of a type, with precision and scale where it has them."""
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.StructType):
        return "SDO_GEOMETRY" if "gtype" in kind.names else "STRUCT"
    return next((text for known, text in _TYPE_TEXT.items() if isinstance(kind, known)), kind.simpleString().upper())


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def row_count(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``(table_name, n_rows)``."""
    return _union([df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t, df in tables.items()])


CATALOG = ["table_name", "schema_name", "column_name", "column_id", "data_type", "nullable", "n_rows"]


def _nullable(i: int) -> str:
    return f"CASE WHEN __n{i} < __rows THEN 'Y' ELSE 'N' END"


def column_catalog(tables: Mapping[str, DataFrame], schema: str = "") -> DataFrame:
    """One row per column; nullability is measured. One aggregate per table."""

    def one(table: str, df: DataFrame) -> DataFrame:
        fields = df.schema.fields
        counts = df.selectExpr("count(*) AS __rows", *[f"count({sqltext.name(f.name)}) AS __n{i}" for i, f in enumerate(fields)])
        rows = [
            [*[sqltext.text(x) for x in (table, schema, f.name.upper())], str(i + 1), sqltext.text(type_text(f.dataType)), _nullable(i), "__rows"]
            for i, f in enumerate(fields)
        ]
        return stack_rows(counts, rows, CATALOG)

    return _union([one(t, df) for t, df in tables.items()])


def catalog_keys(columns: DataFrame, constraints: DataFrame, key_columns: DataFrame, tables: DataFrame) -> DataFrame:
    """Columns of base tables with the key columns of their table, joined in key order."""
    listed = key_columns.join(constraints.where(F.col("constraint_type") == "PRIMARY KEY"), ["table_name", "constraint_name"]).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("position", "column_name"))).alias("__keys")
    )
    keys = listed.select("table_name", F.array_join(F.transform("__keys", lambda k: k["column_name"]), ",").alias("pk_columns"))
    base = tables.where(F.col("table_type") == "BASE TABLE").select("table_name")
    return columns.join(base, "table_name").join(keys, "table_name", "left").select(
        "table_name", "column_name", "column_id", "data_type", F.coalesce("pk_columns", F.lit("")).alias("pk_columns")
    )


_FLOATS = (T.DoubleType, T.FloatType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def _spans(kind: T.DataType) -> bool:
    return isinstance(kind, _SPAN_TYPES)


def _measures_length(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StringType, T.BinaryType))


def _bounds(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    """One aggregate with row count, non-null counts, min and max (of values or of lengths) of all fields."""
    cells = ["count(*) AS __rows"]
    for i, f in enumerate(fields):
        column = sqltext.name(f.name)
        measured = f"coalesce(length({column}), 0)" if _measures_length(f.dataType) else column
        cells += [f"count({column}) AS __n{i}", f"min({measured}) AS __min{i}", f"max({measured}) AS __max{i}"]
    return df.selectExpr(*cells)


def _bound_text(i: int, f: T.StructField, end: str) -> str:
    """Text of a bound: plain digits for floats, seconds for times."""
    value = f"__{end}{i}"
    if isinstance(f.dataType, _FLOATS):
        value = f"CAST({value} AS DECIMAL(38,6))"
    if isinstance(f.dataType, _TIMES):
        return f"date_format({value}, 'yyyy-MM-dd HH:mm:ss')"
    return f"CAST({value} AS STRING)"


def profile_minmax(table: str, df: DataFrame) -> DataFrame:
    """``(table_name, column_name, min, max)`` of number, time and boolean columns."""
    fields = [f for f in df.schema.fields if _spans(f.dataType)]
    rows = [
        [sqltext.text(table), sqltext.text(f.name.upper()), _bound_text(i, f, "min"), _bound_text(i, f, "max")]
        for i, f in enumerate(fields)
    ]
    return stack_rows(_bounds(df, fields), rows, ["table_name", "column_name", "min", "max"])


def profile_lengths(table: str, df: DataFrame) -> DataFrame:
    """``(table_name, column_name, min_length, max_length)`` of text and binary columns; null has length 0."""
    fields = [f for f in df.schema.fields if _measures_length(f.dataType)]
    rows = [[sqltext.text(table), sqltext.text(f.name.upper()), f"__min{i}", f"__max{i}"] for i, f in enumerate(fields)]
    return stack_rows(_bounds(df, fields), rows, ["table_name", "column_name", "min_length", "max_length"])


PROFILE = [
    "table_name", "schema_name", "column_name", "data_type", "nullable", "column_id", "comments", "pk_constraint", "min", "max",
]


def profile_columns(
    table: str, df: DataFrame, key: Sequence[str] = (), schema: str = "", comments: Mapping[str, str] | None = None
) -> DataFrame:
    """The whole profile of a table from one aggregate."""
    fields, comments = df.schema.fields, comments or {}
    measured = [f for f in fields if _spans(f.dataType) or _measures_length(f.dataType)]
    index = {f.name: i for i, f in enumerate(measured)}
    pk = sqltext.text(",".join(k.upper() for k in key))

    def cells(position: int, f: T.StructField) -> list[str]:
        i, name = index.get(f.name), f.name.upper()
        low, high = ("''", "''") if i is None else (f"coalesce({_bound_text(i, f, end)}, '')" for end in ("min", "max"))
        nullable = "'N'" if i is None else _nullable(i)
        head = [sqltext.text(x) for x in (table, schema, name, type_text(f.dataType))]
        return [*head, nullable, str(position), sqltext.text(comments.get(name, "")), pk, low, high]

    return stack_rows(_bounds(df, measured), [cells(p, f) for p, f in enumerate(fields, 1)], PROFILE)


def profile_tables(
    tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]], schema: str = "", comments: Mapping[str, str] | None = None
) -> DataFrame:
    """The profiles of several tables, one aggregate each. They are written once a session for the same files, so the steps from a profile to a
    configuration read the tables once."""
    spark = next(iter(tables.values())).sparkSession
    mark = (schema, tuple(sorted((comments or {}).items())), tuple((t, tuple(keys.get(t, ())), source_mark(df)) for t, df in tables.items()))
    return kept(spark, mark, "profile", lambda: _union([profile_columns(t, df, keys.get(t, ()), schema, comments) for t, df in tables.items()]))


def swap_bounds(profile: DataFrame) -> DataFrame:
    """Exchange min and max where both are 32-bit whole numbers in the wrong order."""
    low, high = F.col("min").try_cast("int"), F.col("max").try_cast("int")
    wrong = F.coalesce(low > high, F.lit(False))
    return profile.withColumns(
        {"min": F.when(wrong, F.col("max")).otherwise(F.col("min")), "max": F.when(wrong, F.col("min")).otherwise(F.col("max"))}
    )


def with_excluded(profile: DataFrame, excluded: DataFrame) -> DataFrame:
    """Put columns of types left out of profiling back with the bounds ``NULL``."""
    unknown = excluded.withColumns({"min": F.lit("NULL"), "max": F.lit("NULL")})
    return profile.unionByName(unknown.select(*profile.columns)).distinct()


def type_size(data_type: Column) -> Column:
    """The digits that tell the size in a type text: ``VARCHAR2(20 BYTE)`` 20, ``NUMBER(10,2)`` 10."""
    upper = F.upper(data_type)
    inside = F.split_part(data_type, F.lit("("), F.lit(2))
    text = (
        F.when(F.contains(upper, F.lit("NUMBER")), F.split_part(data_type, F.lit(","), F.lit(1)))
        .when(F.contains(upper, F.lit("VARCHAR")), inside)
        .otherwise(data_type)
    )
    return F.regexp_replace(text, r"\D", "")


def is_decimal_text(text: Column) -> Column:
    """A number with a point."""
    return F.coalesce(F.contains(text, F.lit(".")) & text.try_cast("double").isNotNull(), F.lit(False))


def whole_number(text: Column) -> Column:
    """The text as a 64-bit number, 0 when it is none."""
    return F.coalesce(F.when(text.rlike(r"^\s*[-+]?\d+\s*$"), text.try_cast("bigint")), F.lit(0).cast("bigint"))
