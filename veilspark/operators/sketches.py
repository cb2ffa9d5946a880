"""Profiles that add up: one row of measures and sketches per file, kept beside the table; a later profile reads the new files only.

Per file and column: rows, values, least, greatest, a sketch of the distinct values (HyperLogLog, 2**15 registers: within about 0.6 %) and,
for numbers, one of the quantiles. All of them merge, so the profile of the table is one aggregate over as many rows as there are files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import sqltext
from veilspark.operators.profile import _bound_text, _measures_length, _spans
from veilspark.operators.stacking import stack_rows
from veilspark.sources.scratch import exists

REGISTERS = 15
QUARTILES = (0.25, 0.5, 0.75)
PROFILE = ["table_name", "column_name", "n_rows", "n_values", "min", "max", "n_distinct", "quartiles"]


def _measured(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields if _spans(f.dataType) or _measures_length(f.dataType)]


def _hashable(name: str, kind: T.DataType) -> Column:
    return F.col(f"`{name}`") if isinstance(kind, (T.IntegerType, T.LongType, T.StringType, T.BinaryType)) else F.col(f"`{name}`").cast("string")


def _per_file(df: DataFrame) -> DataFrame:
    """One row per file: its name, its rows, and the measures of each column."""
    cells = [F.count("*").alias("rows")]
    for i, f in enumerate(_measured(df.schema)):
        column = F.col(f"`{f.name}`")
        measured = F.coalesce(F.length(column), F.lit(0)) if _measures_length(f.dataType) else column
        cells += [F.count(column).alias(f"n{i}"), F.min(measured).alias(f"min{i}"), F.max(measured).alias(f"max{i}"), F.hll_sketch_agg(_hashable(f.name, f.dataType), REGISTERS).alias(f"hll{i}")]
        if isinstance(f.dataType, T.NumericType):
            cells.append(F.kll_sketch_agg_double(column.cast("double")).alias(f"kll{i}"))
    return df.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("changed")).agg(*cells)


def update_profile(df: DataFrame, store: str) -> int:
    """Profile the files of a table that the store does not know yet, and return how many there were."""
    spark = df.sparkSession
    files = set(df.inputFiles())
    known = {r["file"] for r in spark.read.parquet(store).select("file").collect()} if exists(spark, store) else set()
    plain = lambda name: name.replace("file:///", "file:/")
    known = {plain(k) for k in known}
    new = sorted(f for f in files if plain(f) not in known)
    if new:
        _per_file(spark.read.schema(df.schema).parquet(*new)).write.mode("append").parquet(store)
    return len(new)


def profile_sketches(table: str, df: DataFrame, store: str) -> DataFrame:
    """The profile of a table from the sketches of its files: new files are read, the others are not opened, gone ones do not count."""
    update_profile(df, store)
    spark, fields = df.sparkSession, _measured(df.schema)
    here = spark.createDataFrame([(f.replace("file:///", "file:/"),) for f in df.inputFiles()], "here string")
    kept = spark.read.parquet(store).join(F.broadcast(here), F.replace("file", F.lit("file:///"), F.lit("file:/")) == F.col("here"), "left_semi")
    merged = [F.sum("rows").alias("__rows")]
    for i, f in enumerate(fields):
        merged += [F.sum(f"n{i}").alias(f"__n{i}"), F.min(f"min{i}").alias(f"__min{i}"), F.max(f"max{i}").alias(f"__max{i}"), F.hll_sketch_estimate(F.hll_union_agg(f"hll{i}")).alias(f"__d{i}")]
        if isinstance(f.dataType, T.NumericType):
            merged.append(F.kll_merge_agg_double(f"kll{i}").alias(f"__kll{i}"))
    one = kept.agg(*merged)
    for i, f in enumerate(fields):
        if isinstance(f.dataType, T.NumericType):
            at = F.kll_sketch_get_quantile_double(f"__kll{i}", F.array(*[F.lit(q) for q in QUARTILES]))
            # Cells of one column are of one type, which for arrays says whether an element can be null.
            one = one.withColumn(f"__q{i}", F.when(F.col(f"__n{i}") > 0, F.transform(at, lambda q: F.when(~F.isnan(q), q))))
        else:
            one = one.withColumn(f"__q{i}", F.lit(None).cast("array<double>"))
    text = lambda i, f, end: f"CAST(__{end}{i} AS STRING)" if _measures_length(f.dataType) else _bound_text(i, f, end)
    rows = [[sqltext.text(table), sqltext.text(f.name.upper()), "__rows", f"__n{i}", text(i, f, "min"), text(i, f, "max"), f"__d{i}", f"__q{i}"] for i, f in enumerate(fields)]
    return stack_rows(one, rows, PROFILE)


def single_valued(profile: DataFrame) -> DataFrame:
    """Columns with one value at most: a mask by shuffling would leave them as they are."""
    return profile.where("n_distinct <= 1").select("table_name", "column_name")
