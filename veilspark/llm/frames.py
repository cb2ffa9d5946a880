"""Frames that every operator here starts from, and Arrow helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StructType


def picked(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that other columns cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in columns.items()])


# Rows of an Arrow batch: with texts of some kilobytes the usual 10,000 are tens of megabytes, held several times on both sides of the pipe.
BATCH_ROWS = 2000
_ROWS_CONF, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def small_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has a size of its own."""
    if spark.conf.get(_ROWS_CONF, _ROWS_DEFAULT) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_CONF, str(BATCH_ROWS))


def per_batch(df: DataFrame, schema: str | StructType, make: Callable[[pa.RecordBatch], dict | None]) -> DataFrame:
    """One output batch for each Arrow batch; `make` returns the columns by name."""
    names = StructType.fromDDL(schema).names if isinstance(schema, str) else schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = make(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in map(columns.get, names)], names)

    return df.mapInArrow(run, schema)


def drawn(column: str, salt: str, *more: str) -> Column:
    """A number in [0, 1) by hash of a column (and others), in steps fine enough for a share of any table."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column).cast("string"), F.lit(salt), *more), 11) / F.lit(float(1 << 53))


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column."""
    return df.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0


def joined(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


HEAVY_SHARE = 1024


def heavy_keys(table: DataFrame, rows: str) -> DataFrame:
    """Rows of a table with one row per key whose key holds more than 1/HEAVY_SHARE of all: fewer than HEAVY_SHARE, whatever the data."""
    total = table.agg(F.sum(rows)).first()[0] or 0
    return table.where(F.col(rows) > total / HEAVY_SHARE)


def looked_up(df: DataFrame, key: str, table: DataFrame, table_key: str, heavy: DataFrame, spread: Column, **columns: str) -> DataFrame:
    """Columns (new name = old name) of the row of `table` with this key, null if there is none. Heavy keys, a part of the table, come from a
    broadcast list; rows so answered, and those without a key, go over the shuffle by `spread`, so that no key is hot. `spread` is of the
    type of the key and differs from row to row; what it matches is not looked at."""
    taken = lambda t, as_key, mark: t.select(F.col(table_key).alias(as_key), *[F.col(old).alias(mark + new) for new, old in columns.items()])
    known = df.join(F.broadcast(taken(heavy, "__hot", "__hot_")), F.col(key) == F.col("__hot"), "left").withColumn("__any", spread)
    known = known.withColumn("__key", F.when(F.col("__hot").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.col("__any")))
    known = known.join(taken(table, "__word", "__word_"), F.col("__key") == F.col("__word"), "left")
    value = lambda c: F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{c}")).when(F.col(key).isNotNull(), F.col(f"__word_{c}"))
    return known.select(*[F.col(f"`{c}`") for c in df.columns], *[value(c).alias(c) for c in columns])


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns of a row: equal rows have the same. Nulls are told by a mask, as the hash skips them."""
    cells, nulls = [], []
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        nulls.append(F.when(cell.isNull(), "1").otherwise("0"))
        # A map has no hash of its own.
        cells.append(F.to_json(cell) if isinstance(field.dataType, MapType) else cell)
    half = lambda salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), F.concat(*nulls), *cells)), 16, "0")
    return F.unhex(F.concat(half(1), half(2)))
