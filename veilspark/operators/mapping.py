"""Consistent replacement of keys across tables: a keyed permutation of the keys' own domain, and joins with tables of keys that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.draw import key_text
from veilspark.functions.permute import permuted, permuted_text
from veilspark.plans.rules import RuleError, Settings
from veilspark.sources.scratch import materialise

# A key is hot when more than one row in HOT_SHARE holds it; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys held by more than 1/HOT_SHARE of the rows: fewer than HOT_SHARE of them, so a broadcast is safe."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count("*").alias("__rows"))
    total = df.agg(F.count("*")).scalar()
    return counts.where(F.col("__rows") * HOT_SHARE > total).select("__hot")


def lookup(df: DataFrame, key: str, table: DataFrame, table_key: str, row_text: Column) -> DataFrame:
    """Left join ``df`` with a table that has one row per key.

    The table's rows of hot keys are broadcast, so no key has to fit a task. Rows that are answered so, and those of the null key, go over the
    shuffle by a text of the row and match nothing there. No row is lost.
    """
    names = [c for c in table.columns if c != table_key]
    hot = materialise(table.join(F.broadcast(hot_keys(df, key)), F.col(table_key) == F.col("__hot"), "left_semi"), "hot-keys")
    marked = lambda t, as_key, mark: t.select(F.col(table_key).alias(as_key), *[F.col(n).alias(mark + n) for n in names])
    known = df.join(F.broadcast(marked(hot, "__hot", "__hot_")), F.col(key) == F.col("__hot"), "left")
    # Two columns, so that a row's text is never taken for a key.
    known = known.withColumn("__key", F.when(F.col("__hot").isNull(), F.col(key))).withColumn("__row", F.when(F.col("__key").isNull(), row_text).otherwise(F.lit("")))
    rest = marked(table, "__of", "__of_").where(F.col("__of").isNotNull()).withColumn("__none", F.lit(""))
    joined = known.join(rest, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__row") == F.col("__none")), "left")
    value = lambda n: F.when(F.col("__hot").isNotNull(), F.col(f"__hot_{n}")).otherwise(F.col(f"__of_{n}")).alias(n)
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], *[value(n) for n in names])


def mapped_key(value: Column, kind: T.DataType, scope: str, settings: Settings, low: int = 0, size: int = 10**15, base: int = 0) -> Column:
    """The after value of a key: an expression of the key alone, so it needs no table, no join and no other keys.

    Whole numbers from ``base`` on are permuted within ``size`` numbers and begin at ``low``; a key outside of them ends the job. Text
    keeps its form: letters and digits are permuted within their classes.
    """
    if isinstance(kind, T.StringType):
        return permuted_text(value, settings.seed, scope)
    _whole(kind, scope)
    return F.lit(low) + permuted(value.cast("bigint") - F.lit(base), size, settings.seed, scope)


def _whole(kind: T.DataType, scope: str) -> None:
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise RuleError(f"{scope}: keys of type {kind.simpleString()} cannot be mapped")


def correlation_table(keys: DataFrame, key: str, scope: str, settings: Settings, low: int, size: int, base: int = 0) -> DataFrame:
    """``(before, after)`` for the distinct keys of a column; the after values are unique, and more keys change none of them.

    Whole numbers outside of the ``size`` numbers from ``base`` on are an error before anything is written.
    """
    column, kind = F.col(key), keys.schema[key].dataType
    if not isinstance(kind, T.StringType):
        least, most = keys.agg(F.min(column), F.max(column)).first()
        if least is not None and (least < base or most >= base + size):
            raise RuleError(f"{key}: keys from {least} to {most} need unique values, {size} are given from {base} on")
    distinct = keys.select(column.alias("before")).where(F.col("before").isNotNull()).distinct()
    return distinct.select("before", mapped_key(F.col("before"), kind, scope, settings, low, size, base).alias("after"))


def apply_key_map(df: DataFrame, key: str, scope: str, settings: Settings, low: int, size: int, base: int = 0) -> DataFrame:
    """The table with a key column replaced by its after values, as ``correlation_table`` lists them: one projection."""
    kind = df.schema[key].dataType
    value = mapped_key(F.col(key), kind, scope, settings, low, size, base).cast(kind)
    return df.select(*[value.alias(n) if n == key else F.col(n) for n in df.columns])


def apply_correlation(df: DataFrame, key: str, table: DataFrame, row_key: Sequence[str]) -> DataFrame:
    """Replace a key column by its after value; keys the table does not know keep their value."""
    joined = lookup(df, key, table, "before", key_text(*[F.col(k) for k in row_key]))
    value = F.coalesce(F.col("after"), F.col(key)).cast(df.schema[key].dataType)
    return joined.select(*[value.alias(n) if n == key else F.col(n) for n in df.columns])
