"""Shuffling: give each row a value that other rows of the column hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions.draw import Draws, key_text, value_key
from veilspark.operators.numbering import bucket_count, number_rows
from veilspark.plans.rules import Settings
from veilspark.sources.scratch import materialise, pick, sized_for_join


_NESTED = (T.StructType, T.ArrayType)


def value_pool(df: DataFrame, column: str, with_null: bool, buckets: int | None = None) -> DataFrame:
    """The distinct values of a column, numbered: ``(__i, __value)``."""
    buckets = buckets or bucket_count(df.count())
    kind = df.schema[column].dataType
    value = F.col("__value")
    values = df.select(F.col(column).alias("__value"))
    if not with_null:
        values = values.where(value.isNotNull())
    text = value_key(value, kind.simpleString())
    order = [F.col("__text")] if isinstance(kind, _NESTED) else [F.col("__text"), value.asc_nulls_first()]
    distinct = values.distinct().withColumn("__text", text)
    return number_rows(distinct, F.col("__text"), order, "__i", buckets).select("__i", "__value")


def shuffle_column(
    df: DataFrame,
    column: str,
    key: Sequence[str],
    scope: str,
    settings: Settings,
    retain_null: bool = True,
    source: DataFrame | None = None,
) -> DataFrame:
    """Replace each value by a drawn distinct value of the column, other than its own.

    ``source`` may name a DataFrame with the same column that is cheaper to read than ``df``.

    A row draws a number, uniform over the pool, so no number is hot however often one original value occurs. A row that drew its own value
    takes the one after it: from a small pool, which every executor has, by a second look-up; a pool that is shuffled has it in the same
    row, so one join serves all rows.
    """
    values = materialise(value_pool(source if source is not None else df, column, not retain_null, settings.buckets), "pool")
    pool, size, small = sized_for_join(values)
    if size == 0:
        return df
    draws = Draws(settings.seed, scope, key_text(*[F.col(k) for k in key]))
    names, old = df.columns, F.col(column)
    drawn = df.withColumn("__i", draws(0) % F.lit(size))
    own = F.col("__value").eqNullSafe(old)
    if small:
        other = pool.select(F.col("__i").alias("__j"), F.col("__value").alias("__next"))
        drawn = drawn.join(pool, "__i", "left")
        drawn = drawn.join(other, F.when(own, (F.col("__i") + 1) % F.lit(size)) == F.col("__j"), "left")
    else:
        after = values.select(F.pmod(F.col("__i") - 1, F.lit(size)).alias("__i"), F.col("__value").alias("__next"))
        drawn = pick(drawn, materialise(values.join(after, "__i"), "pool"), "__i", size, small, draws(1))
    picked = F.when(own, F.col("__next")).otherwise(F.col("__value"))
    if retain_null:
        picked = F.when(old.isNotNull(), picked)
    return drawn.select(*[picked.alias(n) if n == column else F.col(n) for n in names])
