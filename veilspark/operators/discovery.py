"""Keys found in the data: the least sets of columns that tell all rows apart, and columns whose values are all keys of another table.

Sets are tried level by level, as a set that holds a key is none of the least. A set is tested only if its distinct values, by sketch, can be as
many as there are rows; all sketches of a level come from one look at the table. What is left is tested exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTERS = 14
# A sketch of 2**14 registers is nine times out of ten within 1.3 %; a set whose estimate is lower than this share of the rows is no key.
LEAST_SHARE = 0.92
_KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.DecimalType, T.TimestampType, T.TimestampNTZType)
# Sets whose sketches are made at one look.
SETS_AT_ONCE = 200


def _key_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _KEY_TYPES)]


def _distinct(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """Estimated distinct values of sets of columns without nulls."""
    out: dict = {}
    for low in range(0, len(sets), SETS_AT_ONCE):
        some = sets[low : low + SETS_AT_ONCE]
        row = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*[F.col(f"`{c}`") for c in s]), REGISTERS)).alias(f"s{i}") for i, s in enumerate(some)]).first()
        out |= {s: row[f"s{i}"] for i, s in enumerate(some)}
    return out


def is_key(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no two rows share these columns and none of them is null: exactly."""
    names = [F.col(f"`{c}`") for c in columns]
    broken = df.groupBy(*names).agg(F.count("*").alias("__n")).where((F.col("__n") > 1) | F.greatest(*[n.isNull() for n in names], F.lit(False)))
    return broken.limit(1).count() == 0


def discover_keys(df: DataFrame, largest: int = 2, columns: Sequence[str] | None = None) -> list[tuple[str, ...]]:
    """The least sets of at most ``largest`` columns that tell the rows apart. A table without rows has none."""
    rows = df.count()
    names = list(columns or _key_columns(df))
    if not rows or not names:
        return []
    full = df.agg(*[F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).first()
    names = [c for i, c in enumerate(names) if full[f"c{i}"] == rows]
    keys: list[tuple[str, ...]] = []
    single: dict[str, int] = {}
    for size in range(1, largest + 1):
        sets = [s for s in combinations(names, size) if not any(set(k) <= set(s) for k in keys)]
        # Not more values than the product of those of the columns, each a little more than its estimate.
        sets = [s for s in sets if size == 1 or _product(single[c] * 1.1 for c in s) >= rows]
        found = _distinct(df, sets) if sets else {}
        if size == 1:
            single = {s[0]: n for s, n in found.items()}
        keys += [s for s in sets if found[s] >= LEAST_SHARE * rows and is_key(df, s)]
    return keys


def _product(values) -> float:
    out = 1.0
    for v in values:
        out *= v
    return out


def key_report(tables: Mapping[str, DataFrame], largest: int = 2) -> DataFrame:
    """``(table_name, key_columns, n_columns)``: the least keys of each table. One row per key, no data."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, ",".join(k), len(k)) for t, df in tables.items() for k in discover_keys(df, largest)]
    return spark.createDataFrame(rows, "table_name string, key_columns string, n_columns int")


def _family(kind: T.DataType) -> str:
    return "whole" if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)) else kind.simpleString()


def discover_references(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(child_table, child_column, parent_table, parent_column, n_values, same_name)``: columns all of whose values are in a key column of
    another table. A pair is tested only if the child's span lies within the parent's; the test is exact."""
    spark = next(iter(tables.values())).sparkSession
    spans = {}
    for table, df in tables.items():
        names = _key_columns(df)
        row = df.agg(*[x for i, c in enumerate(names) for x in (F.min(f"`{c}`").alias(f"a{i}"), F.max(f"`{c}`").alias(f"b{i}"))]).first() if names else {}
        spans |= {(table, c): (row[f"a{i}"], row[f"b{i}"], _family(df.schema[c].dataType)) for i, c in enumerate(names)}
    found = []
    for (child, column), (low, high, family) in spans.items():
        for parent, key in [(t, k) for t, ks in keys.items() for k in ks]:
            if parent == child or low is None:
                continue
            least, most, other = spans[parent, key]
            if family != other or least is None or low < least or high > most:
                continue
            values = tables[child].select(F.col(f"`{column}`").alias("v")).where("v IS NOT NULL").distinct()
            held = tables[parent].select(F.col(f"`{key}`").alias("v"))
            if values.join(held, "v", "left_anti").limit(1).count() == 0:
                found.append((child, column, parent, key, values.count(), column.split("_")[-1] == key.split("_")[-1]))
    return spark.createDataFrame(found, "child_table string, child_column string, parent_table string, parent_column string, n_values long, same_name boolean")
