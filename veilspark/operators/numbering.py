"""Numbering rows 0..n-1 without a window over the whole table.

``number_rows`` numbers rows in the order of a 32-bit hash of their key. Buckets are ranges of that hash: rows are numbered
inside each bucket and the number of rows in earlier buckets is added. How many buckets there are decides only how the work
spreads; the numbers are the same for any, so they depend on the data alone, not on its size or partition layout. ``position_by_key`` does the same in key order, with buckets cut at sampled keys.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions import sqltext

_HEX = 8
ROWS_PER_BUCKET, MIN_BUCKETS, MAX_BUCKETS = 100_000, 1 << 10, 1 << 20
ROWS_PER_RANGE, MIN_RANGES, MAX_RANGES = 1_000_000, 64, 4096
TREE_CUTS = 64


def hashed(text: Column) -> Column:
    """32 bits of a key text: the same in every engine with md5."""
    return F.conv(F.substring(F.md5(text), 1, _HEX), 16, 10).cast("bigint")


def _offsets(bucketed: DataFrame) -> DataFrame:
    """``(__bucket, __rows, __before)``: rows of each bucket and of earlier buckets.

    One row per bucket, so the window without partitions and the broadcast are bounded by the bucket count.
    """
    counts = bucketed.groupBy("__bucket").agg(F.count("*").alias("__rows"))
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))


def _number(bucketed: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Number rows in (bucket, order)."""
    offsets, names = _offsets(bucketed), [c for c in bucketed.columns if c not in ("__bucket", "__hash")]
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    numbered = bucketed.withColumn("__inside", inside).join(F.broadcast(offsets), "__bucket", "left")
    return numbered.select(*names, (F.col("__before") + F.col("__inside") - 1).alias(name))


def bucket_count(rows: int) -> int:
    """Buckets for a table: a power of two that leaves about 100,000 rows in each, between 1024 and a million."""
    wanted = max(1, rows // ROWS_PER_BUCKET)
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (wanted - 1).bit_length()))


def number_rows(df: DataFrame, text: Column, order: Sequence[Column], name: str, buckets: int | None = None) -> DataFrame:
    """Add a dense number in (hash of ``text``, order)."""
    buckets = buckets or bucket_count(df.count())
    placed = df.withColumn("__hash", hashed(text)).withColumn("__bucket", F.shiftright(F.col("__hash") * F.lit(buckets), 4 * _HEX).cast("int"))
    return _number(placed, [F.col("__hash"), *order], name)


def _sort_key(values: tuple) -> tuple:
    """Nulls first, as the table is ordered."""
    return tuple((v is not None, v if v is not None else 0) for v in values)


def cut_points(df: DataFrame, keys: Sequence[str], ranges: int | None = None) -> list[tuple]:
    """Sampled keys that cut a table into ranges of similar size. At most 100 keys per range reach the driver.

    Whole keys are sampled, so a first key column that most rows share is cut by the other columns.
    """
    total = df.count()
    ranges = ranges or min(MAX_RANGES, max(MIN_RANGES, total // ROWS_PER_RANGE))
    wanted = 50 * ranges
    rows = df.select(*keys)
    sample = rows if total <= wanted else rows.sample(fraction=min(1.0, wanted / total), seed=7)
    values = sorted({tuple(row) for row in sample.collect()}, key=_sort_key)
    return sorted({values[len(values) * i // ranges] for i in range(1, ranges)}, key=_sort_key) if values else []


def _tree(below: Callable[[tuple], Column], cuts: Sequence[tuple], first: int = 0) -> Column:
    """Number of the range of a key: a balanced tree of comparisons."""
    if not cuts:
        return F.lit(first)
    middle = len(cuts) // 2
    return F.when(below(cuts[middle]), _tree(below, cuts[:middle], first)).otherwise(
        _tree(below, cuts[middle + 1 :], first + middle + 1)
    )


def range_number(df: DataFrame, keys: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """Number of the range of a row's key, held in ``__key``. Beyond TREE_CUTS cut points the tree finds a group of them and the
    group is searched as an array, so that the expression stays small."""
    kinds = [df.schema[k].dataType for k in keys]
    key = F.col("__key")

    def constant(cut: tuple) -> Column:
        cells = [f"'k{i}', CAST({sqltext.constant(v)} AS {t.simpleString()})" for i, (v, t) in enumerate(zip(cut, kinds))]
        return F.expr(f"named_struct({', '.join(cells)})")

    below = lambda cut: key < constant(cut)
    if len(cuts) <= TREE_CUTS:
        return _tree(below, cuts)
    width = -(-len(cuts) // TREE_CUTS)
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    group = _tree(below, [g[0] for g in groups[1:]])
    listed = F.array(*[F.array(*[constant(c) for c in g]) for g in groups])
    inside = F.size(F.filter(F.get(listed, group), lambda cut: cut <= key))
    return group * F.lit(width) + inside


def _placed(df: DataFrame, keys: Sequence[str], cuts: Sequence[tuple]) -> DataFrame:
    whole_key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    return df.withColumn("__key", whole_key).withColumn("__bucket", range_number(df, keys, cuts)).drop("__key")


def position_by_key(df: DataFrame, keys: Sequence[str], name: str, cuts: Sequence[tuple] | None = None) -> DataFrame:
    """Add the 0-based position of each row in key order, nulls first.

    The cut points decide only how evenly the work spreads; any cut points give the same positions.
    """
    cuts = cut_points(df, keys) if cuts is None else sorted(set(cuts), key=_sort_key)
    return _number(_placed(df, keys, cuts), [F.col(k).asc_nulls_first() for k in keys], name)
