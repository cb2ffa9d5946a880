"""Scans: key first, the configured columns only, whole tables, first rows, row ranges, pages."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.keyindex import ROWS_PER_RANGE, KeyIndex, slice_of
from veilspark.plans.rules import TableRule

# Rows up to which the first-rows scan keeps a sorted head per task instead of numbering the table.
TOP_ROWS = 100_000
# Rows of a page unless told otherwise: fixed value.
PAGE_ROWS = 100_000


def scan_columns(df: DataFrame, rule: TableRule) -> DataFrame:
    """The key and the configured columns; the file reader skips the rest."""
    names = [r.name for r in rule.columns if r.name not in rule.key]
    return df.select(*rule.key, *names)


def scan_limit(df: DataFrame, key: Sequence[str], count: int) -> DataFrame:
    """The first rows by key, in key order. Up to TOP_ROWS rows each task keeps a sorted head; more are found by position and sorted."""
    if count <= TOP_ROWS:
        return df.orderBy(*key).limit(count)
    return scan_row_range(df, key, 1, count).orderBy(*key)


def scan_row_range(df: DataFrame, key: Sequence[str], first: int, last: int, index: KeyIndex | None = None) -> DataFrame:
    """Rows first..last by key, 1-based and inclusive. The table's key histogram (built once a session unless one is given) tells which keys
    and files these are; an offset and limit would pull everything before the range through one task."""
    if index is None and len(df.inputFiles()) <= 1 and df.count() <= ROWS_PER_RANGE:
        # One file of no more rows than a range has: its rows are sorted as those of a range are.
        return df.orderBy(*key).offset(first - 1).limit(max(0, last - first + 1))
    return slice_of(df, index or KeyIndex.of(df, key), first - 1, last - 1)


def scan_page(df: DataFrame, key: Sequence[str], page: int, fetch: int = PAGE_ROWS, index: KeyIndex | None = None) -> DataFrame:
    """Page 0, 1, ... of ``fetch`` rows by key."""
    return scan_row_range(df, key, page * fetch + 1, (page + 1) * fetch, index)


def scan_rows(df: DataFrame, rule: TableRule) -> DataFrame:
    """The rows a table rule asks for: all of them, ``N`` or ``a-b``."""
    text = (rule.row_count or "").strip()
    if span := re.fullmatch(r"(\d+)\s*-\s*(\d+)", text):
        return scan_row_range(df, rule.key, int(span[1]), int(span[2]))
    return scan_limit(df, rule.key, int(text)) if text.isdigit() else df


def flatten_rows(df: DataFrame, lists: str) -> DataFrame:
    """Repeat a parent once per child list and spread the first record of each list into columns.

    ``lists`` is an array of arrays of structs. A parent without child lists stays as one row.
    """
    parents = [c for c in df.columns if c != lists]
    record = df.schema[lists].dataType.elementType.elementType
    rows = df.select(*parents, F.posexplode_outer(lists).alias("list_no", "__list"))
    first = F.get(F.col("__list"), F.lit(0))
    return rows.select(*parents, "list_no", *[first[f].alias(f) for f in record.names])
