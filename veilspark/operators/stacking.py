"""Turning one wide aggregate row into one row per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from veilspark.functions import sqltext


def stack_rows(df: DataFrame, rows: Sequence[Sequence[str]], names: Sequence[str]) -> DataFrame:
    """One output row per element of ``rows`` for each input row; cells are SQL text."""
    cells = ", ".join(cell for row in rows for cell in row)
    listed = ", ".join(sqltext.name(n) for n in names)
    return df.selectExpr(f"stack({len(rows)}, {cells}) AS ({listed})")
