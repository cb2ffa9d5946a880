"""Intermediate tables in the folder the cluster names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilspark.sources.scratch import materialise


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows as a Parquet table: lineage ends, lost executors cost nothing, several readers share one computation. The process deletes
    its tables when it ends."""
    return materialise(df, label)
