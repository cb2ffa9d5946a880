"""Masks on streams: most look at one row at a time and keep no state, so a stream is masked by the same projection as a table; unique
values are numbers kept by key in a log that grows with the batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from veilspark.plans.mask import mask_table
from veilspark.plans.rules import RuleError, Settings, TableRule

# Rule types that need the whole column.
_WHOLE_COLUMN = {"Shuffle", "ShufflePolygon"}


def _checked(rule: TableRule, unique: bool) -> None:
    for r in rule.columns:
        mapped = r.local_mapping or r.global_mapping
        if not r.ignore and (r.type in _WHOLE_COLUMN or r.unique and not mapped and not unique):
            raise RuleError(f"{r.name}: {r.type if r.type in _WHOLE_COLUMN else 'unique values'} need the whole column, not a stream")


def mask_stream(df: DataFrame, rule: TableRule, settings: Settings = Settings()) -> DataFrame:
    """The masked stream; rules that need the whole column (shuffles, unique values that are no mapped keys) are an error."""
    _checked(rule, unique=False)
    return mask_table(df, rule, settings)


def write_masked_stream(df: DataFrame, rule: TableRule, target: str, settings: Settings = Settings(), available_now: bool = True) -> StreamingQuery:
    """Write a stream masked, unique values too, below ``target``; ``masked_rows`` reads what is there.

    Each micro-batch is a folder of its own, written over if the batch comes again, and the numbers of unique values are given once for
    each key (``AssignmentLog``, state that outlives the query). So a query that was stopped anywhere and is started again on the same
    target gives the rows it would have given in one run: it goes on where its checkpoint ends, no row is written twice, and a key that
    comes again in a later batch keeps its value.
    """
    _checked(rule, unique=True)
    root = target.rstrip("/")
    held = replace(settings, assignments=settings.assignments or f"{root}/_assignments")

    def put(batch: DataFrame, number: int) -> None:
        mask_table(batch, rule, held).write.mode("overwrite").parquet(f"{root}/rows/batch={number:09d}")

    writer = df.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/_checkpoint")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def masked_rows(spark: SparkSession, target: str) -> DataFrame:
    """The rows that a stream has written."""
    return spark.read.parquet(f"{target.rstrip('/')}/rows").drop("batch")
