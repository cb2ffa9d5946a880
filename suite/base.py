"""Registry of queries and their SQL, and short-hands both sides use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, Settings, TableRule

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SETTINGS = Settings()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def mask_query(
    name: str, table: str, key: str | tuple[str, ...], rules: list[ColumnRule], sql: str, derive: list[str] | None = None,
    keep_types: bool = False, output: list[str] | None = None,
) -> None:
    """A query that masks ``derive``d columns of a table and returns key and masked columns."""
    keys = (key,) if isinstance(key, str) else key

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = read(spark, sf_dir, table)
        df = df.selectExpr(*derive) if derive else df
        return mask_table(df, TableRule(table, keys, tuple(rules)), SETTINGS, keep_types).selectExpr(*(output or df.columns))

    QUERIES[name] = run
    ORACLES[name] = sql
