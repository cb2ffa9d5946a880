"""Numbers given to keys once and for all: a log that only grows, one version for each delivery of a table.

The log is a folder of versions, each a table of the keys that were new in a delivery and their numbers. Keys of a delivery that the log
lacks get the numbers after those given, in the order of a hash of the key, and become the next version; a version counts from the moment
its marker is written, so a job that dies leaves no number behind. What was given is never changed: the values of a first delivery stand
whatever comes later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions.draw import key_text
from veilspark.operators.numbering import bucket_count, number_rows
from veilspark.plans.rules import RuleError
from veilspark.sources.scratch import hadoop_path

_DONE = "_given"


class AssignmentLog:
    """The numbers given to the keys of one column of one table."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _place(self, name: str):
        return hadoop_path(self.spark, f"{self.folder}/{name}" if name else self.folder)

    def versions(self) -> list[str]:
        """Folders of the versions that count, in order."""
        place, files = self._place("")
        if not files.exists(place):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(place) if s.isDirectory())
        return [f"{self.folder}/{n}" for n in names if files.exists(self._place(f"{n}/{_DONE}")[0])]

    def given(self) -> DataFrame | None:
        """All keys (k0, k1, ...) with their numbers n."""
        found = self.versions()
        return self.spark.read.parquet(*found) if found else None

    def extended(self, df: DataFrame, key: Sequence[str], capacity: int | None = None, buckets: int | None = None) -> DataFrame:
        """The log with the keys of a table in it. More keys than numbers are an error before any is given."""
        names = [f"k{i}" for i in range(len(key))]
        keys = df.select(*[F.col(k).alias(n) for k, n in zip(key, names)]).distinct()
        known = self.given()
        new = keys if known is None else keys.join(known.select(*[F.col(n).alias(f"_{n}") for n in names]), _same(names), "left_anti")
        before = 0 if known is None else known.agg(F.coalesce(F.max("n") + 1, F.lit(0))).first()[0]
        version = f"{len(self.versions()):06d}"
        # What a job that died has left under this name was never given.
        place, files = self._place(version)
        files.delete(place, True)
        path = f"{self.folder}/{version}"
        new.write.mode("errorifexists").parquet(f"{path}/_keys")
        new = self.spark.read.parquet(f"{path}/_keys")
        count = new.count()
        if capacity is not None and before + count > capacity:
            files.delete(place, True)
            raise RuleError(f"{self.folder}: {before + count} rows need unique values, {capacity} are given")
        if not count:
            files.delete(place, True)
            return known if known is not None else new.withColumn("n", F.lit(0).cast("long")).limit(0)
        numbered = number_rows(new, key_text(*[F.col(n) for n in names]), [F.col(n) for n in names], "n", buckets or bucket_count(count))
        numbered.withColumn("n", F.col("n") + before).write.mode("append").parquet(path)
        files.delete(self._place(f"{version}/_keys")[0], True)
        files.create(self._place(f"{version}/{_DONE}")[0]).close()
        return self.given()

    def numbered(self, df: DataFrame, key: Sequence[str], name: str, capacity: int | None = None, buckets: int | None = None) -> DataFrame:
        """The table with the number of each row's key; keys without a number get one first."""
        log = self.extended(df, key, capacity, buckets)
        names = [f"k{i}" for i in range(len(key))]
        table = log.select(*[F.col(n).alias(f"_{n}") for n in names], F.col("n").alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{n}")) for k, n in zip(key, names)]
        return df.join(table, same).drop(*[f"_{n}" for n in names])


def _same(names: Sequence[str]) -> list[Column]:
    return [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
