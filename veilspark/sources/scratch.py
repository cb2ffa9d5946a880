"""Intermediate tables, kept where every executor can read them."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"

# Temporary folders of local sessions that name none; they end with the process.
_LOCAL: dict[str, str] = {}
# Paths this process has written, by application.
_WRITTEN: dict[str, list[str]] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local master, which is one process, may go without; a folder of one machine of a
    cluster would lose the rows of all others."""
    root = spark.conf.get(_CONF, None)
    if not root:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError(f"set {_CONF} to a folder that the driver and all executors share")
        if context.applicationId not in _LOCAL:
            made = tempfile.TemporaryDirectory(prefix="veilspark-")
            atexit.register(made.cleanup)
            _LOCAL[context.applicationId] = made.name
        root = _LOCAL[context.applicationId]
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def scratch_mark(spark: SparkSession) -> int:
    """How many tables this session has written so far."""
    return len(_WRITTEN.get(spark.sparkContext.applicationId, []))


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, for what is no table: markers, listings, deletions."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = hadoop_path(spark, path)
    return files.exists(place)


def clear_scratch(spark: SparkSession, since: int = 0) -> None:
    """Delete the intermediate tables written since a mark; they can hold original values. DataFrames built on them end with them."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    while len(written) > since:
        place, files = hadoop_path(spark, written.pop())
        files.delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        names = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
        for path in [p for p in _WRITTEN.get(context.applicationId, []) if any(n.endswith(p.split("://")[-1].lstrip("/")) for n in names)]:
            place, files = hadoop_path(table.sparkSession, path)
            files.delete(place, True)


def clear_at_exit() -> None:
    """At the end of the process delete what its session still has."""
    from pyspark import SparkContext

    if SparkContext._active_spark_context is not None and (spark := SparkSession.getActiveSession()) is not None:
        clear_scratch(spark)


atexit.register(clear_at_exit)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate result and read it back.

    The lineage ends here, lost executors cost nothing, several readers share one computation, and the
    optimizer learns the true size.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Intermediate tables that this process may use again, by application and what they were made of.
_KEPT: dict[tuple, str] = {}


# Files of a table up to which their times of change are looked at; names of more are those that Spark gave, which never come twice.
TIMED_FILES = 1000


def source_mark(df: DataFrame) -> tuple:
    """What a table is made of: its files, when they were changed, and its plan, whatever the numbers of its columns are."""
    names = sorted(df.inputFiles())
    context = df.sparkSession.sparkContext
    times: list[int] = []
    if len(names) <= TIMED_FILES:
        for name in names:
            place = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(name))
            times.append(place.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime())
    return tuple(names), tuple(times), df._jdf.queryExecution().analyzed().canonicalized().toString()


def kept(spark: SparkSession, mark: tuple, label: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives, written once a session for each mark. A mark names all that the table is made of."""
    whole = (spark.sparkContext.applicationId, label, mark)
    path = _KEPT.get(whole)
    if path is not None and path in _WRITTEN.get(spark.sparkContext.applicationId, []):
        return spark.read.parquet(path)
    table = materialise(make(), label)
    _KEPT[whole] = _WRITTEN[spark.sparkContext.applicationId][-1]
    return table


# Bytes of a table up to which it is sent to every executor.
BROADCAST_BYTES = 64 << 20


def sized_for_join(df: DataFrame) -> tuple[DataFrame, int, bool]:
    """The table, marked for broadcast if its measured size allows it, its number of rows, and whether it does."""
    size = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in df.columns]
    rows, *sizes = df.agg(F.count("*"), *size).first()
    small = 16 * rows + sum(sizes) <= BROADCAST_BYTES
    return (F.broadcast(df) if small else df), rows, small


def pick(df: DataFrame, table: DataFrame, number: str, size: int, small: bool, spread: Column) -> DataFrame:
    """Join each row with the row of a numbered table that it drew, where all numbers are drawn equally often.

    A table of few large rows that is shuffled would leave most tasks without work: its rows are then repeated with salts, until there
    are several numbers for each task. ``spread`` is a number that rows choose their salt by.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = 1 if small else max(1, -(-4 * tasks // max(1, size)))
    if salts == 1:
        return df.join(table, number, "left")
    salted = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("__salt", (spread % F.lit(salts)).cast("int")).join(salted, [number, "__salt"], "left").drop("__salt")
