"""Writing back: the updated target table, the batches of a run, reports about a configuration."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.operators.keyindex import KeyIndex, first_key_between, first_key_from
from veilspark.operators.numbering import range_number
from veilspark.plans.rules import RuleError, TableRule
from veilspark.sources.scratch import hadoop_path

# Batch sizes by row count: fixed values.
LARGE_ROWS, LARGE_BATCH = 200_000, 100_000
MEDIUM_BATCH = 50_000
# A table is written in about WAVES jobs of some batches each.
WAVES, LEAST_WAVE, MOST_WAVE = 8, 8, 4096
# Row counts from which on the medium batch applies; one dialect family stops short of LARGE_ROWS: fixed values.
MEDIUM_ROWS = {"sqlserver": (50_000, 200_000), "oracle": (50_000, 180_000), "postgres": (50_000, 180_000), "mysql": (50_000, 180_000)}


def apply_masked_copy(target: DataFrame, masked: DataFrame, key: Sequence[str]) -> DataFrame:
    """The target with the masked rows put in by key; rows without a masked row stay as they are.

    A key that several masked rows have is an error: which of them is meant cannot be known, and the target's rows must not multiply. That is
    found on the keys alone; the rows are joined once.
    """
    columns = [c for c in masked.columns if c not in key]
    repeated = masked.groupBy(*key).agg(F.count("*").alias("__rows")).where("__rows > 1")
    if repeated.limit(1).count():
        raise RuleError(f"several masked rows have one key ({', '.join(key)})")
    update = masked.select(*key, F.lit(True).alias("__hit"), *[F.col(c).alias(f"__m_{i}") for i, c in enumerate(columns)])
    joined = target.join(update, list(key), "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__m_{i}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(columns)}
    return joined.select(*[new.get(c, F.col(c)) for c in target.columns])


def batch_size(rows: int, configured: int | None = None, dialect: str = "sqlserver") -> int:
    """Rows per transaction for a table of ``rows`` rows."""
    low, high = MEDIUM_ROWS[dialect]
    if rows > LARGE_ROWS:
        return LARGE_BATCH
    if low <= rows <= high:
        return MEDIUM_BATCH
    return configured if configured and configured > 0 else max(rows, 1)


def write_batches(df: DataFrame, path: str, key: Sequence[str], configured: int | None = None, dialect: str = "sqlserver", wave: int | None = None, mark: str = "") -> DataFrame:
    """Write a table in batches by key, and return the log. A run that was stopped goes on where its log ends.

    Batches are ranges of the key histogram, kept in the folder; a wave of them is one job, a batch one task and file of it. When a wave
    is written its files are logged; files that no log names are left from a job that died, and are deleted before the next one. So each
    row is written once whatever happens, and a second run of a finished table writes nothing. ``mark`` says what is written: a folder
    begun with another is an error.
    """
    spark, folder = df.sparkSession, path.rstrip("/")
    place, files = hadoop_path(spark, folder)
    digest = hashlib.md5(mark.encode()).hexdigest()
    begun = {k: v for k, v in (n.split("=", 1) for n in _names(files, hadoop_path(spark, f"{folder}/_batches")[0]) if "=" in n)}
    if not begun:
        # An index without its mark is left from a job that died.
        files.delete(hadoop_path(spark, f"{folder}/_batches")[0], True)
        size = batch_size(df.count(), configured, dialect)
        KeyIndex.build(df, key, f"{folder}/_batches", size, file_map=False)
        files.mkdirs(hadoop_path(spark, f"{folder}/_batches/{digest}={size}")[0])
        begun = {digest: str(size)}
    if digest not in begun:
        raise RuleError(f"{folder} holds a table begun with other rules or another seed")
    size = int(begun[digest])
    ranges = KeyIndex.load(spark, key, f"{folder}/_batches", size).ranges
    many = ranges.count()
    wave = wave or min(MOST_WAVE, max(LEAST_WAVE, -(-many // WAVES)))
    for first in range(0, many, wave):
        if files.exists(hadoop_path(spark, f"{folder}/_commits/first={first:09d}/_SUCCESS")[0]):
            continue
        known = {r["file"] for r in _logged(spark, folder).select("file").collect()} if files.exists(hadoop_path(spark, f"{folder}/_commits")[0]) else set()
        for left in [n for n in _names(files, place) if n.startswith("part-") and n not in known]:
            files.delete(hadoop_path(spark, f"{folder}/{left}")[0], False)
        found = ranges.select("low", "high", "before").orderBy("before").offset(first).limit(wave + 1).collect()
        own, after = found[:wave], found[wave:]
        _write_wave(df, folder, key, ranges, own, after, size)
        new = sorted(n for n in _names(files, place) if n.startswith("part-") and n not in known)
        _log_wave(spark, folder, own, first, new)
    if not many and not [n for n in _names(files, place) if n.startswith("part-")]:
        df.limit(0).write.mode("append").parquet(folder)
    return commit_log(spark, folder)


def _names(files, place) -> list[str]:
    return [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []


def _write_wave(df: DataFrame, folder: str, key: Sequence[str], ranges: DataFrame, own: list, after: list, size: int) -> None:
    """One job: a task and a file for each batch. A row of a key that two ranges share is in the later one."""
    index = KeyIndex(tuple(key), size, ranges, None)
    whole = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    first = own[0]["before"] > 0
    rows = df.where(first_key_between(df, key[0], own[0]["low"][0] if first else None, own[-1]["high"][0]) if after else first_key_from(df, key[0], own[0]["low"][0] if first else None))
    if first:
        rows = rows.where(whole >= index.constant(own[0]["low"]))
    if after:
        rows = rows.where(whole < index.constant(after[0]["low"]))
    cuts = [tuple(r["low"]) for r in own[1:]]
    placed = rows.withColumn("__key", whole).withColumn("__batch", range_number(rows, key, cuts)).drop("__key")
    dealt = placed.repartitionById(len(own), "__batch").sortWithinPartitions(*key).drop("__batch")
    dealt.write.mode("append").option("maxRecordsPerFile", size).parquet(folder)


def _log_wave(spark: SparkSession, folder: str, own: list, first: int, new: list[str]) -> None:
    """What a wave has written. Rows are those that the files' footers tell; no row is read."""
    files = spark.read.parquet(*[f"{folder}/{n}" for n in new]).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("n_rows"))
    # A file's name begins with the number of the task that wrote it, which is the batch's within the wave.
    number = F.split("file", "-")[1].cast("int")
    begins = F.element_at(F.array(*[F.lit(r["before"]) for r in own]), number + 1)
    log = files.select((F.lit(first + 1) + number).cast("long").alias("batch"), "file", "n_rows", begins.alias("before"))
    log.coalesce(1).write.mode("overwrite").parquet(f"{folder}/_commits/first={first:09d}")


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/_commits")


def commit_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per file that was committed to a table: its batch, its name, its first and last key, its rows. Nothing of the table is read."""
    folder = path.rstrip("/")
    if not _names(hadoop_path(spark, folder)[1], hadoop_path(spark, f"{folder}/_commits")[0]):
        return spark.createDataFrame([], "batch long, file string, n_rows long")
    keys = spark.read.parquet(f"{folder}/_batches/ranges").select("before", F.col("low").alias("first_key"), F.col("high").alias("last_key"))
    return _logged(spark, folder).where("n_rows > 0").join(keys, "before").select("batch", "file", "first_key", "last_key", "n_rows")


def preview(masked: DataFrame, rule: TableRule, count: int, width: int = 6) -> DataFrame:
    """The key and the first previewed columns of the first rows by key."""
    shown = [r.name for r in rule.columns if r.preview and not r.ignore][:width]
    return masked.select(*rule.key, *shown).orderBy(*rule.key).limit(count)


def column_mapping_report(config: DataFrame, sheet: DataFrame) -> DataFrame:
    """Rule asked for and rule applied, per configured column."""
    asked = sheet.select("table_name", "column_name", F.col("masking_rule"))
    bound = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "Null").otherwise(F.col(c))
    return config.join(asked, ["table_name", "column_name"], "left").select(
        "table_name",
        "column_name",
        "masking_rule",
        F.col("type").alias("rule_applied"),
        F.col("ignore").alias("ignored"),
        F.col("pattern").alias("format_pattern"),
        F.concat(bound("min"), F.lit(" - "), bound("max")).alias("min_max"),
    )


def drop_binary_columns(df: DataFrame) -> DataFrame:
    """Everything but the binary columns."""
    return df.select(*[f.name for f in df.schema.fields if f.dataType.typeName() != "binary"])
