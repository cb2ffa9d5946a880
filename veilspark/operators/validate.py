"""Validation: does a masked table still show original values, and what follows from that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import sqltext
from veilspark.functions.redact import is_blank
from veilspark.operators.stacking import stack_rows
from veilspark.plans.rules import TableRule
from veilspark.sources.scratch import materialise

REPORT = [
    "table_name", "schema_name", "column_name", "rule_type", "ignored", "rows_masked", "rows_original", "rows_missing", "rows_extra",
    "keys_repeated", "leaks", "changed",
]
UNIQUE_SHUFFLE_FAILED = "Cannot generate unique shuffle value"


def _leak(masked: Column, original: Column, kind: T.DataType) -> Column:
    """Both present, the original not blank, and equal."""
    same = masked == original
    if isinstance(kind, T.StringType):
        same = same & ~is_blank(original)
    return F.coalesce(same, F.lit(False))


def _count(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0))


def _sides(masked: DataFrame, original: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row per key: how many rows of each side have it, and the columns of one of them. Both sides are dealt out together, once; rows of
    one key are counted before, so a repeated key is no hot one."""
    key = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    row = lambda df, side: F.struct(*[F.col(n).alias(f"{side}_{i}") for i, n in enumerate(names)])
    kinds = {side: F.lit(None).cast(df.select(row(df, side).alias("x")).schema["x"].dataType) for side, df in (("m", masked), ("o", original))}
    left = masked.select(*key, F.lit(1).alias("__m1"), F.lit(0).alias("__o1"), row(masked, "m").alias("__m"), kinds["o"].alias("__o"))
    right = original.select(*key, F.lit(0).alias("__m1"), F.lit(1).alias("__o1"), kinds["m"].alias("__m"), row(original, "o").alias("__o"))
    grouped = left.unionByName(right).groupBy(*[f"__k{i}" for i in range(len(keys))])
    return grouped.agg(F.sum("__m1").alias("__n_m"), F.sum("__o1").alias("__n_o"), F.first("__m", ignorenulls=True).alias("__m"), F.first("__o", ignorenulls=True).alias("__o"))


def validate_columns(masked: DataFrame, original: DataFrame, rule: TableRule) -> DataFrame:
    """One report row per configured column: rows on both sides, rows whose key the other side lacks, repeated keys, leaks, changed values.

    Both tables are grouped by key in one shuffle, and one aggregate counts for all columns. Leaks and changes are counted over keys that both sides have once;
    a repeated key has no one row to compare with and is reported instead. A key column can have a rule: a masked key is then a
    missing and an extra one.
    """
    rules = [r for r in rule.columns if r.name in masked.columns and r.name in original.columns]
    keys = list(rule.key)
    kinds = {f.name: f.dataType for f in original.schema.fields}
    names = [r.name for r in rules]
    single = (F.col("__n_o") == 1) & (F.col("__n_m") == 1)
    rows = lambda side: F.coalesce(F.sum(f"__n_{side}"), F.lit(0))
    sums = [
        rows("m").alias("__rows"), rows("o").alias("__before"),
        F.coalesce(F.sum(F.when(F.col("__n_m") == 0, F.col("__n_o"))), F.lit(0)).alias("__missing"),
        F.coalesce(F.sum(F.when(F.col("__n_o") == 0, F.col("__n_m"))), F.lit(0)).alias("__extra"),
        _count((F.col("__n_o") > 1) | (F.col("__n_m") > 1)).alias("__repeated"),
    ]
    for i, r in enumerate(rules):
        new, old = F.col(f"__m.m_{i}"), F.col(f"__o.o_{i}")
        leak = F.lit(False) if r.ignore else single & _leak(new, old, kinds[r.name])
        compared = single & new.isNotNull() & old.isNotNull()
        if isinstance(kinds[r.name], T.StringType):
            compared = compared & ~is_blank(old)
        sums += [_count(leak).alias(f"__l{i}"), _count(compared & ~leak).alias(f"__c{i}")]
    counted = _sides(masked, original, keys, names).agg(*sums)
    stacked = [
        [
            *[sqltext.text(x) for x in (rule.name, rule.schema, r.name, r.type)], str(r.ignore).lower(), "__rows", "__before", "__missing",
            "__extra", "__repeated", f"__l{i}", f"__c{i}",
        ]
        for i, r in enumerate(rules)
    ]
    return stack_rows(counted, stacked, REPORT)


def validation_verdict(report: DataFrame) -> DataFrame:
    """Add ``result`` (PASS or FAIL) and ``result_comment``."""
    kind, leaks = F.col("rule_type"), F.col("leaks") > 0
    not_required = F.col("ignored") | (kind == "NoMasking")
    unmatched = F.lit(False)
    if "rows_missing" in report.columns:
        unmatched = (F.col("rows_missing") > 0) | (F.col("rows_extra") > 0) | (F.col("keys_repeated") > 0)
    # (condition, result, comment); the first that holds decides.
    cascade = [
        (unmatched, "FAIL", F.lit("Rows are missing, added or repeated")),
        (~leaks & (F.col("rows_masked") == 0), "PASS", F.lit("No record found")),
        (not_required, "PASS", F.lit("Masking not required")),
        (~leaks, "PASS", F.lit("NULL")),
        ((kind == "Shuffle") & (F.col("rows_masked") == 1), "FAIL", F.lit("row count must be > 1 for Shuffle")),
        (kind == "Shuffle", "FAIL", F.lit("Cannot generate a unique shuffle value")),
        ((kind == "exception") & (F.col("changed") > 0), "PASS", F.lit("Applied mask with exception")),
        (kind == "City", "PASS", F.lit("Same City found but different state or province")),
        (F.lit(True), "FAIL", F.concat(F.lit("Found exact match "), kind)),
    ]
    result, comment = F, F
    for condition, outcome, text in cascade:
        result, comment = result.when(condition, F.lit(outcome)), comment.when(condition, text)
    return report.withColumns({"result": result, "result_comment": comment})


def validation_shuffle_log(verdict: DataFrame, exceptions: DataFrame) -> DataFrame:
    """The variant for shuffled columns: they pass unless the exception log names them."""
    logged = (
        exceptions.where(F.col("reason") == UNIQUE_SHUFFLE_FAILED)
        .select("table_name", "column_name", F.lit(True).alias("__logged"))
        .distinct()
    )
    joined = verdict.join(logged, ["table_name", "column_name"], "left")
    excused = (F.col("rule_type") == "Shuffle") & (F.col("leaks") > 0) & (F.col("rows_masked") > 1) & F.col("__logged").isNull()
    return joined.withColumns(
        {
            "result": F.when(excused, "PASS").otherwise(F.col("result")),
            "result_comment": F.when(excused, "NULL").otherwise(F.col("result_comment")),
        }
    ).select(*verdict.columns)


def validation_summary(verdict: DataFrame) -> DataFrame:
    """Tables, columns, passes, failures and the share of passes in percent, rounded half-even."""
    passed, failed = _count(F.col("result") == "PASS"), _count(F.col("result") == "FAIL")
    totals = verdict.agg(
        F.count_distinct("table_name").alias("table_count"),
        F.count("*").alias("column_count"),
        passed.alias("total_pass"),
        failed.alias("total_fail"),
    )
    share = F.col("total_pass").cast("decimal(18,0)") * 100 / (F.col("total_pass") + F.col("total_fail")).cast("decimal(18,0)")
    return totals.withColumn("accuracy_pct", F.bround(share, 2).cast("decimal(5,2)"))


def validation_row_counts(masked: DataFrame, original: DataFrame, rule: TableRule) -> DataFrame:
    """Masked and original row count of a table."""
    counted = masked.agg(F.count("*").alias("row_count_mask"))
    return counted.select(
        F.lit(rule.name).alias("table_name"), "row_count_mask", original.agg(F.count("*")).scalar().alias("row_count_prd")
    )


# Bits of all bitmaps of a survival check together, so that their broadcast is bounded whatever the tables hold: 64 MB.
BITMAP_BITS = 1 << 29


def _held_values(df: DataFrame, names: list[str]) -> DataFrame:
    """column (its number), value (text) and hash of every value that is neither null nor blank."""
    cells = [F.struct(F.lit(i).alias("column"), F.col(n).cast("string").alias("value")) for i, n in enumerate(names)]
    cells = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where(F.col("value").isNotNull() & ~is_blank(F.col("value")))
    return cells.withColumn("hash", F.xxhash64("column", "value"))


def _bitmaps(values: DataFrame, bits: int) -> DataFrame:
    """Bitmaps of the hashes: one row for each 32768 bits that hold any."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    return values.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))


def _perhaps_in(values: DataFrame, bitmaps: DataFrame, bits: int) -> DataFrame:
    """The values whose bit is set: all that the bitmaps were made of, and some others."""
    at = F.shiftrightunsigned("hash", 64 - bits)
    place = F.bitmap_bit_position(at)
    joined = values.withColumn("__b", F.bitmap_bucket_number(at)).join(F.broadcast(bitmaps), F.col("__b") == F.col("__bucket"))
    byte = F.conv(F.hex(F.substring("__bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return joined.where(F.getbit(byte.cast("bigint"), (place % 8).cast("int")) == 1).select(*values.columns)


def surviving_values(masked: DataFrame, original: DataFrame, rule: TableRule) -> DataFrame:
    """Per configured column: rows of the masked table that show a value which any row of the original column has, and how many such
    values there are. Swapped, rotated and copied columns are found, which a comparison row by row passes.

    The original values make bitmaps of a bounded size, that masked values are tested against where they are; what passes is confirmed by
    an exact join, for which the original is tested against the bitmaps of what passed. So only what may survive is shuffled. Columns of
    ignored rules are left out, as are null and blank values.
    """
    rules = [r for r in rule.columns if r.name in masked.columns and r.name in original.columns and not r.ignore]
    names = [r.name for r in rules]
    schema = "table_name string, column_name string, rule_type string, rows_surviving long, values_surviving long"
    if not names:
        return masked.sparkSession.createDataFrame([], schema)
    bits = BITMAP_BITS.bit_length() - 1
    before, after = _held_values(original, names), _held_values(masked, names)
    passed = _perhaps_in(after, _bitmaps(before, bits), bits).groupBy("column", "value", "hash").agg(F.count("*").alias("rows"))
    passed = materialise(passed, "passed")
    known = _perhaps_in(before, _bitmaps(passed, bits), bits).select("column", "value").distinct()
    confirmed = passed.join(known, ["column", "value"], "left_semi").groupBy("column").agg(F.sum("rows").alias("rows"), F.count("*").alias("found"))
    columns = masked.sparkSession.createDataFrame([(i, rule.name, r.name, r.type) for i, r in enumerate(rules)], "column int, table_name string, column_name string, rule_type string")
    return columns.join(confirmed, "column", "left").select(
        "table_name", "column_name", "rule_type", F.coalesce("rows", F.lit(0)).cast("long").alias("rows_surviving"), F.coalesce("found", F.lit(0)).cast("long").alias("values_surviving")
    )


# Rows of a range of hashes, and the most ranges there are.
ROWS_PER_HASH_RANGE, MAX_HASH_RANGES = 4096, 1 << 20
# Rows of a table up to which a second look at it costs more than its shuffle.
SHUFFLED_AS_IT_IS = 200_000


def _row_hash(df: DataFrame, salt: int) -> Column:
    """64 bits of a row. Nulls are told by a mask, as the hash skips them; zeros of both signs are one, as they are where rows are grouped."""
    cells, nulls = [], F.lit("")
    for field in df.schema.fields:
        cell = F.col(f"`{field.name}`")
        nulls = F.concat(nulls, F.when(cell.isNull(), "1").otherwise("0"))
        cells.append(F.when(cell == 0, F.lit(0).cast(field.dataType)).otherwise(cell) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else cell)
    return F.xxhash64(F.lit(salt), nulls, *cells)


def _hash_range(df: DataFrame, ranges: int) -> Column:
    return F.pmod(_row_hash(df, 1), F.lit(ranges)).cast("int")


def _range_sums(df: DataFrame, ranges: int) -> DataFrame:
    """Per range of hashes the rows and the sum of 128 bits of each, as four sums of 32 bits. The order of rows does not matter, copies do."""
    parts = df.select(_hash_range(df, ranges).alias("range"), _row_hash(df, 1).alias("a"), _row_hash(df, 2).alias("b"))
    low, high = (lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)), (lambda c: F.shiftrightunsigned(c, 32))
    return parts.groupBy("range").agg(F.count("*").alias("n"), *[F.sum(half(c)).alias(f"{c}{i}") for c in "ab" for i, half in enumerate((low, high))])


def differing_ranges(left: DataFrame, right: DataFrame, ranges: int) -> DataFrame:
    """The ranges whose sums differ. Each side is read once where it is; sums of at most `ranges` ranges are compared."""
    sums = ["n", "a0", "a1", "b0", "b1"]
    both = _range_sums(left, ranges).join(_range_sums(right, ranges).select("range", *[F.col(c).alias(f"_{c}") for c in sums]), "range", "full")
    same = F.lit(True)
    for c in sums:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return both.where(~same).select(F.col("range").alias("__range"))


def table_diff(left: DataFrame, right: DataFrame, chunk: int = 10_000, ranges: int | None = None) -> DataFrame:
    """Rows of either table without an equal row in the other, duplicates kept; nulls are equal.

    Rows are dealt to ranges by hash and each range is summed up on both sides; only rows of ranges whose sums differ are shuffled. Copies
    are counted before that, so a row with many copies is one record there. Rows are repeated in two steps, chunks first and spread out,
    so that no task writes all copies of one row.
    """
    names = left.columns
    right = right.select(*[F.col(f"`{n}`").cast(left.schema[n].dataType).alias(n) for n in names])
    rows = left.count() if ranges is None else 0
    if ranges or rows > SHUFFLED_AS_IT_IS:
        ranges = ranges or min(MAX_HASH_RANGES, max(64, rows // ROWS_PER_HASH_RANGE))
        unlike = F.broadcast(materialise(differing_ranges(left, right, ranges), "ranges"))
        left, right = (df.join(unlike, _hash_range(df, ranges) == F.col("__range"), "left_semi") for df in (left, right))
    both = left.select(*names, F.lit(1).alias("__l"), F.lit(0).alias("__r")).unionByName(right.select(*names, F.lit(0).alias("__l"), F.lit(1).alias("__r")))
    counted = both.groupBy(*names).agg(F.sum("__l").alias("__l"), F.sum("__r").alias("__r"))
    alone = counted.where((F.col("__l") == 0) | (F.col("__r") == 0)).withColumn("__n", F.col("__l") + F.col("__r"))
    chunks = alone.withColumn("__c", F.explode(F.sequence(F.lit(0), ((F.col("__n") - 1) / chunk).cast("bigint"))))
    spread = chunks.repartition(*[F.col(n) for n in names], F.col("__c"))
    size = F.least(F.lit(chunk).cast("bigint"), F.col("__n") - F.col("__c") * chunk)
    return spread.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("bigint"), size))).select(*names)
