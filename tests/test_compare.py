"""Tables compared: what survives anywhere in a column, and differences by hash ranges."""

import random

from pyspark.sql import functions as F

from veilspark.operators.validate import _hash_range, differing_ranges, surviving_values, table_diff, validate_columns
from veilspark.plans.rules import ColumnRule, TableRule

R = ColumnRule
RULE = TableRule("t", ("k",), (R("a", "FullName"), R("b", "RandomInt"), R("c", "City", ignore=True), R("d", "FullName")))


def test_a_column_turned_by_one_row_is_found(spark):
    rows = [(i, f"name {i}", i * 1000, "x", " " if i % 2 else None) for i in range(2000)]
    schema = "k long, a string, b int, c string, d string"
    original = spark.createDataFrame(rows, schema).repartition(4)
    turned = [(k, rows[(k + 1) % 2000][1], b + 1 if k != 7 else 5000, c, d) for k, _, b, c, d in rows]
    masked = spark.createDataFrame(turned, schema)
    got = {r["column_name"]: (r["rows_surviving"], r["values_surviving"]) for r in surviving_values(masked, original, RULE).collect()}
    assert got == {"a": (2000, 2000), "b": (1, 1), "d": (0, 0)}
    # Compared row by row nothing leaks.
    assert all(r["leaks"] == 0 for r in validate_columns(masked, original, RULE).where("column_name IN ('a')").collect())


def test_full_bitmaps_cost_time_and_not_results(spark, monkeypatch):
    from veilspark.operators import validate

    monkeypatch.setattr(validate, "BITMAP_BITS", 1 << 6)
    r = random.Random(1)
    original = spark.createDataFrame([(i, f"v{r.randrange(10**6)}", i, "", "") for i in range(3000)], "k long, a string, b int, c string, d string")
    masked = original.select("k", F.concat("a", F.lit("!")).alias("a"), (F.col("b") + 2999).alias("b"), "c", "d")
    got = {r["column_name"]: r["rows_surviving"] for r in surviving_values(masked, original, RULE).collect()}
    assert got == {"a": 0, "b": 1, "d": 0}


def test_one_changed_row_shuffles_few(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = lines.select("l_orderkey", "l_linenumber").first()
    here = (F.col("l_orderkey") == at[0]) & (F.col("l_linenumber") == at[1])
    changed = lines.withColumn("l_tax", F.when(here, F.col("l_tax") + 1).otherwise(F.col("l_tax")))
    many = lines.where(here).count()
    assert table_diff(lines, changed).count() == 2 * many
    ranges = 64 * 16
    unlike = differing_ranges(lines, changed, ranges)
    kept = lines.join(F.broadcast(unlike), _hash_range(lines, ranges) == F.col("__range"), "left_semi").count()
    assert 0 < kept < 0.02 * lines.count()
    assert table_diff(lines, lines.repartition(7)).count() == 0


def test_nulls_zeros_and_copies_are_told(spark):
    schema = "a int, b int, x double, s string"
    left = [(1, None, 0.0, "u"), (None, 1, -0.0, "u"), (2, 2, float("nan"), None), (3, 3, 1.0, "")] + [(9, 9, 9.0, "copy")] * 40
    right = [(None, 1, 0.0, "u"), (None, 1, 0.0, "u"), (2, 2, float("nan"), None), (3, 3, 1.0, None)] + [(9, 9, 9.0, "copy")] * 39
    diff = table_diff(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), chunk=7, ranges=8)
    assert sorted(map(str, (tuple(r) for r in diff.collect()))) == sorted(map(str, [(1, None, 0.0, "u"), (3, 3, 1.0, ""), (3, 3, 1.0, None)]))
