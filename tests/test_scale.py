"""What must hold at any size: layout does not matter, keys may be hot, plans stay distributed."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions.draw import key_text
from veilspark.operators.mapping import apply_correlation, correlation_table, hot_keys, lookup
from veilspark.operators.numbering import bucket_count, cut_points, number_rows, position_by_key
from veilspark.operators.profile import profile_columns
from veilspark.operators.validate import table_diff, validate_columns
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule as R
from veilspark.plans.rules import RuleError, Settings, TableRule
from veilspark.sources import scratch
from veilspark.sources.tables import scan_page, scan_row_range

RULES = TableRule(
    "customer", ("c_custkey",),
    (
        R("c_name", "StringFormat", pattern="??-#######", unique=True), R("c_acctbal", "Shuffle"),
        R("c_mktsegment", "PickRandom", pattern="A,B,C"), R("c_nationkey", "RandomInt", min="0", max="99", global_mapping=True),
    ),
)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(df.collect(), key=str)


def test_layout_and_order_do_not_matter(customer):
    one = rows(mask_table(customer.coalesce(1), RULES))
    seven = rows(mask_table(customer.orderBy(F.desc("c_custkey")).repartition(7), RULES))
    assert one == seven


def test_the_seed_matters(customer):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "FullName"),))
    assert rows(mask_table(customer, rule)) != rows(mask_table(customer, rule, Settings(seed="other")))


def test_unique_values(customer):
    masked = mask_table(customer, RULES)
    assert masked.select("c_name").distinct().count() == customer.count()


def test_numbers_are_dense(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k"))
    numbered = number_rows(df, key_text(F.col("k")), [F.col("k")], "n", 16)
    assert sorted(r["n"] for r in numbered.collect()) == list(range(1000))


def test_positions_follow_the_key(spark):
    df = spark.range(500).select(F.when(F.col("id") % 100 == 0, None).otherwise(F.col("id") * 7 % 503).alias("k"), F.col("id").alias("x"))
    expected = sorted(((r["k"] is not None, r["k"] or 0, r["x"]) for r in df.collect()))
    # Any cut points give the same positions: none, few, whole keys, more than the comparison tree takes.
    many = [(k, x) for k in range(0, 500, 4) for x in (0, 9)]
    for cuts in (None, [], [(250, 0)], [(3, 1), (5, 2), (400, 3)], [(None, 200)], many):
        got = position_by_key(df, ["k", "x"], "p", cuts=cuts).orderBy("p").collect()
        assert [r["p"] for r in got] == list(range(500))
        assert [(r["k"] is not None, r["k"] or 0, r["x"]) for r in got] == expected


def test_positions_with_keys_of_every_type(spark):
    df = spark.range(300).selectExpr(
        "CAST(id * 7 % 11 AS DOUBLE) / 3 AS f", "concat('it''s \\\\', id % 5) AS s", "timestamp_ntz'2020-01-01 00:00:00.25' + make_dt_interval(0, 0, 0, id) AS t",
        "CAST(id AS DECIMAL(9,2)) AS d", "id % 2 = 0 AS b", "CAST(CAST(id AS STRING) AS BINARY) AS x", "id",
    )
    keys = ["f", "s", "t", "d", "b", "x", "id"]
    for ranges in (8, 200):
        got = position_by_key(df, keys, "p", cuts=cut_points(df, keys, ranges)).orderBy(*keys).collect()
        assert [r["p"] for r in got] == list(range(300))


def test_ranges_and_pages_cover_the_table(orders):
    keys = sorted(r[0] for r in orders.select("o_orderkey").collect())
    for first, last in ((1, 1), (1490, 1600), (3000, 3100), (1, 5000)):
        got = scan_row_range(orders, ["o_orderkey"], first, last).orderBy("o_orderkey").collect()
        assert [r["o_orderkey"] for r in got] == keys[first - 1 : last]
    pages = [r["o_orderkey"] for j in range(4) for r in scan_page(orders, ["o_orderkey"], j, 400).orderBy("o_orderkey").collect()]
    assert pages == keys[:1600]
    assert [r["o_orderkey"] for r in scan_row_range(orders, ["o_orderkey"], 11, 20).orderBy("o_orderkey").collect()] == keys[10:20]


def test_shuffle_with_one_value_in_most_rows(spark):
    """Two thirds of the rows hold one value: it is drawn no more often than any other."""
    df = spark.range(6000).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.col("id") % 50).otherwise(F.lit(1000)).alias("v"))
    masked = mask_table(df, TableRule("t", ("k",), (R("v", "Shuffle"),)))
    joined = masked.join(df.withColumnRenamed("v", "old"), "k")
    assert joined.where("v = old").count() == 0 and joined.count() == 6000
    counts = [r["n"] for r in masked.groupBy("v").agg(F.count("*").alias("n")).collect()]
    assert len(counts) == 51 and max(counts) < 6000 / 51 * 2


def test_shuffle_beyond_the_broadcast_size_gives_the_same_rows(spark, customer, monkeypatch):
    rule = TableRule("customer", ("c_custkey",), (R("c_acctbal", "Shuffle"),))
    small = rows(mask_table(customer, rule))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        masked = mask_table(customer, rule)
        # One join, and so one shuffle of the table, for a shuffled column.
        assert plan(masked).count("SortMergeJoin") == 1
        assert rows(masked) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_large_values_are_salted(spark, monkeypatch):
    df = spark.range(400).select(F.col("id").alias("k"), F.concat(F.repeat(F.lit("x"), 1 << 16), (F.col("id") % 3).cast("string")).alias("v"))
    rule = TableRule("t", ("k",), (R("v", "Shuffle"),))
    small = rows(mask_table(df, rule).select("k", F.md5("v")))
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    masked = mask_table(df, rule)
    assert "__salt" in plan(masked) and rows(masked.select("k", F.md5("v"))) == small


def test_buckets_grow_with_the_table():
    assert [bucket_count(n) for n in (0, 10**6, 2 * 10**8, 10**13)] == [1024, 1024, 2048, 1 << 20]


def test_values_do_not_depend_on_the_number_of_buckets(spark, customer):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "StringFormat", pattern="??######", unique=True), R("c_mktsegment", "Shuffle")))
    few, many = (sorted(map(tuple, mask_table(customer, rule, Settings(buckets=n)).collect())) for n in (1, 1 << 16))
    assert few == many
    corr = [sorted(map(tuple, correlation_table(customer, "c_custkey", "s", Settings(buckets=n), 10, 1009).collect())) for n in (1, 1 << 12)]
    assert corr[0] == corr[1]


def test_too_few_values_are_an_error(spark, customer):
    with pytest.raises(RuleError, match="101 are given"):
        correlation_table(customer, "c_custkey", "s", Settings(), 10, 101)
    with pytest.raises(RuleError, match="need unique values"):
        mask_table(customer, TableRule("customer", ("c_custkey",), (R("c_name", "StringFormat", pattern="##", unique=True),)))


def test_a_table_without_a_key_is_an_error(customer):
    with pytest.raises(RuleError, match="without a key"):
        mask_table(customer, TableRule("customer", (), (R("c_name", "FullName"),)))


def test_one_first_key_in_most_rows_is_cut_by_the_second(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(5)).alias("a"), F.col("id").alias("b"))
    cuts = cut_points(df, ["a", "b"], ranges=16)
    assert sum(1 for a, _ in cuts if a == 5) >= 8
    got = position_by_key(df, ["a", "b"], "p", cuts=cuts).orderBy("a", "b").collect()
    assert [r["p"] for r in got] == list(range(4000))


def test_correlation_with_a_hot_and_a_null_key(spark):
    children = spark.range(9000).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 2000 + 100000).cast("bigint").alias("parent"),
    )
    parents = children.select("parent").distinct()
    table = correlation_table(parents, "parent", "p", Settings(), 10**6, 1_000_003)
    assert {r[0] for r in hot_keys(children, "parent").collect()} == {7}
    masked = apply_correlation(children, "parent", table, ["k"])
    mapping = {r["before"]: r["after"] for r in table.collect()}
    assert len(set(mapping.values())) == len(mapping) == parents.count() - 1
    expected = {r["k"]: mapping.get(r["parent"]) for r in children.collect()}
    assert {r["k"]: r["parent"] for r in masked.collect()} == expected
    joined = lookup(children, "parent", table, "before", key_text(F.col("k")))
    assert joined.count() == 9000


def test_table_diff_keeps_every_copy(spark):
    left = spark.createDataFrame([("a", 1)] * 25 + [("b", None)] * 3 + [("c", 2)], "x string, y int")
    right = spark.createDataFrame([("b", None)] + [("d", 4)] * 2, "x string, y int")
    found = [tuple(r) for r in table_diff(left, right, chunk=4).collect()]
    assert sorted(found, key=str) == sorted([("a", 1)] * 25 + [("c", 2)] + [("d", 4)] * 2, key=str)


def test_masked_columns_join_across_tables(spark, customer):
    other = customer.select(F.col("c_custkey").alias("k"), "c_nationkey")
    rule = R("c_nationkey", "Randomint64", min="1", max="99999999", global_mapping=True)
    a = mask_table(customer, TableRule("a", ("c_custkey",), (rule,)))
    b = mask_table(other, TableRule("b", ("k",), (rule,)))
    before = customer.join(other, "c_nationkey").count()
    assert a.join(b, "c_nationkey").count() == before


def test_plain_masks_need_no_shuffle_and_no_python(customer):
    text = plan(mask_table(customer, TableRule("customer", ("c_custkey",), (R("c_name", "FullName"), R("c_acctbal", "RandomDec", min="0", max="9"), R("c_mktsegment", "Bogus", pattern="{{INTERNET.EMAIL}}")))))
    assert "Exchange" not in text and "Python" not in text


def test_scans_read_the_needed_columns(customer):
    masked = mask_table(customer.select("c_custkey", "c_name"), TableRule("customer", ("c_custkey",), (R("c_name", "FullName"),)))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan(masked)
    checked = validate_columns(masked, customer, TableRule("customer", ("c_custkey",), (R("c_name", "FullName"),)))
    assert "c_acctbal" not in plan(checked)


def test_filters_reach_the_file(customer):
    masked = mask_table(customer, TableRule("customer", ("c_custkey",), (R("c_name", "FullName"),))).where("c_nationkey = 3")
    assert "EqualTo(c_nationkey,3)" in plan(masked)


def test_a_profile_is_one_scan(customer):
    assert plan(profile_columns("customer", customer)).count("FileScan") == 1


@pytest.mark.parametrize("make", [lambda c: mask_table(c, RULES), lambda c: position_by_key(c, ["c_custkey"], "p")])
def test_rows_never_go_through_one_partition(customer, make):
    """Single-partition exchanges carry bucket counts only, one row per bucket."""
    text = plan(make(customer))
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "HashAggregate(keys=[__bucket" in lines[i + 1]
