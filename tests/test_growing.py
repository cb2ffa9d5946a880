"""Streams that go on, profiles that add up, keys found in the data, weighted draws."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions.alias import STEPS, alias_table
from veilspark.operators import location
from veilspark.operators.discovery import discover_keys, discover_references, is_key
from veilspark.operators.sketches import profile_sketches, single_valued, update_profile
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, RuleError, Settings, TableRule
from veilspark.streaming.stream import masked_rows, write_masked_stream

R = ColumnRule
RULE = TableRule("customer", ("c_custkey",), (R("c_name", "StringFormat", pattern="??####", unique=True), R("c_mktsegment", "FullName")))


def streamed(spark, customer, folder, target, parts):
    for part in parts:
        part.write.mode("append").parquet(folder)
        write_masked_stream(spark.readStream.schema(customer.schema).parquet(folder), RULE, target).awaitTermination(120)
    return masked_rows(spark, target)


def test_a_stopped_stream_goes_on(spark, customer, tmp_path, monkeypatch):
    halves = [customer.where("c_custkey % 2 = 0"), customer.where("c_custkey % 2 = 1")]
    expected = sorted(streamed(spark, customer, str(tmp_path / "a"), str(tmp_path / "x"), halves).collect())
    assert len(expected) == customer.count() == len({r["c_name"] for r in expected})
    # The second query dies after its rows and numbers are written, before its batch is done.
    from veilspark.streaming import stream

    folder, target = str(tmp_path / "b"), str(tmp_path / "y")
    streamed(spark, customer, folder, target, halves[:1])
    halves[1].write.mode("append").parquet(folder)
    mask = stream.mask_table

    def dies(batch, *args):
        mask(batch, *args).write.mode("overwrite").parquet(f"{target}/rows/batch=000000001")
        raise RuntimeError("stopped")

    monkeypatch.setattr(stream, "mask_table", dies)
    query = write_masked_stream(spark.readStream.schema(customer.schema).parquet(folder), RULE, target)
    with pytest.raises(Exception, match="stopped"):
        query.awaitTermination(120)
    monkeypatch.setattr(stream, "mask_table", mask)
    write_masked_stream(spark.readStream.schema(customer.schema).parquet(folder), RULE, target).awaitTermination(120)
    assert sorted(masked_rows(spark, target).collect()) == expected


def test_a_stream_refuses_whole_columns(spark, customer):
    with pytest.raises(RuleError, match="whole column"):
        write_masked_stream(customer, TableRule("c", ("c_custkey",), (R("c_name", "Shuffle"),)), "/nowhere")


def test_a_second_profile_opens_new_files_only(spark, orders, tmp_path):
    source, store = str(tmp_path / "t"), str(tmp_path / "p")
    orders.where("o_orderkey % 2 = 0").withColumn("same", F.lit(5)).repartition(3).write.parquet(source)
    profile_sketches("orders", spark.read.parquet(source), store)
    orders.where("o_orderkey % 2 = 1").withColumn("same", F.lit(5)).repartition(2).write.mode("append").parquet(source)
    table = spark.read.parquet(source)
    assert update_profile(table, store) == 2 and update_profile(table, store) == 0
    assert spark.read.parquet(store).count() == 5
    found = {r["column_name"]: r for r in profile_sketches("orders", table, store).collect()}
    exact = orders.agg(F.count_distinct("o_custkey"), F.min("o_orderkey"), F.max("o_orderkey")).first()
    assert abs(found["O_CUSTKEY"]["n_distinct"] - exact[0]) <= 0.02 * exact[0] and found["O_ORDERKEY"]["n_rows"] == orders.count()
    assert (found["O_ORDERKEY"]["min"], found["O_ORDERKEY"]["max"]) == (str(exact[1]), str(exact[2]))
    assert [r["column_name"] for r in single_valued(profile_sketches("orders", table, store)).collect()] == ["SAME"]
    # A file that is gone does not count.
    kept = spark.read.parquet(*table.inputFiles()[:4])
    assert {r["n_rows"] for r in profile_sketches("orders", kept, store).collect()} == {kept.count()}


def test_profiled_tables_are_written_and_counted_in_parts(spark, sf_dir, tmp_path, monkeypatch):
    from suite import growing

    tables = {}
    for table in ("lineitem", "orders"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(8).write.parquet(f"{tmp_path}/{table}.parquet")
        tables[table] = spark.read.parquet(f"{tmp_path}/{table}.parquet")
    opened = []
    one = growing.profile_sketches
    monkeypatch.setattr(growing, "profile_sketches", lambda t, df, store: (opened.append((t, len(df.inputFiles()))), one(t, df, store))[1])
    found = growing._sketches(spark, str(tmp_path))
    # As many files as the scan has parts, and no row sent once for each column.
    parts = {t: df.rdd.getNumPartitions() for t, df in tables.items()}
    assert min(parts.values()) > 3 and opened == [(t, k * n) for t, n in parts.items() for k in (1, 2)]
    assert "Expand" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert len(rows) == 13 and all(r["distinct_near"] and r["median_near"] for r in rows)


def test_distinct_values_of_each_column(spark):
    from suite.growing import _exact_distinct

    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (2, None, None)], "x int, y string, z double")
    assert sorted(map(tuple, _exact_distinct(df).collect())) == [("X", 2), ("Y", 1), ("Z", 0)]


def test_the_least_keys(spark):
    df = spark.range(600).select((F.col("id") / 20).cast("int").alias("a"), (F.col("id") % 20).cast("int").alias("b"), F.col("id").alias("c"), (F.col("id") * 2).cast("string").alias("d"), F.when(F.col("id") > 0, F.col("id")).alias("e"))
    assert discover_keys(df, 2) == [("c",), ("d",), ("a", "b")] and discover_keys(df.drop("c", "d"), 2) == [("a", "b")]
    assert not is_key(df, ["a"]) and not is_key(df, ["e"]) and is_key(df, ["a", "b"])
    assert discover_keys(df.limit(0)) == [] and discover_keys(df.union(df), 2) == []


def test_references(spark):
    parents = spark.range(10).select(F.col("id").alias("p_key"))
    children = spark.range(50).select(F.col("id").alias("c_id"), F.when(F.col("id") % 5 > 0, F.col("id") % 10).alias("c_key"), (F.col("id") % 12).alias("c_other"))
    found = discover_references({"p": parents, "c": children}, {"p": ["p_key"], "c": []})
    assert [tuple(r) for r in found.collect()] == [("c", "c_key", "p", "p_key", 8, True)]


def test_alias_tables_keep_the_weights():
    for weights in ([1], [5, 0, 3, 2], [1] * 7, [10**9, 1, 1], list(range(1, 200))):
        cuts, others = alias_table(weights)
        got = [0] * len(weights)
        for i, (cut, other) in enumerate(zip(cuts, others)):
            got[i] += cut
            got[other] += STEPS - cut
        total = sum(weights)
        assert all(abs(g / (STEPS * len(weights)) - w / total) < 1e-9 for g, w in zip(got, weights))
    with pytest.raises(ValueError):
        alias_table([0, 0])


@pytest.mark.parametrize("entries", [1 << 16, 4])
def test_cities_come_as_often_as_their_weights(spark, monkeypatch, entries):
    monkeypatch.setattr(location, "MAX_ENTRIES", entries)
    book = spark.createDataFrame([(f"city {c}", f"{n} street") for c in range(12) for n in range(5 + 40 * (c == 0))], "city_pcs string, full_addr string")
    weights = spark.createDataFrame([(f"city {c}", w) for c, w in enumerate([1, 2, 3, 4, 5, 50, 0, 10, 10, 5, 5, 5])], "city_pcs string, weight long")
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("x").alias("city"), F.lit("y").alias("address"))
    rule = TableRule("t", ("k",), (R("city", "City"), R("address", "FullAddress")))
    masked = mask_table(df, rule, Settings(address_book=book, city_weights=weights))
    counts = {r["city"]: r["count"] for r in masked.groupBy("city").count().collect()}
    assert "city 6" not in counts and sum(counts.values()) == 20_000
    for c, w in enumerate([1, 2, 3, 4, 5, 50, 0, 10, 10, 5, 5, 5]):
        assert abs(counts.get(f"city {c}", 0) - 200 * w) < 5 * (200 * w + 1) ** 0.5 + 1
    known = {tuple(r) for r in book.collect()}
    assert {tuple(r) for r in masked.select("city", "address").distinct().collect()} <= known
    assert sorted(masked.collect()) == sorted(mask_table(df.repartition(3), rule, Settings(address_book=book, city_weights=weights)).collect())


def test_a_profile_is_made_once_for_the_same_files(spark, orders, tmp_path, monkeypatch):
    from veilspark.operators import profile

    made = []
    one = profile.profile_columns
    monkeypatch.setattr(profile, "profile_columns", lambda *a: (made.append(a[0]), one(*a))[1])
    path = str(tmp_path / "t t.parquet")
    orders.limit(100).coalesce(1).write.parquet(path)
    first = profile.profile_tables({"t": spark.read.parquet(path)}, {"t": ["o_orderkey"]}).collect()
    assert profile.profile_tables({"t": spark.read.parquet(path)}, {"t": ["o_orderkey"]}).collect() == first and made == ["t"]
    profile.profile_tables({"t": spark.read.parquet(path)}, {"t": []})
    orders.limit(50).write.mode("overwrite").parquet(path)
    profile.profile_tables({"t": spark.read.parquet(path)}, {"t": ["o_orderkey"]})
    assert made == ["t", "t", "t"]
