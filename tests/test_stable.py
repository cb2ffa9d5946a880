"""Values and writes that outlast a run: permuted keys, numbers given once, batches that go on, the key histogram."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.functions.permute import permuted, permuted_text, walk_steps
from veilspark.operators import keyindex
from veilspark.operators.assignment import AssignmentLog
from veilspark.operators.keyindex import KeyIndex, slice_of
from veilspark.operators.mapping import apply_key_map, correlation_table
from veilspark.operators.writeback import commit_log, write_batches
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, RuleError, Settings, TableRule
from veilspark.sources.tables import scan_page
from veilspark.streaming.stream import mask_stream

R = ColumnRule


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Permuted keys


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000, 4999])
def test_every_number_gets_another_place(spark, size):
    got = [r[0] for r in spark.range(size).select(permuted(F.col("id"), size, "42", "s")).collect()]
    assert sorted(got) == list(range(size)) and (size < 50 or sum(i == v for i, v in enumerate(got)) < 10)


def test_walks_end():
    assert all(walk_steps(n) <= n for n in range(1, 200)) and walk_steps(100) == 0
    assert 0 < walk_steps(10**12 + 39) < 20


def test_text_keeps_its_form_and_stays_distinct(spark):
    r = random.Random(3)
    texts = {f"{r.choice('ABC')}{r.choice('xyz')}-{r.randrange(100):02d}/{r.choice(['', 'é', '#'])}{r.randrange(10)}" for _ in range(3000)} | {"", "--", "7", "a" * 45 + "9", "a" * 45 + "8"}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r["t"]: r["p"] for r in df.select("t", permuted_text(F.col("t"), "42", "s").alias("p")).collect()}
    assert got.pop(None) is None and len(set(got.values())) == len(texts)
    kind = lambda c: "9" if c.isascii() and c.isdigit() else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else c
    assert all([*map(kind, t)] == [*map(kind, p)] for t, p in got.items())
    whole = {r[0] for r in spark.range(100).select(permuted_text(F.format_string("K%02d", F.col("id")), "1", "q")).collect()}
    assert len(whole) == 100


def test_more_keys_change_no_value_and_nothing_is_shuffled(spark, orders):
    place = ("custkey", Settings(), 10**6, 10**7)
    more = orders.select("o_orderkey", "o_custkey").union(spark.range(15).select((F.col("id") + 10**6).alias("a"), (F.col("id") * 7 + 9 * 10**6).alias("b")))
    before = {tuple(r) for r in apply_key_map(orders.select("o_orderkey", "o_custkey"), "o_custkey", *place).collect()}
    after = apply_key_map(more, "o_custkey", *place)
    assert before <= {tuple(r) for r in after.collect()} and "Exchange" not in plan(after)
    table = {r["before"]: r["after"] for r in correlation_table(more, "o_custkey", *place).collect()}
    assert all(table[b] == a for (_, a), (_, b) in zip(sorted(map(tuple, after.collect())), sorted(map(tuple, more.collect()))))
    assert len(set(table.values())) == len(table)
    with pytest.raises(RuleError, match="are given"):
        correlation_table(more, "o_custkey", "custkey", Settings(), 0, 1000)
    with pytest.raises(Exception, match="outside of its 1000 numbers"):
        apply_key_map(more, "o_custkey", "custkey", Settings(), 0, 1000).collect()


def test_keys_are_mapped_on_a_stream_as_in_a_table(spark, customer, tmp_path):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "StringFormat", unique=True, global_mapping=True), R("c_nationkey", "RandomInt", max="24", unique=True, local_mapping=True)))
    customer.write.parquet(str(tmp_path / "in"))
    stream = mask_stream(spark.readStream.schema(customer.schema).parquet(str(tmp_path / "in")), rule)
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = mask_table(customer, rule)
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(expected.collect())
    assert expected.select("c_name").distinct().count() == customer.count() and expected.select("c_nationkey").distinct().count() == customer.select("c_nationkey").distinct().count()


def test_many_supplied_values_are_joined(spark, customer, monkeypatch):
    given = {f"Customer#{k:09d}": f"given {k}" for k in range(0, 3000, 2)}
    rule = lambda values: TableRule("customer", ("c_custkey",), (R("c_name", "FullName", local_mapping=True, value_mappings=values), R("c_mktsegment", "Scramble")))
    table = spark.createDataFrame(list(given.items()), "a string, b string")
    results = [sorted(mask_table(customer, rule(v)).collect()) for v in (given, table)]
    few = {k: v for k, v in given.items() if k in {r[0] for r in customer.select("c_name").collect()}}
    assert 0 < len(few) <= 1000 and results[0] == results[1] == sorted(mask_table(customer, rule(few)).collect())
    names = {r["c_custkey"]: r["c_name"] for r in results[0]}
    assert results[0][0].asDict().keys() == set(customer.columns)
    assert all(names[r["c_custkey"]] == given[r["c_name"]] for r in customer.collect() if r["c_name"] in given)
    from veilspark.sources import scratch

    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 0)
    assert sorted(mask_table(customer, rule(table)).collect()) == results[0]


# Numbers given once


def test_values_of_an_earlier_delivery_stand(spark, customer, tmp_path):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "StringFormat", pattern="??####", unique=True),))
    settings = Settings(assignments=str(tmp_path / "given"))
    parts = [customer.where("c_custkey % 3 = 0"), customer.where("c_custkey % 3 <> 1"), customer, customer.where("c_custkey < 50")]
    seen: dict = {}
    for part in parts:
        got = {r["c_custkey"]: r["c_name"] for r in mask_table(part, rule, settings).collect()}
        assert len(got) == part.count() and all(seen.get(k, v) == v for k, v in got.items())
        seen |= got
    assert len(set(seen.values())) == customer.count()
    log = AssignmentLog(spark, str(tmp_path / "given" / "customer.c_name"))
    assert len(log.versions()) == 3 and sorted(r["n"] for r in log.given().collect()) == list(range(customer.count()))


def test_a_version_that_was_not_finished_gives_nothing(spark, customer, tmp_path):
    log = AssignmentLog(spark, str(tmp_path / "log"))
    log.extended(customer.limit(10), ["c_custkey"])
    customer.limit(20).write.parquet(str(tmp_path / "log" / "000001"))
    assert log.given().count() == 10
    assert sorted(r["n"] for r in log.extended(customer, ["c_custkey"]).collect()) == list(range(customer.count()))
    with pytest.raises(RuleError, match="are given"):
        log.extended(spark.range(10**4).select(F.col("id").alias("c_custkey")), ["c_custkey"], capacity=500)
    assert log.given().count() == customer.count()


# Batches that go on


def test_a_write_that_was_stopped_goes_on(spark, orders, tmp_path, monkeypatch):
    from veilspark.operators import writeback

    path, made = str(tmp_path / "t"), []
    write = writeback._write_wave
    def dies(*args):
        if len(made) == 3:
            # The job has written its files, but the log does not know.
            write(*args)
            raise KeyboardInterrupt
        made.append(args)
        return write(*args)
    monkeypatch.setattr(writeback, "_write_wave", dies)
    with pytest.raises(KeyboardInterrupt):
        write_batches(orders, path, ["o_orderkey"], 100, wave=2)
    assert commit_log(spark, path).count() == 6 and spark.read.parquet(path).count() == 800
    jobs = []
    monkeypatch.setattr(writeback, "_write_wave", lambda *a: (jobs.append(a), write(*a)))
    log = write_batches(orders, path, ["o_orderkey"], 100, wave=2).orderBy("batch").collect()
    assert len(jobs) == 5 and sorted(spark.read.parquet(path).collect()) == sorted(orders.collect())
    keys = sorted(r[0] for r in orders.select("o_orderkey").collect())
    assert [(r["first_key"][0], r["last_key"][0], r["n_rows"]) for r in log] == [(keys[i], keys[min(i + 99, len(keys) - 1)], min(100, len(keys) - i)) for i in range(0, len(keys), 100)]
    jobs.clear()
    write_batches(orders, path, ["o_orderkey"], 100, wave=2)
    assert not jobs
    with pytest.raises(RuleError, match="other rules"):
        write_batches(orders, path, ["o_orderkey"], 100, mark="another seed")


def test_batches_of_repeated_keys_and_of_no_rows(spark, tmp_path):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"))
    log = write_batches(df, str(tmp_path / "a"), ["k", "v"], 90)
    assert max(r["n_rows"] for r in log.collect()) <= 90 and sorted(spark.read.parquet(str(tmp_path / "a")).collect(), key=str) == sorted(df.collect(), key=str)
    assert write_batches(df.limit(0), str(tmp_path / "b"), ["k"], 90).count() == 0 and spark.read.parquet(str(tmp_path / "b")).schema == df.schema


# The key histogram


def test_pages_share_one_index_and_open_few_files(spark, orders, tmp_path, monkeypatch):
    path = str(tmp_path / "orders")
    orders.repartitionByRange(8, "o_orderkey").write.parquet(path)
    table = spark.read.parquet(path)
    built = []
    build = KeyIndex.build
    monkeypatch.setattr(KeyIndex, "build", staticmethod(lambda *a, **k: (built.append(a), build(*a, **k))[1]))
    pages = [scan_page(table, ["o_orderkey"], j, 100) for j in range(10)]
    keys = sorted(r[0] for r in orders.select("o_orderkey").collect())
    assert len(built) == 1 and [r["o_orderkey"] for p in pages for r in p.orderBy("o_orderkey").collect()] == keys[:1000]
    index = KeyIndex.build(table, ["o_orderkey"], str(tmp_path / "index"), limit=50)
    assert index.ranges.agg(F.max("rows")).first()[0] <= 50
    page = scan_page(table, ["o_orderkey"], 3, 100, index)
    assert len(page.inputFiles()) <= 2 < len(table.inputFiles()) == 8
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey" in plan(page)


@pytest.mark.parametrize("part_rows", [10**6, 300])
def test_slices_with_nulls_ties_and_all_sizes(spark, tmp_path, monkeypatch, part_rows):
    monkeypatch.setattr(keyindex, "ROWS_PER_PART", part_rows)
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 7).alias("a"), (F.col("id") % 500).alias("b"))
    index = KeyIndex.build(df, ["a", "b"], str(tmp_path / "i"), limit=100)
    keys = sorted((r["a"] is not None, r["a"] or 0, r["b"]) for r in df.collect())
    for first, last in [(0, 0), (0, 99), (99, 101), (150, 1700), (0, 1999), (1950, 2500), (3000, 3001)]:
        got = sorted((r["a"] is not None, r["a"] or 0, r["b"]) for r in slice_of(df, index, first, last).collect())
        assert got == keys[first : last + 1]
    one = spark.range(1000).select(F.lit(5).alias("z"))
    index = KeyIndex.build(one, ["z"], str(tmp_path / "j"), limit=70)
    assert [slice_of(one, index, a, b).count() for a, b in ((0, 9), (65, 75), (100, 899), (0, 5000))] == [10, 11, 800, 1000]
