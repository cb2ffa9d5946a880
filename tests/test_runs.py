"""Configuration files, whole runs, scripts, streams."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from veilspark.operators.classify import classify_columns, classify_defaults
from veilspark.operators.configure import rule_to_config
from veilspark.operators.profile import profile_columns
from veilspark.operators.scripts import insert_script, write_script
from veilspark.operators.exceptions import mask_exceptions
from veilspark.operators.validate import validate_columns, validation_summary, validation_verdict
from veilspark.operators.writeback import apply_masked_copy, batch_size
from veilspark.plans.rules import ColumnRule as R
from veilspark.plans.rules import RuleError, Settings, TableRule
from veilspark.plans.run import mask_and_validate, table_rules, validate_copies
from veilspark.sources.files import detect_separator, load_config, scan_csv
from veilspark.sources.scratch import materialise, scratch_root
from veilspark.streaming.stream import mask_stream


def test_configuration_file(spark, tmp_path):
    columns = [
        {"name": "a", "type": "randomint", "Min": 1, "max": 9},
        {"name": "b", "type": "Bogus", "StringFormatpattern": "{{NAME.FULLNAME}}", "retainNullValues": False, "unique": True},
        {"name": "c", "type": "Computed", "sourceColumns": ["a", "b"], "separator": "-"},
    ]
    path = tmp_path / "config.json"
    path.write_text("﻿" + json.dumps({"Tables": [{"name": "t", "primaryKeyColumn": "k", "rowCount": "5-9", "columns": columns}]}))
    (table,) = load_config(spark, str(path))
    a, b, c = table.columns
    assert (table.key, table.row_count) == (("k",), "5-9")
    assert (a.type, a.min, a.max, a.retain_null) == ("RandomInt", "1", "9", True)
    assert (b.pattern, b.retain_null, b.unique) == ("{{NAME.FULLNAME}}", False, True)
    assert c.source_columns == ("a", "b")
    path.write_text(json.dumps({"tables": [{"name": "t", "columns": [{"name": "a", "type": "Nonsense"}]}]}))
    with pytest.raises(RuleError):
        load_config(spark, str(path))


def test_profile_to_validated_copy(spark, customer, tmp_path):
    """The whole way: profile, classify, configure, mask, write, validate."""
    people = customer.select(F.col("c_custkey").alias("PERSON_ID"), F.col("c_name").alias("FIRST_NAME"), F.col("c_acctbal").alias("BONUS_AMOUNT"), F.col("c_mktsegment").alias("SEGMENT"))
    profile = profile_columns("people", people, ["PERSON_ID"], "app")
    sheet = classify_defaults(classify_columns(profile)).withColumn("description", F.lit(""))
    rules = table_rules(rule_to_config(sheet), {"people": ["PERSON_ID"]}, "masked")
    assert {r.name: r.type for r in rules[0].columns} == {"FIRST_NAME": "FirstName", "BONUS_AMOUNT": "RandomDec", "SEGMENT": "Shuffle"}
    verdict = mask_and_validate({"people": people}, rules, str(tmp_path / "out"), script_dialect="postgres")
    summary = validation_summary(verdict).first()
    assert (summary["table_count"], summary["column_count"], summary["total_fail"]) == (1, 3, 0)
    assert str(summary["accuracy_pct"]) == "100.00"
    copy = spark.read.parquet(str(tmp_path / "out" / "people"))
    assert copy.schema == people.schema and copy.count() == people.count()
    lines = spark.read.text(str(tmp_path / "out" / "people.sql")).count()
    assert lines > people.count()


def test_the_copy_is_complete(spark, customer, tmp_path):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "FullName"), R("c_mktsegment", "StringFormat", pattern="?####")), row_count="10")
    verdict = mask_and_validate({"customer": customer}, [rule], str(tmp_path / "out"))
    assert {(r["rows_masked"], r["rows_missing"], r["rows_extra"], r["result"]) for r in verdict.collect()} == {(10, 0, 0, "PASS")}
    copy = spark.read.parquet(str(tmp_path / "out" / "customer"))
    assert copy.schema == customer.schema and copy.count() == customer.count()
    untouched = ["c_custkey", "c_nationkey", "c_acctbal"]
    assert sorted(copy.select(untouched).collect()) == sorted(customer.select(untouched).collect())
    beyond = lambda df: sorted(df.orderBy("c_custkey").collect()[10:])
    assert beyond(copy) == beyond(customer)
    committed = spark.read.parquet(str(tmp_path / "out" / "_commits" / "customer")).collect()
    assert sum(r["n_rows"] for r in committed) == customer.count() and [r["batch"] for r in committed] == list(range(1, len(committed) + 1))
    again = validate_copies({"customer": customer}, {"customer": copy}, [rule])
    assert sorted(again.collect()) == sorted(verdict.collect())


def test_a_bad_rule_does_not_end_the_run(spark, customer, tmp_path):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "FullName"), R("c_mktsegment", "State", pattern="Nowhere"), R("c_acctbal", "LastName")))
    verdict = {r["column_name"]: r["result"] for r in mask_and_validate({"customer": customer}, [rule], str(tmp_path / "out")).collect()}
    assert verdict == {"c_name": "PASS", "c_mktsegment": "FAIL", "c_acctbal": "PASS"}
    (logged,) = spark.read.parquet(str(tmp_path / "out" / "_exceptions")).collect()
    assert logged["column_name"] == "c_mktsegment" and "unknown country" in logged["reason"]
    reasons = {(r["column_name"], r["n"]): r["reason"] for r in mask_exceptions(customer, rule).collect()}
    assert reasons[("c_mktsegment", customer.count())].startswith("rule not applied")
    assert reasons[("c_acctbal", customer.count())] == "value does not fit the column type"


def test_validation_does_not_pass_by_accident(customer):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "FullName"), R("c_custkey", "NoMasking")))
    judged = lambda copy: {(r["result"], r["rows_missing"], r["rows_extra"], r["keys_repeated"]) for r in validation_verdict(validate_columns(copy, customer, rule)).collect()}
    rows = customer.count()
    assert judged(customer.withColumn("c_custkey", F.col("c_custkey") + 10**6)) == {("FAIL", rows, rows, 0)}
    assert judged(customer.where("c_custkey < 10")) == {("FAIL", rows - 10, 0, 0)}
    assert judged(customer.unionByName(customer.where("c_custkey = 1"))) == {("FAIL", 0, 0, 1)}


def test_a_repeated_key_stops_the_write_back(customer):
    with pytest.raises(Exception, match="several masked rows"):
        apply_masked_copy(customer, customer.unionByName(customer.limit(1)), ["c_custkey"]).collect()


def test_intermediate_tables_are_deleted(spark, customer, tmp_path):
    folder = Path(scratch_root(spark))
    before = set(folder.iterdir())
    kept = materialise(customer.select("c_custkey"), "mine")
    mask_and_validate({"customer": customer}, [TableRule("customer", ("c_custkey",), (R("c_mktsegment", "Shuffle"),))], str(tmp_path / "out"))
    assert [p.name[:4] for p in set(folder.iterdir()) - before] == ["mine"] and kept.count() == customer.count()


def test_scripts_quote_and_write_bytes(spark):
    df = spark.createDataFrame([(1, bytearray(b"\x01\xff"), "2020-03-04 03:04:05")], 'k int, `a"b` binary, t string')
    rule = TableRule("p", ("k",), (R("t", "NoMasking"),))
    (row,) = insert_script(df, rule, "postgres").where("part = 1").collect()
    assert row["statement"] == 'INSERT INTO "p"\n\t("k", "a""b", "t")\nVALUES \n(1, \'\\x01FF\'::bytea, \'2020-03-04 03:04:05\')'
    (row,) = insert_script(df, rule, "oracle").where("part = 1").collect()
    assert "HEXTORAW('01FF')" in row["statement"]


def test_script_text(spark, tmp_path):
    df = spark.createDataFrame([(2, "O'Brien", None), (1, "1/2/2020 3:04:05 PM", True)], "k int, t string, b boolean")
    rule = TableRule("p", ("k",), (R("t", "FullName"), R("b", "NoMasking")), target_schema="s")
    script = insert_script(df, rule, "mysql").orderBy("part", "k").collect()
    assert [r["statement"] for r in script] == [
        "INSERT INTO `s`.`p`\n\t(`k`, `t`, `b`)\nVALUES \n(1, '2020-01-02 15:04:05', 1)", ",(2, 'O''Brien', NULL)", ";\n-- No Masking PK, FullName ,NoMasking ",
    ]
    oracle = [r["statement"] for r in insert_script(df, rule, "oracle").where("part = 1").orderBy("k").collect()]
    assert oracle[0] == "INSERT INTO s.p(k, t, b) VALUES (1, TO_DATE('2020-01-02 15:04:05', 'YYYY-MM-DD HH24:MI:SS'), 1);"
    empty = insert_script(df.limit(0), rule, "sqlserver").collect()
    assert any("DEFAULT VALUES" in r["statement"] for r in empty)
    write_script(insert_script(df, rule, "postgres"), ["k"], str(tmp_path / "script"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "script").glob("part-*")))
    assert text.startswith('INSERT INTO "s"."p"') and text.rstrip("\n").endswith("-- No Masking PK, FullName ,NoMasking ")


@pytest.mark.parametrize("separator", [",", ";", "\t", "|", "#"])
def test_separator(spark, tmp_path, separator):
    path = tmp_path / "t.txt"
    path.write_text(separator.join("abc") + "\n" + separator.join("123") + "\n")
    assert detect_separator(spark, str(path)) == separator
    assert scan_csv(spark, str(path)).collect() == [("1", "2", "3")]


def test_batch_sizes():
    assert [batch_size(n) for n in (200_001, 200_000, 50_000, 49_999)] == [100_000, 50_000, 50_000, 49_999]
    assert batch_size(190_000, 700, "oracle") == 700 and batch_size(100, 0) == 100 and batch_size(100, 30) == 30


def test_a_stream_is_masked_like_a_table(spark, customer, tmp_path):
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "FullName"), R("c_mktsegment", "Scramble")))
    source = tmp_path / "in"
    customer.write.parquet(str(source))
    stream = mask_stream(spark.readStream.schema(customer.schema).parquet(str(source)), rule)
    query = stream.writeStream.format("memory").queryName("masked_customers").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    from veilspark.plans.mask import mask_table

    got = sorted(spark.table("masked_customers").collect())
    assert got == sorted(mask_table(customer, rule).collect())
    with pytest.raises(RuleError):
        mask_stream(customer, TableRule("customer", ("c_custkey",), (R("c_name", "Shuffle"),)))


def test_command_line(spark, sf_dir, tmp_path):
    from veilspark.__main__ import run

    columns = [{"name": "s_name", "type": "Company"}, {"name": "s_acctbal", "type": "RandomDec", "min": 0, "max": 5}]
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"tables": [{"name": "supplier", "primaryKeyColumn": "s_suppkey", "columns": columns}]}))
    changes = run(spark, [str(config), sf_dir, str(tmp_path / "none"), "--dry-run"]).collect()
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    assert {r["column_name"]: r["changed_rows"] for r in changes} == {"s_name": suppliers, "s_acctbal": suppliers}
    assert not (tmp_path / "none").exists()
    verdict = run(spark, [str(config), sf_dir, str(tmp_path / "out"), "--seed", "s3cret"]).collect()
    assert [r["result"] for r in verdict] == ["PASS", "PASS"]


def test_equal_rows_and_iso_texts_in_scripts(spark):
    rule = TableRule("p", ("k",), (R("t", "NoMasking"),))
    df = spark.createDataFrame([(1, "2020-03-04 03:04:05"), (1, "2020-03-04 03:04:05"), (1, "a"), (2, "1/2/2020 3:04 PM")], "k int, t string")
    rows = [r["statement"] for r in insert_script(df, rule, "mysql").where("part = 1").orderBy("k", F.col("statement").startswith(","), "statement").collect()]
    assert rows == ["INSERT INTO `p`\n\t(`k`, `t`)\nVALUES \n(1, '2020-03-04 03:04:05')", ",(1, '2020-03-04 03:04:05')", ",(1, 'a')", ",(2, '2020-01-02 15:04:00')"]
    oracle = {r["statement"] for r in insert_script(df, rule, "oracle").where("part = 1 AND k = 1").collect()}
    assert "INSERT INTO p(k, t) VALUES (1, TO_DATE('2020-03-04 03:04:05', 'YYYY-MM-DD HH24:MI:SS'));" in oracle


def test_a_folder_of_two_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id;näme\n1;Zoë €\n2;�\n".encode())
    (tmp_path / "b.csv").write_bytes("id;näme\n3;café € “q”\n".encode("windows-1252"))
    got = scan_csv(spark, str(tmp_path))
    assert got.columns == ["id", "näme"] and sorted(map(tuple, got.collect())) == [("1", "Zoë €"), ("2", "�"), ("3", "café € “q”")]
    assert scan_csv(spark, str(tmp_path / "b.csv")).collect() == [("3", "café € “q”")]


def test_one_command_from_profile_to_copy(spark, sf_dir, tmp_path):
    from veilspark.__main__ import run

    out = str(tmp_path / "out")
    sheet = run(spark, ["profile", sf_dir, str(tmp_path / "sheet"), "--tables", "supplier", "--sheet-only"])
    assert sheet.where("column_name = 'S_SUPPKEY'").first()["pk_constraint"] == "S_SUPPKEY" and not (tmp_path / "sheet" / "supplier").exists()
    verdict = run(spark, ["profile", sf_dir, out, "--tables", "supplier", "customer=c_custkey"])
    assert {r["table_name"] for r in verdict.collect()} == {"supplier", "customer"}
    assert spark.read.parquet(f"{out}/customer").count() == spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    summary = spark.read.parquet(f"{out}/_summary").first()
    assert summary["column_count"] == verdict.count() and spark.read.parquet(f"{out}/_mapping").count() >= verdict.count()
    assert spark.read.parquet(f"{out}/_shuffle_verdicts").count() == verdict.count()


def test_a_run_that_was_stopped_is_started_again(spark, customer, orders, tmp_path, monkeypatch):
    from veilspark.plans import run as runs

    rules = [TableRule("customer", ("c_custkey",), (R("c_name", "FullName"),)), TableRule("orders", ("o_orderkey",), (R("o_orderpriority", "FullName"),))]
    tables, out = {"customer": customer, "orders": orders}, str(tmp_path / "out")
    validate = runs.validate_columns

    def dies(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(runs, "validate_columns", dies)
    with pytest.raises(KeyboardInterrupt):
        mask_and_validate(tables, rules, out)
    written = {p.name for p in (tmp_path / "out" / "customer").glob("part-*")}
    monkeypatch.setattr(runs, "validate_columns", validate)
    verdict = mask_and_validate(tables, rules, out)
    assert {r["result"] for r in verdict.collect()} == {"PASS"} and {p.name for p in (tmp_path / "out" / "customer").glob("part-*")} == written
    assert spark.read.parquet(f"{out}/orders").count() == orders.count()
    with pytest.raises(RuleError, match="other rules"):
        mask_and_validate(tables, rules, out, Settings(seed="another"))
