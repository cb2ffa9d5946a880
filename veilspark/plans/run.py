"""A whole run: configure, mask, write, validate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.operators.classify import classify_columns, classify_defaults
from veilspark.operators.discovery import discover_keys
from veilspark.operators.profile import profile_tables
from veilspark.operators.scripts import insert_script, write_script
from veilspark.operators.validate import validate_columns, validation_shuffle_log, validation_summary, validation_verdict
from veilspark.operators.writeback import apply_masked_copy, write_batches
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, RuleError, Settings, TableRule
from veilspark.sources.scratch import clear_scratch, materialise, scratch_mark
from veilspark.sources.tables import scan_columns, scan_rows


def table_rules(config: DataFrame, keys: Mapping[str, Sequence[str]], target_schema: str = "") -> list[TableRule]:
    """Table rules out of configuration rows. One row per column of the schema reaches the driver, no data."""
    tables: dict[str, list[ColumnRule]] = {}
    for row in config.collect():
        rule = ColumnRule(
            row["column_name"], row["type"], ignore=row["ignore"], min=row["min"] or None, max=row["max"] or None,
            pattern=row["pattern"] or None, use_value=row["use_value"], preview=row["preview"], operator=row["operator"] or None,
            retain_null=row["retain_null"], retain_empty=row["retain_empty"],
        )
        tables.setdefault(row["table_name"], []).append(rule)
    return [TableRule(name, tuple(keys[name]), tuple(rules), target_schema=target_schema) for name, rules in sorted(tables.items())]


def mask_and_validate(
    tables: Mapping[str, DataFrame], rules: Sequence[TableRule], target: str, settings: Settings = Settings(),
    script_dialect: str | None = None,
) -> DataFrame:
    """Write the complete masked copy of every table below ``target`` and return the verdicts.

    The copy has all columns and rows of the original: columns without a rule, and rows outside a rule's row count, as they were. A rule
    that cannot be applied leaves its column as it is; validation then finds the originals, and the reason is in the exception log
    that is written beside the copies (``_exceptions``), as is a log of the batches written (``_commits``). A run that was stopped and is
    started again with the same rules goes on after the last batch logged. Validation reads what was written, not the plan that wrote it. With a dialect,
    INSERT scripts are written too. Intermediate tables, which can hold original values, are deleted at the end.
    """
    spark = next(iter(tables.values())).sparkSession
    root, verdicts, logs, mark = target.rstrip("/"), [], [], scratch_mark(spark)
    for rule in rules:
        original, failures = tables[rule.name], {}
        path = f"{root}/{rule.name}"
        copied = _copy(original, rule, settings, failures)
        log = write_batches(copied, path, rule.key, mark=f"{settings.seed}|{settings.as_of}|{settings.min_date}|{rule!r}")
        log.write.mode("overwrite").parquet(f"{root}/_commits/{rule.name}")
        copy = spark.read.parquet(path)
        if script_dialect:
            write_script(insert_script(copy, rule, script_dialect), rule.key, f"{path}.sql")
        logs += [(rule.name, column, reason) for column, reason in failures.items()]
        report = validate_columns(scan_rows(copy, rule), scan_rows(original, rule), rule)
        verdicts.append(validation_verdict(report))
    schema = "table_name string, column_name string, reason string"
    spark.createDataFrame(logs, schema).coalesce(1).write.mode("overwrite").parquet(f"{root}/_exceptions")
    # One row per configured column: the verdicts, those of shuffles by the exception log, and the summary.
    found = reduce(DataFrame.unionByName, verdicts)
    found.coalesce(1).write.mode("overwrite").parquet(f"{root}/_verdicts")
    result = spark.read.parquet(f"{root}/_verdicts")
    shuffles = validation_shuffle_log(result, spark.read.parquet(f"{root}/_exceptions"))
    shuffles.coalesce(1).write.mode("overwrite").parquet(f"{root}/_shuffle_verdicts")
    validation_summary(result).write.mode("overwrite").parquet(f"{root}/_summary")
    clear_scratch(spark, mark)
    return result


def as_written(rule: TableRule, df: DataFrame) -> TableRule:
    """The rule with the names of key and columns as the table has them: a catalog writes them in capitals."""
    names = {c.lower(): c for c in df.columns}
    own = lambda n: names.get(n.lower(), n)
    columns = tuple(replace(c, name=own(c.name), gender_column=c.gender_column and own(c.gender_column)) for c in rule.columns)
    return replace(rule, key=tuple(own(k) for k in rule.key), columns=columns)


def propose(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None, schema: str = "") -> tuple[DataFrame, dict[str, Sequence[str]]]:
    """The rule sheet that the data suggest: every table profiled once, every column classified; and the key of each table, found in the data
    where none is given."""
    known = dict(keys or {})
    for name, df in tables.items():
        if name not in known:
            known[name] = next(iter(discover_keys(df)), ())
    sheet = classify_defaults(classify_columns(profile_tables(tables, known, schema))).withColumn("description", F.lit(""))
    return materialise(sheet, "sheet"), known


def validate_copies(tables: Mapping[str, DataFrame], copies: Mapping[str, DataFrame], rules: Sequence[TableRule]) -> DataFrame:
    """Verdicts of copies that an earlier run wrote."""
    found = [validation_verdict(validate_columns(scan_rows(copies[r.name], r), scan_rows(tables[r.name], r), r)) for r in rules]
    return reduce(DataFrame.unionByName, found)


def _copy(original: DataFrame, rule: TableRule, settings: Settings, failures: dict[str, str]) -> DataFrame:
    """The whole table with the rows masked that the rule asks for."""
    if not (rule.row_count or "").strip():
        return mask_table(original, rule, settings, failures=failures)
    if any(r.name in rule.key and not r.ignore and r.type != "NoMasking" for r in rule.columns):
        raise RuleError(f"{rule.name}: a key column can be masked only in all rows")
    masked = mask_table(scan_columns(scan_rows(original, rule), rule), rule, settings, failures=failures)
    return apply_masked_copy(original, masked, rule.key)
