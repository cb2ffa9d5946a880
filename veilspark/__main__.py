"""Mask the tables of a folder as a configuration file says: ``python -m veilspark config.json in/ out/``. With ``profile`` in place of the
file the rules come from the data: profile, rule sheet, configuration, masked copy and verdicts in one go (``--sheet-only`` stops at the sheet)."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from veilspark.operators.exceptions import dry_run
from veilspark.operators.configure import rule_to_config
from veilspark.operators.scripts import DIALECTS
from veilspark.operators.writeback import column_mapping_report
from veilspark.plans.rules import Settings
from veilspark.plans.run import as_written, mask_and_validate, propose, table_rules, validate_copies
from veilspark.sources.files import address_book, export_csv, load_config
from veilspark.sources.scratch import materialise


def run(spark: SparkSession, arguments: Sequence[str]) -> DataFrame:
    """Verdicts of a run, or the changes a dry run counts."""
    parser = argparse.ArgumentParser(prog="veilspark", description=__doc__)
    parser.add_argument("config", help="JSON configuration file, or the word profile")
    parser.add_argument("source", help="folder with one entry <table>.parquet per table")
    parser.add_argument("target", help="folder for the masked copies")
    parser.add_argument("--seed", default=Settings.seed, help="secret of the draws")
    places = parser.add_mutually_exclusive_group()
    places.add_argument("--address-book", help="CSV files that location columns are filled from")
    places.add_argument("--country", help="country whose places location columns are filled from")
    parser.add_argument("--dialect", choices=sorted(DIALECTS), help="also write INSERT scripts")
    parser.add_argument("--dry-run", action="store_true", help="write nothing, count what would change")
    parser.add_argument("--validate", action="store_true", help="write nothing, judge the copies that are in the target")
    parser.add_argument("--tables", nargs="*", help="with profile: the tables, with their key if it is known, as name or name=column,column")
    parser.add_argument("--sheet-only", action="store_true", help="with profile: write the rule sheet below the target, mask nothing")
    options = parser.parse_args(arguments)
    book = address_book(spark, options.address_book) if options.address_book else None
    settings = Settings(seed=options.seed, address_book=book, country=options.country)
    if options.config == "profile":
        named = dict(t.split("=", 1) if "=" in t else (t, "") for t in options.tables or [])
        if not named:
            parser.error("profile needs --tables")
        tables = {t: spark.read.parquet(f"{options.source.rstrip('/')}/{t}.parquet") for t in named}
        sheet, keys = propose(tables, {t: k.split(",") for t, k in named.items() if k})
        export_csv(sheet.coalesce(1), f"{options.target.rstrip('/')}/_sheet")
        if options.sheet_only:
            return sheet
        config = materialise(rule_to_config(sheet), "config")
        column_mapping_report(config, sheet).write.mode("overwrite").parquet(f"{options.target.rstrip('/')}/_mapping")
        rules = [as_written(r, tables[r.name]) for r in table_rules(config, keys) if r.key and r.columns]
        return mask_and_validate({r.name: tables[r.name] for r in rules}, rules, options.target, settings, options.dialect)
    rules = load_config(spark, options.config)
    tables = {r.name: spark.read.parquet(f"{options.source.rstrip('/')}/{r.name}.parquet") for r in rules}
    if options.dry_run:
        return reduce(DataFrame.unionByName, [dry_run(tables[r.name], r, settings) for r in rules])
    if options.validate:
        copies = {r.name: spark.read.parquet(f"{options.target.rstrip('/')}/{r.name}") for r in rules}
        return validate_copies(tables, copies, rules)
    return mask_and_validate(tables, rules, options.target, settings, options.dialect)


if __name__ == "__main__":
    run(SparkSession.builder.appName("veilspark").getOrCreate(), None).show(1000, truncate=False)
