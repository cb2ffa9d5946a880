"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from suite import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Query -> table whose rows it handles.
HEADLINE = {
    "mask_table": "customer",
    "gen_decimal": "lineitem",
    "gen_full_name": "customer",
    "gen_bogus": "customer",
    "gen_rant": "part",
    "scramble_text": "customer",
    "scramble_decimal": "lineitem",
    "mask_right": "customer",
    "math_addition": "lineitem",
    "map_local": "orders",
    "shuffle_column": "orders",
    "mask_unique": "customer",
    "correlation_table": "orders",
    "location_record": "customer",
    "mask_blob": "pages",
    "validate_columns": "customer",
    "mask_exceptions": "part",
    "table_diff": "orders",
    "profile_minmax": "lineitem",
    "classify_columns": "lineitem",
    "rule_to_config": "lineitem",
    "apply_masked_copy": "customer",
    "insert_script": "orders",
    "parse_dates": "orders",
    "scan_row_range": "orders",
    "scan_page": "lineitem",
    "commit_log": "lineitem",
}

# "queries" are first runs, with code generation and eager steps; "warm" are second runs.


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    scratch = os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    read = lambda table: spark.read.parquet(f"{SF_DIR}/{table}.parquet")
    run(read("customer"))
    tables = sorted(set(HEADLINE.values()))
    rows = {t: read(t).count() for t in tables}
    scans = {f"scan_{t}": timed(lambda t=t: run(read(t))) for t in tables}
    queries = {name: timed(lambda name=name: run(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}
    warm = {name: timed(lambda name=name: run(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}
    rates = {name: round(rows[HEADLINE[name]] / seconds) for name, seconds in queries.items()}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "rows_per_sec": rates, "plain_scans": scans,
                "warm": warm,
            }
        )
    )


if __name__ == "__main__":
    main()
