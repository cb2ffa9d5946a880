"""Compare every registered query with its SQL in DuckDB: names, row counts, values."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from suite import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def plain(value):
    """A value in a form both engines share; the type stays visible."""
    if isinstance(value, float):
        return ("f", "nan" if math.isnan(value) else f"{value:.9g}")
    if isinstance(value, Decimal):
        return ("d", f"{value.normalize():f}")
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, int):
        return ("i", value)
    if isinstance(value, (dt.datetime, dt.date)):
        return ("t", str(value))
    if isinstance(value, (bytes, bytearray)):
        return ("x", bytes(value))
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return ("s", tuple((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return ("l", tuple(plain(v) for v in value))
    return ("n", "") if value is None else ("v", value)


def normalised(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str | None:
    """None when the two sides agree, else what differs."""
    got = QUERIES[name](spark, sf_dir)
    rows = got.collect()
    if name not in ORACLES:
        return None if rows else "no rows"
    cursor = con.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    if sorted(names) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(names)}"
    a, b = normalised(got.columns, rows), normalised(names, cursor.fetchall())
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; only spark {[x for x in a if x not in set(b)][:2]}; only sql {[x for x in b if x not in set(a)][:2]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first:\n  spark {bad[0][0]}\n  sql   {bad[0][1]}"
    return None if a else "both empty"


def main(sf_dir: str, wanted: list[str]) -> int:
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failures = connect(sf_dir), 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name)
        except Exception as error:  # a broken query must not hide the others
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{'' if name in ORACLES else ' (rows only)'}{': ' + problem if problem else ''}", flush=True)
    print(f"{len(wanted or QUERIES)} queries, {failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
