"""Tables that grow: streams that go on, profiles that add up, keys found in the data."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import twin as w
from suite.base import SETTINGS, query, read
from suite.rules import PICK, SEGMENTS
from suite.schema import COLUMNS, bound_text
from veilspark.operators.discovery import discover_references, key_report
from veilspark.operators.sketches import profile_sketches
from veilspark.operators.unique import bijection
from veilspark.plans.rules import ColumnRule, TableRule
from veilspark.sources.scratch import scratch_path
from veilspark.streaming.stream import masked_rows, write_masked_stream

R = ColumnRule
CKEY = w.key("c_custkey")
_fa, _fb = bijection(10**8, "42", "customer.c_name")


@query(
    "mask_stream",
    f"""WITH numbered AS (
        SELECT *, c_custkey % 10 = 3 AS late, row_number() OVER (PARTITION BY c_custkey % 10 = 3 ORDER BY {w.hashed(CKEY)}, c_custkey) - 1 AS n FROM customer),
    u AS (SELECT *, ((n + CASE WHEN late THEN (SELECT count(*) FROM numbered WHERE NOT late) ELSE 0 END) * {_fa} + {_fb}) % 100000000 AS u FROM numbered)
    SELECT c_custkey, {w.symbols('C-########')[0].render('u')} AS c_name, {w.differing(PICK, 'customer.c_mktsegment', CKEY, 'c_mktsegment')} AS c_mktsegment FROM u""",
)
def _stream(spark, sf):
    """A stream of customers, stopped after its first files and started again when more have come: unique values are kept between the runs."""
    customer = read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    source, target = scratch_path(spark, "arrivals"), scratch_path(spark, "stream")
    rule = TableRule("customer", ("c_custkey",), (R("c_name", "StringFormat", pattern="C-########", unique=True), R("c_mktsegment", "PickRandom", pattern=SEGMENTS)))
    for some in ("c_custkey % 10 <> 3", "c_custkey % 10 = 3"):
        customer.where(some).write.mode("append").parquet(source)
        arrivals = spark.readStream.schema(customer.schema).parquet(source)
        write_masked_stream(arrivals, rule, target, SETTINGS).awaitTermination()
    return masked_rows(spark, target)


def _measure_sql(table: str) -> str:
    spans = [(n, k) for n, k in COLUMNS[table] if k in ("int", "bigint", "double", "time")]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{n.upper()}' AS column_name, count(*) AS n_rows, {bound_text('min', n, k)} AS min, {bound_text('max', n, k)} AS max, true AS distinct_near, true AS median_near FROM {table}" for n, k in spans
    )


def _in_files(df: DataFrame, least: int = 3) -> DataFrame:
    """A part for each file to be written: those of the scan, which grow with the table, or `least` where these are fewer."""
    return df if df.rdd.getNumPartitions() >= least else df.repartition(least)


def _exact_distinct(df: DataFrame) -> DataFrame:
    """name, exact: distinct values of every column, each counted for itself, so that a row is not sent once for each column, whole."""
    return reduce(DataFrame.unionByName, [df.select(F.col(n)).agg(F.lit(n.upper()).alias("name"), F.count_distinct(n).alias("exact")) for n in df.columns])


@query("profile_sketches", " UNION ALL ".join(map(_measure_sql, ("lineitem", "orders"))))
def _sketches(spark, sf):
    """Profiles of tables that got more files since the profile before: exact spans, distinct values within two percent, medians within three percent of rank."""
    out = []
    for table, split in (("lineitem", "l_orderkey % 3 = 0"), ("orders", "o_orderkey % 4 = 1")):
        source, store = scratch_path(spark, "growing"), scratch_path(spark, "profile")
        whole = read(spark, sf, table)
        for some in (split, f"NOT ({split})"):
            _in_files(whole.where(some)).write.mode("append").parquet(source)
            # The second profile opens the second files only.
            found = profile_sketches(table, spark.read.parquet(source), store)
        listed = _exact_distinct(whole)
        numbers = [f.name for f in whole.schema.fields if f.dataType.typeName() in ("integer", "long", "double")]
        joined = found.join(listed, F.col("column_name") == F.col("name"))
        # The share of rows below the sketch's median, and up to it. A profile has one row for each column.
        median = {r["column_name"]: r["quartiles"][1] for r in found.where("quartiles IS NOT NULL").collect()}
        share = lambda n, up_to: F.avg(((F.col(n) <= median[n.upper()]) if up_to else (F.col(n) < median[n.upper()])).cast("int"))
        ranks = whole.agg(*[F.struct(share(n, False).alias("a"), share(n, True).alias("b")).alias(f"r{i}") for i, n in enumerate(numbers)])
        rank = ranks.select(F.explode(F.array(*[F.struct(F.lit(n.upper()).alias("number"), F.col(f"r{i}").alias("r")) for i, n in enumerate(numbers)])).alias("x")).select("x.*")
        joined = joined.join(rank, F.col("column_name") == F.col("number"), "left").where("min IS NOT NULL AND column_name IN (" + ", ".join(f"'{n.upper()}'" for n, k in COLUMNS[table] if k in ("int", "bigint", "double", "time")) + ")")
        near = F.abs(F.col("n_distinct") - F.col("exact")) <= 0.02 * F.col("exact")
        middle = F.coalesce((F.col("r.a") <= 0.53) & (F.col("r.b") >= 0.47), F.lit(True))
        out.append(joined.select("table_name", "column_name", "n_rows", "min", "max", near.alias("distinct_near"), middle.alias("median_near")))
    return out[0].unionByName(out[1])


KEYED = ("region", "nation", "customer", "supplier", "orders", "lineitem")
_KEY_KINDS = ("int", "bigint", "string", "time")


def _sets(table: str) -> list[tuple[str, ...]]:
    names = [n for n, k in COLUMNS[table] if k in _KEY_KINDS]
    return [s for size in (1, 2) for s in combinations(names, size)]


def _unique_sql(table: str, columns: tuple[str, ...]) -> str:
    listed = ", ".join(columns)
    return (
        f"SELECT '{table}' AS table_name, '{','.join(columns)}' AS key_columns, CAST({len(columns)} AS INTEGER) AS n_columns FROM (SELECT count(*) AS n FROM {table}) "
        f"WHERE n > 0 AND NOT EXISTS (SELECT 1 FROM {table} WHERE {' OR '.join(f'{c} IS NULL' for c in columns)}) AND NOT EXISTS (SELECT 1 FROM {table} GROUP BY {listed} HAVING count(*) > 1)"
    )


@query(
    "discover_keys",
    "WITH u AS (" + " UNION ALL ".join(_unique_sql(t, s) for t in KEYED for s in _sets(t)) + ") "
    "SELECT * FROM u WHERE n_columns = 1 OR NOT EXISTS (SELECT 1 FROM u v WHERE v.table_name = u.table_name AND v.n_columns = 1 AND list_contains(string_split(u.key_columns, ','), v.key_columns))",
)
def _keys(spark, sf):
    """The least keys of one or two columns; order and line number together are none in this data."""
    return key_report({t: read(spark, sf, t) for t in KEYED})


PARENTS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey"}


def _reference_sql() -> str:
    parts = []
    for child in KEYED:
        for column, kind in COLUMNS[child]:
            for parent, key in PARENTS.items():
                if kind in ("int", "bigint") and parent != child:
                    same = "true" if column.split("_")[-1] == key.split("_")[-1] else "false"
                    parts.append(
                        f"SELECT '{child}' AS child_table, '{column}' AS child_column, '{parent}' AS parent_table, '{key}' AS parent_column, count(DISTINCT {column}) AS n_values, {same} AS same_name FROM {child} "
                        f"HAVING count({column}) > 0 AND count(*) FILTER (WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {key} FROM {parent})) = 0"
                    )
    return " UNION ALL ".join(parts)


@query("discover_references", _reference_sql())
def _references(spark, sf):
    """Columns whose values are all keys of another table, the customer of an order among them."""
    tables = {t: read(spark, sf, t) for t in KEYED}
    return discover_references(tables, {t: [k] for t, k in PARENTS.items()})
