"""Sources and sinks: scans, files, write-back, scripts, reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from suite import twin as w
from suite.base import SETTINGS, query, read
from suite.rules import CUSTOMER_RULE, MASKED_CUSTOMER, masked_customer
from suite.schema import TABLES, bounds_sql
from veilspark.functions import domains as d
from veilspark.functions.dates import parse_date_or
from veilspark.functions.draw import Draws, key_text
from veilspark.functions.redact import is_numeric
from veilspark.operators.exceptions import dry_run
from veilspark.operators.keyindex import KeyIndex
from veilspark.operators.profile import is_decimal_text, profile_minmax, row_count, whole_number
from veilspark.operators.scripts import insert_script
from veilspark.operators.writeback import apply_masked_copy, batch_size, preview, write_batches
from veilspark.plans.rules import ColumnRule, TableRule
from veilspark.sources import files
from veilspark.sources.scratch import scratch_path
from veilspark.sources.tables import flatten_rows, scan_columns, scan_page, scan_rows

R = ColumnRule

# Scans ----------------------------------------------------------------------------------------------


@query("scan_columns", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def _scan_columns(spark, sf):
    return scan_columns(read(spark, sf, "customer"), CUSTOMER_RULE)


@query("scan_limit", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1000")
def _scan_limit(spark, sf):
    return scan_rows(read(spark, sf, "orders"), TableRule("orders", ("o_orderkey",), (), row_count="1000"))


@query("scan_row_range", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 1501 OFFSET 499")
def _scan_range(spark, sf):
    return scan_rows(read(spark, sf, "orders"), TableRule("orders", ("o_orderkey",), (), row_count="500-2000"))


LINE_ORDER = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("scan_page", f"SELECT * FROM lineitem ORDER BY {', '.join(LINE_ORDER)} LIMIT 2000 OFFSET 2000")
def _scan_page(spark, sf):
    # (l_orderkey, l_linenumber) may repeat in this data; the remaining columns settle the order.
    return scan_page(read(spark, sf, "lineitem"), LINE_ORDER, 1, 2000)


@query("row_count", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def _row_count(spark, sf):
    return row_count({t: read(spark, sf, t) for t in TABLES})


# Files ----------------------------------------------------------------------------------------------


@query("scan_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def _scan_csv(spark, sf):
    path = scratch_path(spark, "csv")
    source = read(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    source.write.option("header", True).option("sep", ";").csv(path)
    return files.scan_csv(spark, path)


@query(
    "normalize_headers",
    "SELECT c_custkey AS \"Customer_Key\", nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END, '') AS \"Full_Name_\", c_mktsegment AS \"seg.ment_x\" FROM customer",
)
def _headers(spark, sf):
    blanked = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_name"))
    raw = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("Customer Key"), blanked.alias("Full  Name (!)"), F.col("c_mktsegment").alias("seg.ment-x")
    )
    return files.normalize_headers(raw)


@query("export_csv", "SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, p_name, '\"' || p_brand || '\", a\\b' AS p_brand FROM part")
def _export(spark, sf):
    path = scratch_path(spark, "export")
    quoted = F.concat(F.lit('"'), F.col("p_brand"), F.lit('", a\\b'))
    files.export_csv(read(spark, sf, "part").select("p_partkey", "p_name", quoted.alias("p_brand")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


def _config_rows(table, key):
    return f"SELECT '{table}' AS table_name, '{key}' AS primary_key, column_name, min, max, row_number() OVER (ORDER BY column_name) AS position FROM ({bounds_sql(table, spans=True)})"


@query(
    "config_columns",
    f"""SELECT table_name, primary_key, column_name, CAST(position AS INTEGER) AS position, 'RandomDec' AS type, min, max, position % 2 = 0 AS "ignore",
        CASE WHEN position % 2 = 0 THEN true ELSE false END AS preview, true AS "retainNullValues", false AS "retainEmptyStringValues", false AS "unique",
        CAST(CASE WHEN position % 3 = 0 THEN 2 ELSE 0 END AS INTEGER) AS n_mappings, CASE WHEN position % 3 = 0 THEN column_name END AS mapping_a
    FROM ({_config_rows('lineitem', 'l_orderkey')} UNION ALL {_config_rows('orders', 'o_orderkey')} UNION ALL {_config_rows('events', 'event_id')})""",
)
def _config(spark, sf):
    """A configuration file per table, made from its profile, read back into typed rows."""
    path = scratch_path(spark, "config")
    for table, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey"), ("events", "event_id")):
        flags = F.when(F.col("ordinal") % 2 == 0, True)
        column = F.struct(
            F.col("column_name").alias("name"), F.lit("randomdec").alias("type"), "min", "max", flags.alias("ignore"), flags.alias("preview"),
        )
        # One row per column of one table: as small as its schema.
        named = profile_minmax(table, read(spark, sf, table)).groupBy(F.lit(table).alias("name"), F.lit(key).alias("primaryKeyColumn")).agg(
            F.array_sort(F.collect_list(F.struct("column_name", "min", "max"))).alias("c")
        )
        columns = named.select("name", "primaryKeyColumn", F.posexplode("c").alias("i", "c")).select(
            "name", "primaryKeyColumn", (F.col("i") + 1).alias("ordinal"), "c.*"
        )
        tables = columns.groupBy("name", "primaryKeyColumn").agg(F.array_sort(F.collect_list(F.struct("ordinal", column.alias("column")))).alias("s"))
        mapping = lambda x: F.when(x["ordinal"] % 3 == 0, F.create_map(F.lit("a"), x["column"]["name"], F.lit("b"), F.lit("")))
        with_mapping = F.transform("s", lambda x: x["column"].withField("valueMappings", mapping(x)))
        config = tables.select(F.array(F.struct("name", "primaryKeyColumn", with_mapping.alias("columns"))).alias("tables"))
        config.coalesce(1).write.mode("append").json(path)
    rows = files.config_columns(spark, path)
    kept = ["table_name", "primary_key", "column_name", "position", "type", "min", "max", "ignore", "preview", "retainNullValues", "retainEmptyStringValues", "unique"]
    return rows.select(*kept, F.size("valueMappings").alias("n_mappings"), F.try_element_at("valueMappings", F.lit("a")).alias("mapping_a"))


_NESTED_SQL = "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN 0 ELSE 2 END AS lists, text, role FROM conversations"


@query(
    "flatten_rows",
    f"""SELECT conv_id, turn, CASE WHEN lists = 0 THEN NULL ELSE l END AS list_no,
        CASE WHEN lists = 0 THEN NULL WHEN l = 0 THEN split_part(text, chr(10), 1) ELSE role END AS item,
        CASE WHEN lists = 0 THEN NULL WHEN l = 0 THEN CAST(length(split_part(text, chr(10), 1)) AS INTEGER) ELSE CAST(length(role) AS INTEGER) END AS size
    FROM ({_NESTED_SQL}), (SELECT CAST(unnest([0, 1]) AS INTEGER) AS l) WHERE l = 0 OR lists = 2""",
)
def _flatten(spark, sf):
    """Turns with two child lists (their lines, their role); every fifth has none."""
    rows = read(spark, sf, "conversations")
    record = lambda text: F.struct(text.alias("item"), F.length(text).alias("size"))
    lists = F.array(F.transform(F.split("text", "\n"), record), F.array(record(F.col("role"))))
    nested = F.when(F.col("turn") % 5 != 4, lists)
    return flatten_rows(rows.select("conv_id", "turn", nested.alias("lists")), "lists")


# Reading values -------------------------------------------------------------------------------------

_STAMP = "o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 86400)"
_OKEY = w.key("o_orderkey")
_DRAWN_DATE = w.drawn(w.secs(dt.datetime(1990, 1, 1), dt.datetime(2024, 1, 1)), "orders.o_orderdate", _OKEY)
_HOUR12 = "(hour(ts) % 12)"


@query(
    "parse_dates",
    f"""SELECT o_orderkey, CASE o_orderkey % 8
        WHEN 0 THEN ts
        WHEN 1 THEN CASE WHEN day(ts) <= 12 THEN make_timestamp(year(ts), day(ts), month(ts), {_HOUR12}, minute(ts), CAST(second(ts) AS DOUBLE)) ELSE make_timestamp(year(ts), month(ts), day(ts), {_HOUR12}, minute(ts), CAST(second(ts) AS DOUBLE)) END
        WHEN 2 THEN date_trunc('day', ts)
        WHEN 3 THEN make_timestamp(year(ts), month(ts), day(ts), {_HOUR12}, minute(ts), 0.0)
        WHEN 4 THEN date_trunc('minute', ts)
        WHEN 5 THEN {_DRAWN_DATE} WHEN 6 THEN {_DRAWN_DATE} END AS parsed
    FROM (SELECT o_orderkey, {_STAMP} AS ts FROM orders)""",
)
def _parse_dates(spark, sf):
    ts = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    formats = ["M/d/yyyy h:mm:ss a", "yyyy-MM-dd hh:mm:ss", "yyyyMMdd", "M-d-yyyy h:mm", "M/d/yyyy hh:mm a"]
    text = F
    for i, pattern in enumerate(formats):
        text = text.when(F.col("o_orderkey") % 8 == i, F.date_format(ts, pattern))
    text = text.when(F.col("o_orderkey") % 8 == 5, "  ").when(F.col("o_orderkey") % 8 == 6, F.col("o_orderpriority"))
    drawn = d.seconds(SETTINGS.min_date, SETTINGS.as_of).value(Draws(SETTINGS.seed, "orders.o_orderdate", key_text(F.col("o_orderkey"))))
    rows = read(spark, sf, "orders").withColumn("text", text)
    return rows.select("o_orderkey", parse_date_or(F.col("text"), drawn).alias("parsed"))


_TEXTS = """SELECT 'events' AS source, event_id AS row_key, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN NULL WHEN 2 THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR(40)) ELSE CAST(user_id AS VARCHAR(40)) END AS text FROM events
    UNION ALL SELECT 'part', p_partkey, p_name FROM part
    UNION ALL SELECT 'lineitem', l_orderkey * 8 + l_linenumber, CASE WHEN l_linenumber = 1 THEN CAST(l_suppkey AS VARCHAR(40)) ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(40)) END FROM lineitem"""


def _texts(spark, sf):
    for table in ("events", "part", "lineitem"):
        read(spark, sf, table).createOrReplaceTempView(table)
    return spark.sql(_TEXTS)


@query("is_numeric", f"SELECT source, row_key, text IS NULL OR TRY_CAST(text AS DOUBLE) IS NOT NULL AS numeric FROM ({_TEXTS})")
def _numeric(spark, sf):
    return _texts(spark, sf).select("source", "row_key", is_numeric(F.col("text")).alias("numeric"))


@query(
    "profile_numeric_parse",
    f"SELECT source, row_key, coalesce(contains(text, '.') AND TRY_CAST(text AS DOUBLE) IS NOT NULL, false) AS is_double, CASE WHEN regexp_full_match(text, '[-+]?[0-9]+') THEN coalesce(TRY_CAST(text AS BIGINT), 0) ELSE 0 END AS number FROM ({_TEXTS})",
)
def _parse(spark, sf):
    text = F.col("text")
    return _texts(spark, sf).select("source", "row_key", is_decimal_text(text).alias("is_double"), whole_number(text).alias("number"))


# Write-back -----------------------------------------------------------------------------------------


@query(
    "apply_masked_copy",
    f"WITH m AS ({MASKED_CUSTOMER}) SELECT c.c_custkey, CASE WHEN c.c_custkey % 2 = 0 THEN m.c_name ELSE c.c_name END AS c_name, c.c_nationkey, "
    "CASE WHEN c.c_custkey % 2 = 0 THEN m.c_acctbal ELSE c.c_acctbal END AS c_acctbal, CASE WHEN c.c_custkey % 2 = 0 THEN m.c_mktsegment ELSE c.c_mktsegment END AS c_mktsegment FROM customer c JOIN m USING (c_custkey)",
)
def _copy(spark, sf):
    half = masked_customer(spark, sf).where(F.col("c_custkey") % 2 == 0).select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return apply_masked_copy(read(spark, sf, "customer"), half, ["c_custkey"])


_WRITTEN = "SELECT '{t}' AS table_name, count(*) AS n_rows, {size} AS batch_rows, true AS batches_fit, true AS enough_batches FROM {t}"
_SIZE = "CASE WHEN count(*) > 200000 THEN 100000 WHEN count(*) >= 50000 THEN 50000 ELSE {rest} END"


@query(
    "commit_log",
    " UNION ALL ".join(_WRITTEN.format(t=t, size=f"CAST({_SIZE.format(rest=rest)} AS BIGINT)") for t, rest in (("lineitem", "count(*)"), ("orders", "400"), ("customer", "count(*)"))),
)
def _commit(spark, sf):
    """Tables written in batches by key, and what their logs say: rows, the largest batch, how many."""
    logs = []
    for table, key, configured in (("lineitem", ["l_orderkey", "l_linenumber"], None), ("orders", ["o_orderkey"], 400), ("customer", ["c_custkey"], 0)):
        df, path = read(spark, sf, table), scratch_path(spark, "batches")
        size = batch_size(df.count(), configured)
        log = write_batches(df, path, key, configured).agg(F.sum("n_rows").alias("n_rows"), F.max("n_rows").alias("largest"), F.count("*").alias("n"))
        fits, enough = (F.col("largest") <= size), (F.col("n") >= F.ceil(F.col("n_rows") / size))
        logs.append(log.select(F.lit(table).alias("table_name"), "n_rows", F.lit(size).cast("bigint").alias("batch_rows"), fits.alias("batches_fit"), enough.alias("enough_batches")))
    return logs[0].unionByName(logs[1]).unionByName(logs[2])


@query(
    "commit_log_batches",
    """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders WHERE o_orderkey % 3 <> 0)
    SELECT (r - 1) // CASE WHEN n > 200000 THEN 100000 WHEN n BETWEEN 50000 AND 180000 THEN 50000 ELSE 4000 END + 1 AS batch,
        min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*) AS n_rows FROM o GROUP BY 1""",
)
def _batches(spark, sf):
    """The log of a table written in batches by key, of 4000 rows where it is small; the second run finds all of them logged."""
    orders, path = read(spark, sf, "orders").where("o_orderkey % 3 <> 0"), scratch_path(spark, "batches")
    write_batches(orders, path, ["o_orderkey"], 4000, "oracle")
    log = write_batches(orders, path, ["o_orderkey"], 4000, "oracle")
    return log.select("batch", F.col("first_key.k0").alias("first_key"), F.col("last_key.k0").alias("last_key"), "n_rows")


@query(
    "key_histogram",
    """SELECT (r - 1) // 1000 * 1000 AS rows_before, min(l_orderkey) AS first_order, max(l_orderkey) AS last_order, count(*) AS n_rows
    FROM (SELECT l_orderkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber) AS r FROM lineitem) GROUP BY 1""",
)
def _histogram(spark, sf):
    """Ranges of 1000 rows in key order, with their first and last keys."""
    index = KeyIndex.build(read(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], scratch_path(spark, "key-index"), 1000)
    return index.ranges.select(F.col("before").alias("rows_before"), F.col("low.k0").alias("first_order"), F.col("high.k0").alias("last_order"), F.col("rows").alias("n_rows"))


@query(
    "dry_run",
    f"WITH m AS ({MASKED_CUSTOMER}), j AS (SELECT m.c_name AS a1, c.c_name AS b1, m.c_acctbal AS a2, c.c_acctbal AS b2, m.c_mktsegment AS a3, c.c_mktsegment AS b3 FROM customer c JOIN m USING (c_custkey)) "
    + " UNION ALL ".join(f"SELECT 'customer' AS table_name, '{n}' AS column_name, count(*) FILTER (WHERE a{i} IS DISTINCT FROM b{i}) AS changed_rows FROM j" for i, n in ((1, "c_name"), (2, "c_acctbal"), (3, "c_mktsegment"))),
)
def _dry(spark, sf):
    return dry_run(read(spark, sf, "customer"), CUSTOMER_RULE, SETTINGS)


PREVIEW_RULE = TableRule("customer", ("c_custkey",), tuple(R(r.name, r.type, pattern=r.pattern, min=r.min, max=r.max, preview=r.name != "c_acctbal") for r in CUSTOMER_RULE.columns))


@query("preview", f"SELECT c_custkey, c_name, c_mktsegment FROM ({MASKED_CUSTOMER}) ORDER BY c_custkey LIMIT 50")
def _preview(spark, sf):
    return preview(masked_customer(spark, sf), PREVIEW_RULE, 50)


# Scripts --------------------------------------------------------------------------------------------

ORDER_RULE = TableRule("orders", ("o_orderkey",), (R("o_orderpriority", "PickRandom"), R("o_totalprice", "RandomDec")), target_schema="dbo")
_SCRIPT_ROWS = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'it''s ' || o_orderpriority END AS o_orderpriority, o_orderdate, o_orderstatus = 'O' AS is_open FROM orders)"
_OPEN = {"sqlserver": ("[", "]"), "oracle": ("", ""), "postgres": ('"', '"'), "mysql": ("`", "`")}
_COMMENT = "-- No Masking PK, PickRandom ,RandomDec "


def _script_sql(dialect, fields=None, replace=None, table="orders", rows=_SCRIPT_ROWS, key="o_orderkey", comment=_COMMENT, first_key="min", literals=None, limit=""):
    a, b = _OPEN[dialect]
    moment = "'''' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ''''"
    if dialect == "oracle":
        moment = f"'TO_DATE(' || {moment} || ', ''YYYY-MM-DD HH24:MI:SS'')'"
    literals = literals or {
        "o_orderkey": "CAST(o_orderkey AS VARCHAR)", "o_custkey": "CAST(o_custkey AS VARCHAR)",
        "o_orderpriority": "CASE WHEN o_orderpriority IS NULL THEN 'NULL' ELSE '''' || replace(o_orderpriority, '''', '''''') || '''' END",
        "o_orderdate": moment, "is_open": "CASE WHEN is_open THEN '1' ELSE '0' END",
    }
    names = list(literals)
    target = f"{a}dbo{b}.{a}{table}{b}"
    listed = ", ".join(f"{a}{n}{b}" for n in names)
    values = "'(' || " + " || ', ' || ".join(literals[n] for n in names) + " || ')'"
    single = f"{w.text(f'INSERT INTO {target}({listed}) VALUES ')} || {values} || ';'"
    head = f"INSERT INTO {target}\n\t({listed})\nVALUES \n"
    multi = f"CASE WHEN {key} = (SELECT min({key}) FROM src) THEN {w.text(head)} ELSE ',' END || {values}"
    if dialect == "oracle":
        body, ends = single, [(0, f"REM INSERTING into {target}\nSET DEFINE OFF"), (2, comment)]
    elif dialect == "sqlserver":
        body = f"CASE WHEN (SELECT count(*) FROM src) > 1000 THEN {single} ELSE {multi} END"
        on = "SET ANSI_NULLS ON\nGO\nSET QUOTED_IDENTIFIER ON\nGO\nSET ANSI_WARNINGS OFF\nGO"
        ends = [(0, on), (2, comment + "\nSET ANSI_WARNINGS ON\nGO")]
    else:
        body, ends = multi, [(2, ";\n" + comment)]
    fixed = " UNION ALL ".join(f"SELECT '{dialect}', CAST({part} AS INTEGER), NULL, {w.text(text)}" for part, text in ends)
    return f"SELECT '{dialect}' AS dialect, CAST(1 AS INTEGER) AS part, {key}, {body} AS statement FROM src UNION ALL {fixed}"


@query("insert_script", f"WITH src AS {_SCRIPT_ROWS} " + " UNION ALL ".join(_script_sql(x) for x in _OPEN))
def _script(spark, sf):
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("it's "), F.col("o_orderpriority")))
    rows = read(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", priority.alias("o_orderpriority"), "o_orderdate", (F.col("o_orderstatus") == "O").alias("is_open")
    )
    scripts = [insert_script(rows, ORDER_RULE, x).select(F.lit(x).alias("dialect"), "part", "o_orderkey", "statement") for x in _OPEN]
    result = scripts[0]
    for script in scripts[1:]:
        result = result.unionByName(script)
    return result


@query(
    "insert_script_fields",
    "WITH src AS (SELECT s_suppkey, s_name, s_nationkey FROM supplier) "
    + _script_sql("postgres", table="supplier", key="s_suppkey", comment="-- No Masking PK, Company ", literals={"s_suppkey": "CAST(s_suppkey AS VARCHAR)", "s_name": "'NULL'", "s_nationkey": "CAST(s_nationkey AS VARCHAR)"})
    + " UNION ALL "
    + _script_sql("mysql", table="supplier", key="s_suppkey", comment="-- No Masking PK, Company ", literals={"s_suppkey": "CAST(s_suppkey AS VARCHAR)", "s_name": "'upper(''x'')'", "s_nationkey": "CAST(s_nationkey AS VARCHAR)"}),
)
def _script_fields(spark, sf):
    rule = TableRule("supplier", ("s_suppkey",), (R("s_name", "Company"),), target_schema="dbo")
    rows = read(spark, sf, "supplier")
    parts = [
        insert_script(rows, rule, x, ["S_ACCTBAL"], "S_NAME", value).select(F.lit(x).alias("dialect"), "part", "s_suppkey", "statement")
        for x, value in (("postgres", None), ("mysql", "upper('x')"))
    ]
    return parts[0].unionByName(parts[1])
