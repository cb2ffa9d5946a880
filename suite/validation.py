"""Validation queries: masked customers against the originals, verdicts, summaries, table differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.base import SETTINGS, query, read
from suite.rules import CUSTOMER_RULE, MASKED_CUSTOMER, masked_customer
from veilspark.operators.exceptions import mask_exceptions
from veilspark.operators.validate import (
    surviving_values, table_diff, validate_columns, validation_row_counts, validation_shuffle_log, validation_summary, validation_verdict,
)
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, TableRule

R = ColumnRule

# Columns that leak on purpose beside columns that do not.
LEAKY_RULE = TableRule(
    "customer", ("c_custkey",),
    (
        *CUSTOMER_RULE.columns, R("c_nationkey", "NoMasking"), R("kept", "FullName", ignore=True), R("town", "City", pattern="BC"),
        R("long_name", "exception", pattern="17"), R("fixed", "PickRandom", pattern="A"), R("constant", "Shuffle"), R("blank", "Scramble"),
    ),
    schema="app",
)
_EXTRA = [
    "c_name AS kept", "'Trail' AS town", "CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'short' END AS long_name",
    "CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END AS fixed", "'same' AS constant", "'   ' AS blank",
]


def _original(spark, sf):
    return read(spark, sf, "customer").selectExpr("*", *_EXTRA)


def _masked(spark, sf):
    """The masked table; ``town`` comes back unmasked, as if the source held the drawn city already."""
    original = _original(spark, sf)
    return mask_table(original.drop("town"), TableRule("customer", ("c_custkey",), tuple(r for r in LEAKY_RULE.columns if r.name != "town")), SETTINGS).withColumn("town", F.lit("Trail"))


def report(spark, sf):
    return validate_columns(_masked(spark, sf), _original(spark, sf), LEAKY_RULE)


# (column, rule type, ignored, leak condition, compared condition) against the joined tables.
_CHECKS = [
    ("c_name", "FullName", "false", "m.c_name = o.c_name", "true"),
    ("c_acctbal", "RandomDec", "false", "m.c_acctbal = o.c_acctbal", "true"),
    ("c_mktsegment", "PickRandom", "false", "m.c_mktsegment = o.c_mktsegment", "true"),
    ("c_nationkey", "NoMasking", "false", "true", "true"),
    ("kept", "FullName", "true", "false", "true"),
    ("town", "City", "false", "true", "true"),
    ("long_name", "exception", "false", "o.c_custkey % 2 = 1", "true"),
    ("fixed", "PickRandom", "false", "o.c_custkey % 2 = 0", "true"),
    ("constant", "Shuffle", "false", "true", "true"),
    ("blank", "Scramble", "false", "false", "false"),
]
REPORT_SQL = " UNION ALL ".join(
    f"SELECT 'customer' AS table_name, 'app' AS schema_name, '{c}' AS column_name, '{kind}' AS rule_type, {ignored} AS ignored, count(*) AS rows_masked, (SELECT count(*) FROM customer) AS rows_original, CAST(0 AS BIGINT) AS rows_missing, CAST(0 AS BIGINT) AS rows_extra, CAST(0 AS BIGINT) AS keys_repeated, "
    f"count(*) FILTER (WHERE {leak}) AS leaks, count(*) FILTER (WHERE {compared} AND NOT ({leak})) AS changed FROM m JOIN customer o USING (c_custkey)"
    for c, kind, ignored, leak, compared in _CHECKS
)


def _with_masked(sql):
    return f"WITH m AS ({MASKED_CUSTOMER}) {sql}"


@query("validate_columns", _with_masked(REPORT_SQL))
def _validate(spark, sf):
    return report(spark, sf)


def _verdict_sql(source):
    return f"""SELECT *, CASE WHEN rows_missing > 0 OR rows_extra > 0 OR keys_repeated > 0 THEN 'FAIL' WHEN leaks = 0 AND rows_masked = 0 THEN 'PASS' WHEN ignored OR rule_type = 'NoMasking' THEN 'PASS' WHEN leaks = 0 THEN 'PASS' WHEN rule_type = 'Shuffle' THEN 'FAIL'
        WHEN rule_type = 'exception' AND changed > 0 THEN 'PASS' WHEN rule_type = 'City' THEN 'PASS' ELSE 'FAIL' END AS result,
    CASE WHEN rows_missing > 0 OR rows_extra > 0 OR keys_repeated > 0 THEN 'Rows are missing, added or repeated' WHEN leaks = 0 AND rows_masked = 0 THEN 'No record found' WHEN ignored OR rule_type = 'NoMasking' THEN 'Masking not required' WHEN leaks = 0 THEN 'NULL'
        WHEN rule_type = 'Shuffle' AND rows_masked = 1 THEN 'row count must be > 1 for Shuffle' WHEN rule_type = 'Shuffle' THEN 'Cannot generate a unique shuffle value'
        WHEN rule_type = 'exception' AND changed > 0 THEN 'Applied mask with exception' WHEN rule_type = 'City' THEN 'Same City found but different state or province'
        ELSE 'Found exact match ' || rule_type END AS result_comment FROM ({source})"""


# Counts that reach every branch, derived from the orders: one report row per (priority, status).
_COUNTS = """SELECT o_orderpriority AS table_name, 's' AS schema_name, o_orderstatus AS column_name, CASE o_orderpriority WHEN '1-URGENT' THEN 'Shuffle' WHEN '2-HIGH' THEN 'City' WHEN '3-MEDIUM' THEN 'exception' ELSE 'FullName' END AS rule_type,
    o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT' AS ignored, CASE WHEN o_orderstatus = 'P' THEN CAST(1 AS BIGINT) WHEN o_orderpriority = '5-LOW' THEN CAST(0 AS BIGINT) ELSE count(*) END AS rows_masked, count(*) AS rows_original, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P' THEN CAST(2 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS rows_missing,
    CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS rows_extra, CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS keys_repeated,
    CASE WHEN o_orderpriority = '5-LOW' OR (o_orderstatus = 'F' AND o_orderpriority <> '2-HIGH') THEN CAST(0 AS BIGINT) ELSE count(*) END AS leaks, CASE WHEN o_orderstatus = 'O' THEN CAST(3 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS changed FROM orders GROUP BY o_orderpriority, o_orderstatus"""


@query("validation_verdict", _with_masked(f"{_verdict_sql(REPORT_SQL)} UNION ALL {_verdict_sql(_COUNTS)}"))
def _verdict(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return validation_verdict(report(spark, sf).unionByName(spark.sql(_COUNTS)))


# A copy that lacks every seventh customer, moved every eleventh to another key, and doubled every fifth.
_COPY = """SELECT CASE WHEN c_custkey % 11 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'x' END AS c_name
    FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 'y' FROM customer WHERE c_custkey % 5 = 0"""
_COPY_RULE = TableRule("customer", ("c_custkey",), (R("c_custkey", "NoMasking"), R("c_name", "FullName")))


@query(
    "validation_unmatched",
    f"""WITH c AS ({_COPY}), m AS (SELECT c_custkey, count(*) AS n, min(c_name) AS c_name FROM c GROUP BY 1),
    j AS (SELECT m.n, m.c_name, o.c_custkey AS k, m.c_custkey AS mk, o.c_name AS old FROM m FULL JOIN customer o ON m.c_custkey = o.c_custkey),
    s AS (SELECT CAST(sum(n) AS BIGINT) AS rows_masked, count(k) AS rows_original, count(*) FILTER (WHERE mk IS NULL) AS rows_missing, CAST(sum(n) FILTER (WHERE k IS NULL) AS BIGINT) AS rows_extra,
        count(*) FILTER (WHERE n > 1) AS keys_repeated, count(*) FILTER (WHERE n = 1 AND k IS NOT NULL) AS pairs, count(*) FILTER (WHERE n = 1 AND k IS NOT NULL AND c_name = old) AS same FROM j)
    SELECT 'customer' AS table_name, '' AS schema_name, 'c_custkey' AS column_name, 'NoMasking' AS rule_type, false AS ignored, rows_masked, rows_original, rows_missing, rows_extra, keys_repeated,
        pairs AS leaks, CAST(0 AS BIGINT) AS changed, 'FAIL' AS result, 'Rows are missing, added or repeated' AS result_comment FROM s
    UNION ALL SELECT 'customer', '', 'c_name', 'FullName', false, rows_masked, rows_original, rows_missing, rows_extra, keys_repeated, same, pairs - same, 'FAIL', 'Rows are missing, added or repeated' FROM s""",
)
def _unmatched(spark, sf):
    original = read(spark, sf, "customer")
    original.createOrReplaceTempView("customer")
    return validation_verdict(validate_columns(spark.sql(_COPY), original, _COPY_RULE))


SHUFFLE_RULE = TableRule("customer", ("c_custkey",), (R("c_mktsegment", "Shuffle"), R("constant", "Shuffle"), R("c_name", "NoMasking")))


@query(
    "validation_shuffle_log",
    """SELECT 'customer' AS table_name, '' AS schema_name, column_name, rule_type, false AS ignored, n AS rows_masked, n AS rows_original, 0::BIGINT AS rows_missing, 0::BIGINT AS rows_extra, 0::BIGINT AS keys_repeated, leaks, n - leaks AS changed, result, result_comment FROM (
        SELECT count(*) AS n, unnest(['c_mktsegment', 'constant', 'c_name']) AS column_name, unnest(['Shuffle', 'Shuffle', 'NoMasking']) AS rule_type, unnest([0, count(*), count(*)]) AS leaks,
        unnest(['PASS', 'FAIL', 'PASS']) AS result, unnest(['NULL', 'Cannot generate a unique shuffle value', 'Masking not required']) AS result_comment FROM customer)""",
)
def _shuffle_log(spark, sf):
    original = read(spark, sf, "customer").withColumn("constant", F.lit("same"))
    masked = mask_table(original, SHUFFLE_RULE, SETTINGS)
    log = mask_exceptions(original, SHUFFLE_RULE, SETTINGS)
    return validation_shuffle_log(validation_verdict(validate_columns(masked, original, SHUFFLE_RULE)), log)


@query(
    "validation_summary",
    _with_masked(
        f"""SELECT count(DISTINCT table_name) AS table_count, count(*) AS column_count, count(*) FILTER (WHERE result = 'PASS') AS total_pass, count(*) FILTER (WHERE result = 'FAIL') AS total_fail,
        CAST(round_even(count(*) FILTER (WHERE result = 'PASS') * 100.0 / count(*), 2) AS DECIMAL(5,2)) AS accuracy_pct FROM ({_verdict_sql(REPORT_SQL)} UNION ALL {_verdict_sql(_COUNTS)})"""
    ),
)
def _summary(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return validation_summary(validation_verdict(report(spark, sf).unionByName(spark.sql(_COUNTS))))


@query("validation_row_counts", "SELECT 'customer' AS table_name, count(*) AS row_count_mask, count(*) AS row_count_prd FROM customer")
def _row_counts(spark, sf):
    return validation_row_counts(masked_customer(spark, sf), read(spark, sf, "customer"), CUSTOMER_RULE)


# Every third order changed or dropped, every fifth doubled.
_LEFT = "SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"
_RIGHT = "SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 7 <> 0"
_SAME = "l.o_custkey IS NOT DISTINCT FROM r.o_custkey AND l.o_orderstatus IS NOT DISTINCT FROM r.o_orderstatus AND l.o_orderpriority IS NOT DISTINCT FROM r.o_orderpriority"


# Customers whose names stand one row further, whose segments are drawn, and whose phone numbers are new: only comparison over all rows tells.
_TURNED = "SELECT c_custkey, coalesce(lead(c_name) OVER (ORDER BY c_custkey), 'none') AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'BUILDING' ELSE 'NEW' END AS c_mktsegment, c_acctbal + 0.001 AS c_acctbal FROM customer"
TURNED_RULE = TableRule("customer", ("c_custkey",), (R("c_name", "FullName"), R("c_mktsegment", "PickRandom"), R("c_acctbal", "RandomDec")))


@query(
    "validation_survivors",
    f"WITH m AS ({_TURNED}) "
    + " UNION ALL ".join(
        f"SELECT 'customer' AS table_name, '{r.name}' AS column_name, '{r.type}' AS rule_type, count(*) AS rows_surviving, count(DISTINCT {r.name}) AS values_surviving FROM m WHERE {r.name} IN (SELECT {r.name} FROM customer)"
        for r in TURNED_RULE.columns
    ),
)
def _survivors(spark, sf):
    customer = read(spark, sf, "customer")
    customer.createOrReplaceTempView("customer")
    return surviving_values(spark.sql(_TURNED), customer, TURNED_RULE)


@query(
    "table_diff",
    f"WITH a AS ({_LEFT}), b AS ({_RIGHT}) SELECT * FROM a l WHERE NOT EXISTS (SELECT 1 FROM b r WHERE {_SAME}) UNION ALL SELECT * FROM b l WHERE NOT EXISTS (SELECT 1 FROM a r WHERE {_SAME})",
)
def _diff(spark, sf):
    read(spark, sf, "orders").createOrReplaceTempView("orders")
    return table_diff(spark.sql(_LEFT), spark.sql(_RIGHT))
