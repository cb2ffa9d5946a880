"""Rule semantics: what happens around a generator, and whole-table masks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from suite import twin as w
from suite.base import SETTINGS, mask_query, query, read
from veilspark.operators.exceptions import mask_exceptions
from veilspark.operators.mapping import apply_key_map, correlation_table
from veilspark.operators.unique import bijection
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, TableRule
from veilspark.sources.scratch import materialise, scratch_path

R = ColumnRule
SEGMENTS = "BUILDING,AUTOMOBILE,MACHINERY,HOUSEHOLD,FURNITURE"
PICK = w.pool(SEGMENTS.split(","))
CKEY = w.key("c_custkey")
NULLED = "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name"
BLANKED = "CASE WHEN p_partkey % 3 = 0 THEN '  ' WHEN p_partkey % 3 = 1 THEN '' ELSE p_brand END AS p_brand"

# One column -----------------------------------------------------------------------------------------

mask_query(
    "pass_through", "customer", "c_custkey",
    [R("c_name", "NoMasking"), R("c_mktsegment", "FullName", ignore=True), R("c_acctbal", "Unmask")],
    "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    derive=["c_custkey", "c_name", "c_acctbal", "c_mktsegment"],
)
mask_query(
    "use_value", "customer", "c_custkey",
    [
        R("c_name", "FullName", use_value="Jane Doe"), R("c_nationkey", "RandomInt", use_value="17"),
        R("c_acctbal", "RandomDec", use_value="12.50"), R("c_mktsegment", "Bogus", use_value="null"),
        R("born", "DateOfBirth", use_value="2001-02-03"),
    ],
    "SELECT c_custkey, 'Jane Doe' AS c_name, 17 AS c_nationkey, CAST('12.50' AS DECIMAL(18,6)) AS c_acctbal, "
    "CAST(NULL AS VARCHAR) AS c_mktsegment, TIMESTAMP '2001-02-03' AS born FROM customer",
    derive=["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "timestamp_ntz'1990-01-01' AS born"],
)
mask_query(
    "null_out", "customer", "c_custkey", [R("c_name", "Ignore")],
    "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name FROM customer", derive=["c_custkey", "c_name"],
)
_drawn_last = w.differing(w.LAST, "customer.c_name", CKEY, "c_name")
mask_query(
    "retain_null", "customer", "c_custkey",
    [R("c_name", "LastName"), R("other", "LastName", retain_null=False), R("star", "MaskingOut", pattern="MaskingLeft", max="3", retain_null=False)],
    f"""SELECT c_custkey, {w.kept_null('c_name', _drawn_last)} AS c_name,
        {w.differing(w.LAST, 'customer.other', CKEY, 'c_name')} AS other,
        CASE WHEN c_name IS NULL THEN '' ELSE '***' || substr(c_name, 4) END AS star
    FROM (SELECT c_custkey, {NULLED} FROM customer)""",
    derive=["c_custkey", NULLED, "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS other", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS star"],
)
_pkey = w.key("p_partkey")
mask_query(
    "retain_empty", "part", "p_partkey", [R("p_brand", "StringFormat", pattern="Brand ##", retain_empty=True)],
    f"""SELECT p_partkey, CASE WHEN trim(p_brand) = '' THEN p_brand ELSE
        {w.differing(w.symbols('Brand ##'), 'part.p_brand', _pkey, 'p_brand')} END AS p_brand
    FROM (SELECT p_partkey, {BLANKED} FROM part)""",
    derive=["p_partkey", BLANKED],
)
mask_query(
    "differs_from_original", "customer", "c_custkey", [R("c_mktsegment", "PickRandom", pattern=SEGMENTS)],
    f"""SELECT c_custkey, original, {w.differing(PICK, 'customer.c_mktsegment', CKEY, 'original')} AS c_mktsegment
    FROM (SELECT c_custkey, c_mktsegment AS original FROM customer)""",
    derive=["c_custkey", "c_mktsegment AS original", "c_mktsegment"],
)
mask_query(
    "truncate_to_max", "customer", "c_custkey", [R("c_name", "FullAddress", max="25"), R("file", "Filename", max="8")],
    f"""SELECT c_custkey, {w.differing(w.FULL_ADDRESS, 'customer.c_name', CKEY, 'c_name', lambda v: f'substr({v}, 1, 25)')} AS c_name,
        {w.differing(w.FILE_STEM, 'customer.file', CKEY, 'c_name', lambda v: f'right({v}, 8)')} AS file FROM customer""",
    derive=["c_custkey", "c_name", "c_name AS file"],
)
mask_query(
    "mask_if_longer", "part", "p_partkey", [R("p_name", "exception", pattern="16")],
    f"SELECT p_partkey, CASE WHEN length(p_name) > 16 THEN {w.differing(w.FILE_STEM, 'part.p_name', _pkey, 'p_name')} ELSE p_name END AS p_name FROM part",
    derive=["p_partkey", "p_name"],
)
_computed_part = w.kept_null("c_mktsegment", w.differing(PICK, "customer.c_mktsegment", CKEY, "c_mktsegment"))
mask_query(
    "computed_concat", "customer", "c_custkey",
    [
        R("label", "Computed", source_columns=("c_mktsegment", "c_name", "c_nationkey"), separator="/"),
        R("spaced", "Computed", source_columns=("c_nationkey", "c_name")),
        R("c_mktsegment", "PickRandom", pattern=SEGMENTS),
    ],
    f"""SELECT *, c_mktsegment || '/' || coalesce(c_name, '') || '/' || CAST(c_nationkey AS VARCHAR) AS label,
        CAST(c_nationkey AS VARCHAR) || ' ' || coalesce(c_name, '') AS spaced
    FROM (SELECT c_custkey, {NULLED}, c_nationkey, {_computed_part} AS c_mktsegment FROM customer)""",
    derive=["c_custkey", NULLED, "c_nationkey", "c_mktsegment", "c_mktsegment AS label", "c_mktsegment AS spaced"],
)

# Value mappings -------------------------------------------------------------------------------------

_priority = w.symbols("P-####")
mask_query(
    "map_local", "orders", "o_orderkey", [R("o_orderpriority", "StringFormat", pattern="P-####", local_mapping=True)],
    f"""SELECT o_orderkey, original, {w.differing(_priority, 'orders.o_orderpriority', 'original', 'original')} AS o_orderpriority
    FROM (SELECT o_orderkey, o_orderpriority AS original FROM orders)""",
    derive=["o_orderkey", "o_orderpriority AS original", "o_orderpriority"],
)
GLOBAL = R("nationkey", "RandomInt", min="1000", max="999999999", global_mapping=True)


@query(
    "map_global",
    f"""WITH c AS (SELECT {w.differing(w.ints(1000, 999999999, 'INTEGER'), 'nationkey', 'CAST(c_nationkey AS VARCHAR)', 'c_nationkey')} AS nationkey, count(*) AS customers FROM customer GROUP BY 1),
        s AS (SELECT {w.differing(w.ints(1000, 999999999, 'INTEGER'), 'nationkey', 'CAST(s_nationkey AS VARCHAR)', 's_nationkey')} AS nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
    SELECT nationkey, customers, suppliers FROM c JOIN s USING (nationkey)""",
)
def _map_global(spark, sf):
    """Two tables masked apart still join: equal originals of one column name get equal values."""
    sides = []
    for table, key, column, count in (("customer", "c_custkey", "c_nationkey", "customers"), ("supplier", "s_suppkey", "s_nationkey", "suppliers")):
        df = read(spark, sf, table).select(key, F.col(column).alias("nationkey"))
        masked = mask_table(df, TableRule(table, (key,), (GLOBAL,)), SETTINGS)
        sides.append(masked.groupBy("nationkey").agg(F.count("*").alias(count)))
    return sides[0].join(sides[1], "nationkey")


SUPPLIED = {"BUILDING": "alpha", "MACHINERY": "beta"}
mask_query(
    "map_supplied", "customer", "c_custkey",
    [R("c_mktsegment", "StringFormat", pattern="S-####", local_mapping=True, value_mappings=SUPPLIED)],
    f"""SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'alpha' WHEN 'MACHINERY' THEN 'beta'
        ELSE {w.differing(w.symbols('S-####'), 'customer.c_mktsegment', 'c_mktsegment', 'c_mktsegment')} END AS c_mktsegment FROM customer""",
    derive=["c_custkey", "c_mktsegment"],
)

CORR_LOW, CORR_SIZE = 5_000_000, 10_000_019
_CORRELATION = w.permutation("corr", "SELECT DISTINCT c_custkey AS k, c_custkey AS v FROM customer WHERE c_custkey IS NOT NULL", CORR_SIZE, "custkey")


@query(
    "correlation_table",
    f"""WITH RECURSIVE {_CORRELATION}, o AS (SELECT {CORR_LOW} + v AS custkey, count(*) AS orders, sum(o_orderkey) AS order_keys FROM orders JOIN corr ON o_custkey = k GROUP BY 1)
    SELECT c_custkey AS before, custkey AS after, c_name, orders, CAST(order_keys AS BIGINT) AS order_keys FROM customer JOIN corr ON c_custkey = k JOIN o ON custkey = {CORR_LOW} + v""",
)
def _correlation(spark, sf):
    """A key replaced in parent and child, each on its own; the join afterwards still matches, and the before/after table agrees with both."""
    customer, orders = read(spark, sf, "customer").select("c_custkey", "c_name"), read(spark, sf, "orders").select("o_orderkey", "o_custkey")
    place = ("custkey", SETTINGS, CORR_LOW, CORR_SIZE)
    table = materialise(correlation_table(customer, "c_custkey", *place), "correlation")
    parents = materialise(apply_key_map(customer, "c_custkey", *place), "parents").withColumnRenamed("c_custkey", "custkey")
    children = materialise(apply_key_map(orders, "o_custkey", *place), "children")
    per_key = children.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("order_keys"))
    return parents.join(per_key, "custkey").join(table, F.col("after") == F.col("custkey")).select("before", "after", "c_name", "orders", "order_keys")


_SCOPES = ("customer names", "customer.c_nationkey")
mask_query(
    "map_unique", "customer", "c_custkey",
    [R("c_name", "StringFormat", pattern=_SCOPES[0], unique=True, global_mapping=True), R("c_nationkey", "RandomInt", min="0", max="24", unique=True, local_mapping=True)],
    f"""WITH RECURSIVE {w.permuted_form("names", "customer", "c_name", "Aaaaaaaa#999999999", _SCOPES[0])},
        {w.permutation("nations", "SELECT DISTINCT c_nationkey AS k, CAST(c_nationkey AS BIGINT) AS v FROM customer", 25, _SCOPES[1])}
    SELECT c_custkey, names.v AS c_name, CAST(nations.v AS INTEGER) AS c_nationkey FROM customer JOIN names ON c_name = names.k JOIN nations ON c_nationkey = nations.k""",
    derive=["c_custkey", "c_name", "CAST(c_nationkey AS INT) AS c_nationkey"],
)

# Unique values --------------------------------------------------------------------------------------

UNIQUE = R("c_name", "PhoneNumber", pattern="(###) ###-####", unique=True)
_ua, _ub = bijection(10**10, "42", "customer.c_name")
mask_query(
    "mask_unique", "customer", "c_custkey", [UNIQUE],
    f"""SELECT c_custkey, {w.symbols('(###) ###-####')[0].render('u')} AS c_name FROM (
        SELECT c_custkey, ((row_number() OVER (ORDER BY {w.hashed(CKEY)}, c_custkey) - 1) * {_ua} + {_ub}) % 10000000000 AS u FROM customer)""",
    derive=["c_custkey", "c_name"],
)



@query(
    "mask_unique_deliveries",
    f"""WITH numbered AS (
        SELECT c_custkey, c_custkey % 10 = 3 AS late, row_number() OVER (PARTITION BY c_custkey % 10 = 3 ORDER BY {w.hashed(CKEY)}, c_custkey) - 1 AS n FROM customer),
    u AS (SELECT c_custkey, late, ((n + CASE WHEN late THEN (SELECT count(*) FROM numbered WHERE NOT late) ELSE 0 END) * {_ua} + {_ub}) % 10000000000 AS u FROM numbered)
    SELECT c_custkey, {w.symbols('(###) ###-####')[0].render('u')} AS c_name, NOT late AS as_before FROM u""",
)
def _deliveries(spark, sf):
    """A table masked with nine tenths of its rows, then with all: values given first stand, new rows get others."""
    customer = read(spark, sf, "customer").select("c_custkey", "c_name")
    settings, rule = replace(SETTINGS, assignments=scratch_path(spark, "assignments")), TableRule("customer", ("c_custkey",), (UNIQUE,))
    first = materialise(mask_table(customer.where("c_custkey % 10 <> 3"), rule, settings), "delivery").withColumnRenamed("c_name", "before")
    second = mask_table(customer, rule, settings)
    return second.join(first, "c_custkey", "left").select("c_custkey", "c_name", F.col("before").eqNullSafe(F.col("c_name")).alias("as_before"))


# Arithmetic -----------------------------------------------------------------------------------------

LINE = ("l_orderkey", "l_linenumber")
LKEY = w.key(*LINE)
MATH_INPUT = ["l_orderkey", "l_linenumber", "l_extendedprice", "CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax", "l_quantity AS result"]
MATH_FROM = "(SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_tax END AS l_tax FROM lineitem)"


def _math(name, operator, pattern, sql, factor=None):
    rules = [R("l_extendedprice", "NoMasking"), R("l_tax", "NoMasking"), R("result", "math", pattern=pattern, operator=operator, max=factor)]
    mask_query(
        name, "lineitem", LINE, rules, f"SELECT l_orderkey, l_linenumber, {sql} AS result FROM {MATH_FROM}",
        derive=MATH_INPUT, output=["l_orderkey", "l_linenumber", "result"],
    )


_math("math_addition", "addition", "l_extendedprice,l_tax", "l_extendedprice + coalesce(l_tax, 0.0::DOUBLE)")
_math("math_substraction", "substraction", "l_extendedprice,l_tax", "0.0::DOUBLE - (l_extendedprice + coalesce(l_tax, 0.0::DOUBLE))")
_math("math_percentage", "percentage", "l_extendedprice", "20::DOUBLE / 100.0::DOUBLE * l_extendedprice", "20")
_math("math_random_percentage", "randomPercentage", "l_extendedprice", f"(30 + {w.h('lineitem.result', LKEY)} % 70)::DOUBLE / 100.0::DOUBLE * l_extendedprice", "30.4")
_math("math_average", "avarage", "l_extendedprice,l_tax", "(l_extendedprice + coalesce(l_tax, 0.0::DOUBLE)) / 2.0::DOUBLE")
_math("math_division", "division", "l_extendedprice", "l_extendedprice / 4.0::DOUBLE", "4")

# Whole tables ---------------------------------------------------------------------------------------

CUSTOMER_RULE = TableRule(
    "customer", ("c_custkey",),
    (
        R("c_name", "FullName"),
        R("c_acctbal", "RandomDec", min="0", max="9999"),
        R("c_mktsegment", "PickRandom", pattern=SEGMENTS),
    ),
)
_name_sql = w.kept_null("c_name", w.differing(w.FULL, "customer.c_name", CKEY, "c_name"))
_bal = w.drawn(w.decs("0", "9999", 6, "DECIMAL(18,6)"), "customer.c_acctbal", CKEY)
_bal2 = w.drawn(w.decs("0", "9999", 6, "DECIMAL(18,6)"), "customer.c_acctbal", CKEY, shifted=True)
_bal_sql = w.kept_null("c_acctbal", f"CAST(CASE WHEN CAST({_bal} AS DOUBLE) = c_acctbal THEN {_bal2} ELSE {_bal} END AS DOUBLE)")
_seg_sql = w.kept_null("c_mktsegment", w.differing(PICK, "customer.c_mktsegment", CKEY, "c_mktsegment"))
MASKED_CUSTOMER = f"SELECT c_custkey, {_name_sql} AS c_name, c_nationkey, {_bal_sql} AS c_acctbal, {_seg_sql} AS c_mktsegment FROM customer"


@query("mask_table", MASKED_CUSTOMER)
def masked_customer(spark, sf):
    return mask_table(read(spark, sf, "customer"), CUSTOMER_RULE, SETTINGS)


_NAME_POOL = R("p_name", "MaskingOut", pattern="MaskingRight", max="16")


@query(
    "mask_exceptions",
    """SELECT 'part' AS table_name, 'p_name' AS column_name, 'too short to mask' AS reason, count(*) AS n FROM part WHERE length(p_name) <= 16 HAVING count(*) > 0
    UNION ALL SELECT 'part', 'p_brand', 'no different value', count(*) FROM part WHERE p_brand = 'Brand#1' HAVING count(*) > 0
    UNION ALL SELECT 'part', 'p_type', 'no generator', count(*) FROM part WHERE p_type IS NOT NULL HAVING count(*) > 0
    UNION ALL SELECT 'part', 'p_size', 'too short to scramble', count(*) FROM part WHERE length(CAST(p_size AS VARCHAR)) <= 1 HAVING count(*) > 0
    UNION ALL SELECT 'part', 'constant', 'Cannot generate unique shuffle value', count(*) FROM part HAVING count(*) > 0""",
)
def _exceptions(spark, sf):
    part = read(spark, sf, "part").withColumn("constant", F.lit("same"))
    rules = (
        _NAME_POOL, R("p_brand", "PickRandom", pattern="Brand#1"), R("p_type", "Location"), R("p_size", "Scramble"), R("constant", "Shuffle"),
    )
    return mask_exceptions(part, TableRule("part", ("p_partkey",), rules), SETTINGS)
