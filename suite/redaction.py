"""Shuffles, scrambles, starring out, geometry, binary columns, text helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import twin as w
from suite.base import SETTINGS, mask_query, query, read
from veilspark.functions import redact
from veilspark.operators.binary import SIGNATURES
from veilspark.operators.geometry import ORDINATE_HIGH, ORDINATE_LOW, geometry_literal, geometry_random, geometry_shuffle
from veilspark.operators.writeback import drop_binary_columns
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, TableRule

R = ColumnRule
CKEY = w.key("c_custkey")


# Shuffles -------------------------------------------------------------------------------------------


def shuffle_sql(table, key, column, value_text, source=None, with_null=False, order="v"):
    """Distinct values numbered by (hash, text), one draw, and the value after it where it hit the own value."""
    source = source or table
    scope, key_sql = f"{table}.{column}", w.key(key)
    keep = "" if with_null else f"WHERE {column} IS NOT NULL"
    h0 = w.h(scope, key_sql)
    text = value_text("v")
    return f"""WITH src AS (SELECT * FROM {source}),
    pool AS (SELECT v, row_number() OVER (ORDER BY {w.hashed(text)}, {text}, {order} NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {column} AS v FROM src {keep})),
    r AS (SELECT src.*, {h0} % (SELECT max(n) FROM pool) AS r0, (SELECT max(n) FROM pool) AS n FROM src),
    a AS (SELECT r.*, pool.v AS v0 FROM r LEFT JOIN pool ON pool.i = r.r0),
    b AS (SELECT a.*, CASE WHEN v0 IS NOT DISTINCT FROM {column} AND n > 1 THEN (r0 + 1) % n ELSE r0 END AS r1 FROM a),
    c AS (SELECT b.*, pool.v AS v1 FROM b LEFT JOIN pool ON pool.i = b.r1)"""


_plain_text = lambda v: f"coalesce(CAST({v} AS VARCHAR), '')"
_float_text = lambda v: f"coalesce(CAST(CAST({v} AS DECIMAL(38,6)) AS VARCHAR), '')"
SEGMENT_NULLED = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment"


@query(
    "shuffle_column",
    f"""SELECT 'o_totalprice' AS column_name, o_orderkey AS row_key, CAST(CAST(v1 AS DECIMAL(18,2)) AS VARCHAR) AS masked FROM (
        {shuffle_sql('orders', 'o_orderkey', 'o_totalprice', _float_text)} SELECT * FROM c)
    UNION ALL SELECT 'c_mktsegment', c_custkey, CASE WHEN c_mktsegment IS NOT NULL THEN v1 END FROM (
        {shuffle_sql('customer', 'c_custkey', 'c_mktsegment', _plain_text, f'(SELECT c_custkey, {SEGMENT_NULLED} FROM customer)')} SELECT * FROM c)
    UNION ALL SELECT 'with_null', c_custkey, v1 FROM (
        {shuffle_sql('customer', 'c_custkey', 'with_null', _plain_text, f'(SELECT c_custkey, c_mktsegment AS with_null FROM (SELECT c_custkey, {SEGMENT_NULLED} FROM customer))', with_null=True)} SELECT * FROM c)""",
)
def _shuffle(spark, sf):
    orders = read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    prices = mask_table(orders, TableRule("orders", ("o_orderkey",), (R("o_totalprice", "Shuffle"),)), SETTINGS)
    customer = read(spark, sf, "customer").selectExpr("c_custkey", SEGMENT_NULLED).withColumn("with_null", F.col("c_mktsegment"))
    rules = (R("c_mktsegment", "Shuffle"), R("with_null", "Shuffle", retain_null=False))
    segments = mask_table(customer, TableRule("customer", ("c_custkey",), rules), SETTINGS)
    rows = lambda df, key, column, text: df.select(F.lit(column).alias("column_name"), F.col(key).alias("row_key"), text.alias("masked"))
    return (
        rows(prices, "o_orderkey", "o_totalprice", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
        .unionByName(rows(segments, "c_custkey", "c_mktsegment", F.col("c_mktsegment")))
        .unionByName(rows(segments, "c_custkey", "with_null", F.col("with_null")))
    )


# Scrambles ------------------------------------------------------------------------------------------


def permuted_sql(text, scope, key_sql):
    block = f"md5({w.text(f'42|{scope}|')} || {key_sql} || '|p' || CAST((i - 1) // 8 AS VARCHAR))"
    return (
        f"array_to_string(list_transform(list_sort(list_transform(range(1, length({text}) + 1), lambda i: "
        f"{{'h': substr({block}, CAST(((i - 1) % 8) * 4 + 1 AS INT), 4), 'c': substr({text}, i, 1)}})), lambda x: x.c), '')"
    )


def scrambled_sql(text, scope, key_sql):
    mixed = permuted_sql(text, scope, key_sql)
    turned = f"substr({text}, 2) || substr({text}, 1, 1)"
    return f"CASE WHEN length({text}) <= 1 THEN {text} WHEN {mixed} = {text} THEN {turned} ELSE {mixed} END"


mask_query(
    "scramble_text", "customer", "c_custkey", [R("c_name", "Scramble"), R("c_mktsegment", "Scramble")],
    f"SELECT c_custkey, {scrambled_sql('c_name', 'customer.c_name', CKEY)} AS c_name, {scrambled_sql('c_mktsegment', 'customer.c_mktsegment', CKEY)} AS c_mktsegment FROM customer",
    derive=["c_custkey", "c_name", "c_mktsegment"],
)
_signed = "(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END) * (c_custkey * 7919 + 12)"
mask_query(
    "scramble_int", "customer", "c_custkey", [R("number", "Scramble"), R("c_nationkey", "Scramble")],
    f"""SELECT c_custkey, CAST((CASE WHEN number < 0 THEN -1 ELSE 1 END) * CAST({scrambled_sql('CAST(abs(number) AS VARCHAR)', 'customer.number', CKEY)} AS BIGINT) AS BIGINT) AS number,
        CAST({scrambled_sql('CAST(c_nationkey AS VARCHAR)', 'customer.c_nationkey', CKEY)} AS INTEGER) AS c_nationkey
    FROM (SELECT c_custkey, {_signed} AS number, c_nationkey FROM customer)""",
    derive=["c_custkey", f"{_signed} AS number", "c_nationkey"],
)
LINE = ("l_orderkey", "l_linenumber")
LKEY = w.key(*LINE)
_price = "CAST(l_extendedprice AS DECIMAL(15,2)) AS price"
mask_query(
    "scramble_decimal", "lineitem", LINE, [R("price", "Scramble")],
    f"""SELECT l_orderkey, l_linenumber, CAST({scrambled_sql("split_part(t, '.', 1)", 'lineitem.price', LKEY)} || '.' || split_part(t, '.', 2) AS DECIMAL(15,2)) AS price
    FROM (SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS VARCHAR) AS t FROM lineitem)""",
    derive=[*LINE, _price],
)

# Starring out ---------------------------------------------------------------------------------------


def _star(name, pattern, size, sql):
    cut = "substr(c_name, 1, CAST(c_custkey % 20 AS INT))"
    mask_query(
        name, "customer", "c_custkey", [R("c_name", "MaskingOut", pattern=pattern, max=str(size))],
        f"SELECT c_custkey, {sql} AS c_name FROM (SELECT c_custkey, {cut} AS c_name FROM customer)",
        derive=["c_custkey", f"{cut} AS c_name"],
    )


_last = lambda n: f"((length(c_name) - 1) % {n} + 1)"
_star("mask_left", "MaskingLeft", 4, "CASE WHEN length(c_name) > 4 THEN '****' || substr(c_name, 5) ELSE c_name END")
_star("mask_right", "MaskingRight", 4, f"CASE WHEN length(c_name) > 4 THEN substr(c_name, 1, length(c_name) - {_last(4)}) || repeat('*', {_last(4)}) ELSE c_name END")
_star("mask_middle", "MaskingMiddle", 5, f"CASE WHEN length(c_name) > 10 THEN substr(c_name, 1, 5) || repeat('*', length(c_name) - 5 - {_last(5)}) || right(c_name, {_last(5)}) ELSE c_name END")

# Geometry -------------------------------------------------------------------------------------------

# Structs made of supplier keys and balances; every third has no ordinates, every fifth no point.
GEOMETRY = (
    "named_struct('gtype', CAST(2003 AS DECIMAL(10,0)), 'srid', CAST(3005 AS DECIMAL(10,0)), "
    "'point', CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE named_struct('x', CAST(s_acctbal AS DECIMAL(20,8)), 'y', CAST(s_suppkey AS DECIMAL(20,8)), 'z', CAST(s_nationkey AS DECIMAL(20,8))) END, "
    "'elem', array(CAST(1 AS DECIMAL(10,0)), CAST(1003 AS DECIMAL(10,0)), CAST(s_suppkey AS DECIMAL(10,0))), "
    "'ordinates', CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE array(CAST(s_acctbal AS DECIMAL(20,8)), CAST(s_suppkey AS DECIMAL(20,8)), CAST(s_nationkey AS DECIMAL(20,8)), CAST(s_acctbal + 1 AS DECIMAL(20,8))) END) AS geo"
)
GEOMETRY_SQL = (
    "(SELECT s_suppkey, CAST(s_acctbal AS DECIMAL(20,8)) AS x, CAST(s_suppkey AS DECIMAL(20,8)) AS y, CAST(s_nationkey AS DECIMAL(20,8)) AS z, s_suppkey % 5 <> 0 AS has_point, "
    "[CAST(1 AS DECIMAL(10,0)), CAST(1003 AS DECIMAL(10,0)), CAST(s_suppkey AS DECIMAL(10,0))] AS elem, "
    "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE [CAST(s_acctbal AS DECIMAL(20,8)), CAST(s_suppkey AS DECIMAL(20,8)), CAST(s_nationkey AS DECIMAL(20,8)), CAST(s_acctbal + 1 AS DECIMAL(20,8))] END AS ordinates FROM supplier)"
)
SKEY = w.key("s_suppkey")


def literal_sql(x="x", y="y", z="z", elem="elem", ordinates="ordinates"):
    return (
        f"'MDSYS.SDO_GEOMETRY(2003,3005,' || CASE WHEN has_point THEN 'MDSYS.SDO_POINT_TYPE(' || CAST({x} AS VARCHAR) || ', ' || CAST({y} AS VARCHAR) || ', ' || CAST({z} AS VARCHAR) || ')' ELSE 'NULL' END"
        f" || ',MDSYS.SDO_ELEM_INFO_ARRAY(' || array_to_string(list_transform({elem}, lambda e: CAST(e AS VARCHAR)), ',') || '),' || "
        f"coalesce('MDSYS.SDO_ORDINATE_ARRAY(' || array_to_string(list_transform({ordinates}, lambda o: CAST(o AS VARCHAR)), ', ') || ')', 'NULL') || ')'"
    )


def list_permuted_sql(values, scope, part):
    return (
        f"list_transform(list_sort(list_transform(range(0, len({values})), lambda i: {{'h': md5({w.digest(scope, SKEY, part)} || CAST(i AS VARCHAR)), 'i': i, 'v': {values}[i + 1]}})), lambda q: q.v)"
    )


def _suppliers(spark, sf):
    return read(spark, sf, "supplier").selectExpr("s_suppkey", GEOMETRY)


@query("geometry_literal", f"SELECT s_suppkey, {literal_sql()} AS text FROM {GEOMETRY_SQL}")
def _literal(spark, sf):
    return _suppliers(spark, sf).select("s_suppkey", geometry_literal(F.col("geo")).alias("text"))


_ordinate = f"CAST(CAST({ORDINATE_LOW} + {w.number('md5(' + w.digest('supplier.geo', SKEY, 'o') + ' || CAST(i AS VARCHAR))')} % {ORDINATE_HIGH - ORDINATE_LOW + 1} AS DECIMAL(20,0)) * 0.00000001 AS DECIMAL(20,8))"
_drawn_ordinates = f"CASE WHEN ordinates IS NOT NULL THEN list_transform(range(0, len(ordinates)), lambda i: {_ordinate}) END"


@query(
    "geometry_random",
    f"SELECT s_suppkey, {literal_sql('y', 'z', 'x', 'e2', 'o2')} AS text FROM (SELECT *, {_drawn_ordinates} AS o2, CASE WHEN ordinates IS NOT NULL THEN elem ELSE {list_permuted_sql('elem', 'supplier.geo', 'e')} END AS e2 FROM {GEOMETRY_SQL})",
)
def _random_geometry(spark, sf):
    masked = mask_table(_suppliers(spark, sf), TableRule("supplier", ("s_suppkey",), (R("geo", "Geometry"),)), SETTINGS)
    return masked.select("s_suppkey", geometry_literal(F.col("geo")).alias("text"))


_mixed = list_permuted_sql("ordinates", "supplier.geo", "o")


@query(
    "geometry_shuffle",
    f"""SELECT s_suppkey, {literal_sql('y', 'z', 'x', 'e2', 'o2')} AS text FROM (SELECT *, {list_permuted_sql('elem', 'supplier.geo', 'e')} AS e2,
        CASE WHEN ordinates IS NULL THEN NULL WHEN {_mixed} = ordinates THEN ordinates[2:] || ordinates[1:1] ELSE {_mixed} END AS o2 FROM {GEOMETRY_SQL})""",
)
def _shuffled_geometry(spark, sf):
    masked = mask_table(_suppliers(spark, sf), TableRule("supplier", ("s_suppkey",), (R("geo", "Shufflegeometry"),)), SETTINGS)
    return masked.select("s_suppkey", geometry_literal(F.col("geo")).alias("text"))


_STRUCT_TEXT = (
    "'{2003, 3005, ' || CASE WHEN has_point THEN '{' || CAST(x AS VARCHAR) || ', ' || CAST(y AS VARCHAR) || ', ' || CAST(z AS VARCHAR) || '}' ELSE 'null' END"
    " || ', [' || array_to_string(list_transform(elem, lambda e: CAST(e AS VARCHAR)), ', ') || '], ' || "
    "coalesce('[' || array_to_string(list_transform(ordinates, lambda o: CAST(o AS VARCHAR)), ', ') || ']', 'null') || '}'"
)


@query(
    "shuffle_polygon",
    f"""WITH src AS (SELECT s_suppkey, {literal_sql()} AS text, {_STRUCT_TEXT} AS js FROM {GEOMETRY_SQL}),
    pool AS (SELECT js, text, row_number() OVER (ORDER BY {w.hashed('js')}, js) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT js, text FROM src)),
    r AS (SELECT src.*, {w.h('supplier.geo', SKEY)} % (SELECT max(n) FROM pool) AS r0, (SELECT max(n) FROM pool) AS n FROM src),
    a AS (SELECT r.*, CASE WHEN pool.js = r.js AND r.n > 1 THEN (r0 + 1) % r.n ELSE r0 END AS r1 FROM r JOIN pool ON pool.i = r.r0)
    SELECT s_suppkey, pool.text FROM a JOIN pool ON pool.i = a.r1""",
)
def _polygon(spark, sf):
    masked = mask_table(_suppliers(spark, sf), TableRule("supplier", ("s_suppkey",), (R("geo", "ShufflePolygon"),)), SETTINGS)
    return masked.select("s_suppkey", geometry_literal(F.col("geo")).alias("text"))


# Binary columns -------------------------------------------------------------------------------------

KINDS = ["pdf", "txt", "html", "docx", "png", "rtf", "bin", "TIF"]
_FILE_SPARK = f"concat('page', page_id, '.', element_at(array({', '.join(w.text(k) for k in KINDS)}), CAST(page_id % {len(KINDS)} AS INT) + 1)) AS FILE_NAME"
_FILE_SQL = f"'page' || page_id || '.' || list_extract({w.words(KINDS)}, CAST(page_id % {len(KINDS)} AS INT) + 1)"
PKEY = w.key("page_id")
_blob_text = w.drawn(w.filler(4), "pages.payload", PKEY)
_noise = " || ".join(w.digest("pages.payload", PKEY, f"b{k}") for k in range(4))
_signature = "CASE kind " + " ".join(f"WHEN {w.text(k)} THEN {w.text(s)}" for k, s in SIGNATURES.items()) + f" ELSE {w.text(SIGNATURES['jpg'])} END"
_fresh = (
    f"CASE WHEN kind = 'txt' THEN encode({_blob_text}) WHEN kind IN ('htm', 'html') THEN encode('<html><body><p>' || {_blob_text} || '</p></body></html>') "
    f"WHEN kind = 'rtf' THEN encode('{{\\rtf1\\ansi ' || {_blob_text} || '}}') ELSE unhex({_signature} || {_noise}) END"
)
_page_file = f"(SELECT page_id, html, {_FILE_SQL} AS file_name, lower(list_extract(string_split({_FILE_SQL}, '.'), -1)) AS kind FROM pages)"


@query(
    "mask_blob",
    f"SELECT page_id, hex(fresh) AS payload, fresh <> encode(html) AS differs FROM (SELECT *, {_fresh} AS fresh FROM {_page_file})",
)
def _blob(spark, sf):
    pages = read(spark, sf, "pages").selectExpr("page_id", _FILE_SPARK, "encode(html, 'UTF-8') AS payload", "encode(html, 'UTF-8') AS original")
    masked = mask_table(pages, TableRule("pages", ("page_id",), (R("payload", "Blob", pattern="FILE_NAME"),)), SETTINGS)
    return masked.select("page_id", F.hex("payload").alias("payload"), (F.col("payload") != F.col("original")).alias("differs"))


mask_query(
    "blob_file_name", "pages", "page_id", [R("FILE_NAME", "File")],
    f"SELECT page_id, {w.drawn(w.FILE_STEM, 'pages.FILE_NAME', PKEY)} || '.' || list_extract(string_split(file_name, '.'), -1) AS \"FILE_NAME\" FROM {_page_file}",
    derive=["page_id", _FILE_SPARK],
)


@query("hex_dump", "SELECT doc_id, substr(hex(encode(text)), 1, 1000) AS dump, length(hex(encode(text))) AS n FROM documents")
def _hex_dump(spark, sf):
    data = F.encode("text", "UTF-8")
    return read(spark, sf, "documents").select("doc_id", redact.hex_dump(data, 1000).alias("dump"), F.length(F.hex(data)).cast("bigint").alias("n"))


@query("drop_binary_columns", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _drop_binary(spark, sf):
    return drop_binary_columns(read(spark, sf, "documents").withColumn("payload", F.encode("text", "UTF-8")))


# Text helpers ---------------------------------------------------------------------------------------


@query("clean_whitespace", r"SELECT doc_id, regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g') AS cleaned FROM documents")
def _whitespace(spark, sf):
    return read(spark, sf, "documents").select("doc_id", redact.clean_whitespace(F.col("text")).alias("cleaned"))


@query("clean_file_name", r"""SELECT page_id, regexp_replace(url, '["<>|:*?\\/]', '_', 'g') AS cleaned FROM pages""")
def _file_name(spark, sf):
    return read(spark, sf, "pages").select("page_id", redact.clean_file_name(F.col("url")).alias("cleaned"))


@query("clean_special_chars", r"SELECT page_id, regexp_replace(url, '[^0-9A-Za-z_.@-]', '_', 'g') AS cleaned FROM pages")
def _special(spark, sf):
    return read(spark, sf, "pages").select("page_id", redact.clean_special_chars(F.col("url")).alias("cleaned"))


_BRAND = "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS p_brand"


@query("empty_to_null", f"SELECT p_partkey, nullif(p_brand, '') AS p_brand FROM (SELECT p_partkey, {_BRAND} FROM part)")
def _empty(spark, sf):
    return read(spark, sf, "part").selectExpr("p_partkey", _BRAND).select("p_partkey", redact.empty_to_null(F.col("p_brand")).alias("p_brand"))
