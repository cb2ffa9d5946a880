"""Columns of the given tables, and SQL that profiles them the way the profile operators promise."""

from __future__ import annotations

COLUMNS = {
    "region": "r_regionkey:int r_name:string",
    "nation": "n_nationkey:int n_name:string n_regionkey:int",
    "customer": "c_custkey:bigint c_name:string c_nationkey:int c_acctbal:double c_mktsegment:string",
    "supplier": "s_suppkey:bigint s_name:string s_nationkey:int s_acctbal:double",
    "part": "p_partkey:bigint p_name:string p_brand:string p_type:string p_size:int p_retailprice:double",
    "orders": "o_orderkey:bigint o_custkey:bigint o_orderstatus:string o_totalprice:double o_orderdate:time o_orderpriority:string",
    "lineitem": "l_orderkey:bigint l_partkey:bigint l_suppkey:bigint l_linenumber:int l_quantity:double l_extendedprice:double l_discount:double l_tax:double l_returnflag:string l_linestatus:string l_shipdate:time",
    "events": "event_id:bigint ts:time user_id:bigint event_type:string value:double props:string",
    "documents": "doc_id:bigint text:string lang:string source:string n_chars:bigint",
    "embeddings": "vec_id:bigint embedding:array label:int",
    "pages": "page_id:bigint url:string html:string",
    "benchmark": "item_id:bigint text:string",
    "labels": "doc_id:bigint quality:int toxic:int",
    "conversations": "conv_id:bigint turn:bigint role:string text:string",
}
COLUMNS = {t: [tuple(c.split(":")) for c in text.split()] for t, text in COLUMNS.items()}
TABLES = list(COLUMNS)
TYPE_TEXT = {
    "int": "INT", "bigint": "NUMBER(19,0)", "string": "VARCHAR", "double": "FLOAT", "time": "TIMESTAMP", "array": "ARRAY",
    "bool": "BIT", "blob": "BLOB", "dec": "DECIMAL(12,2)",
}


def measured(expr: str, kind: str) -> str:
    """What a profile looks at: lengths of texts, values of the rest."""
    if kind == "string":
        return f"coalesce(length({expr}), 0)"
    return f"coalesce(octet_length({expr}), 0)" if kind == "blob" else expr


def bound_text(aggregate: str, expr: str, kind: str) -> str:
    value = f"{aggregate}({measured(expr, kind)})"
    if kind == "double":
        value = f"CAST({value} AS DECIMAL(38,6))"
    if kind == "time":
        return f"strftime({value}, '%Y-%m-%d %H:%M:%S')"
    return f"CAST({value} AS VARCHAR)"


def bounds_sql(table: str, spans: bool) -> str:
    """Min and max of value columns (spans) as text, one row per column."""
    wanted = [(c, k) for c, k in COLUMNS[table] if k in ("int", "bigint", "double", "time") and spans]
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{c.upper()}' AS column_name, {bound_text('min', c, k)} AS min, {bound_text('max', c, k)} AS max FROM {table}" for c, k in wanted
    )
