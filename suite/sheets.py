"""Profiling, classification and configuration queries, with the rule cascades spelled out in SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from suite import twin as w
from suite.base import query, read
from suite.schema import COLUMNS, TABLES, TYPE_TEXT, bound_text, measured
from veilspark.operators import classify as c
from veilspark.operators import configure as g
from veilspark.operators import profile as pr
from veilspark.operators.writeback import column_mapping_report
from veilspark.sources.files import rule_sheet
from veilspark.sources.scratch import materialise

# Views with the column names rule sheets talk about: view -> (table, key, [(expression, name, kind)]).
# ``{BLOB}`` stands for the binary type of the engine.
VIEWS = {
    "PERSON": (
        "customer", "PERSON_ID",
        [
            ("c_custkey", "PERSON_ID", "bigint"), ("c_name", "FIRST_NAME", "string"), ("c_name", "SURNAME", "string"), ("c_name", "FULL_NAME", "string"),
            ("c_mktsegment", "CITY", "string"), ("c_mktsegment", "HOME_CITY", "string"), ("c_mktsegment", "PROVINCE", "string"), ("c_mktsegment", "COUNTRY", "string"),
            ("c_name", "COMPANY_NAME", "string"), ("c_name", "DESCRIPTION", "string"), ("c_nationkey", "BIRTH_YEAR", "int"), ("c_nationkey", "YEAR", "int"),
            ("lpad(CAST(c_custkey AS STRING), 10, '0')", "HOME_PHONE", "string"), ("c_custkey", "PHONE_NUMBER", "bigint"), ("lpad(CAST(c_custkey AS STRING), 12, '0')", "FAX_NO", "string"),
            ("lpad(CAST(c_custkey AS STRING), 14, '0')", "CELL_PHONE", "string"), ("c_name", "EMAIL_ADDRESS", "string"), ("c_name", "POSTAL_CODE", "string"),
            ("c_name", "ADDRESS_LINE_1", "string"), ("c_name", "ADDRESS_LINE_2", "string"), ("c_name", "ADDRESS_LINE", "string"), ("c_name", "OLD_ADDRESS_1", "string"),
            ("c_name", "STREET_ADDRESS_3", "string"), ("c_name", "MAIL_ADDRESS", "string"), ("c_name", "MAIL_ADDRESS_X", "string"), ("c_name", "USERID", "string"),
            ("c_name", "FILE_NAME", "string"), ("c_acctbal", "BONUS_AMOUNT", "double"), ("c_nationkey", "SHOE_SIZE", "int"), ("c_custkey * 10000000", "BIG_COUNT", "bigint"),
            ("c_nationkey * 0", "ZERO_COUNT", "int"), ("CAST(c_acctbal AS DECIMAL(12,2))", "SALARY", "dec"), ("CAST(c_acctbal AS DECIMAL(12,2))", "LONGITUDE", "dec"), ("CAST(c_acctbal AS DECIMAL(12,2))", "LATITUDE", "dec"),
            ("substr(c_name, 1, 8)", "START_DATE", "string"), ("substr(c_name, 1, 6)", "SHIFT_TIME", "string"), ("substr(c_name, 1, 7)", "CARD_NUMBER", "string"), ("c_name", "HOME_DIRECTORY", "string"),
            ("c_mktsegment", "SEGMENT", "string"), ("c_nationkey * 0 + 1", "ONE_FLAG", "int"), ("CAST(NULL AS BIGINT)", "NOTHING", "bigint"), ("c_nationkey > 12", "ACTIVE", "bool"),
            ("CAST(c_name AS {BLOB})", "SCAN", "blob"), ("c_mktsegment", "AUTHOR", "string"), ("c_name", "LAST_NAME", "string"), ("c_nationkey", "TOTAL_AREA", "int"), ("c_acctbal", "AMT_DUE", "double"),
        ],
    ),
    "VEHICLE": (
        "part", "VEHICLE_ID",
        [("p_partkey", "VEHICLE_ID", "bigint"), ("p_brand", "MAKE", "string"), ("p_type", "MODEL", "string"), ("p_name", "VIN", "string"), ("p_name", "FUEL", "string"), ("p_type", "BODY_STYLE", "string"), ("p_name", "PAINT", "string")],
    ),
    "FLEET": (
        "supplier", "",
        [
            ("s_suppkey", "FLEET_ID", "bigint"), ("s_name", "VEHICLE_MAKE", "string"), ("s_name", "VEHICLE_MODEL", "string"), ("s_name", "VEHICLE_REGISTRATION", "string"), ("s_name", "VEHICLE_FUEL", "string"),
            ("s_name", "VEHICLE_TYPE", "string"), ("s_name", "VEHICLE_OTHER", "string"), ("s_name", "REF", "string"), ("s_name", "LINE1", "string"), ("s_name", "LINE2", "string"), ("s_name", "EDITOR", "string"),
        ],
    ),
    "SHIPMENT": ("orders", "ORDER_KEY", [("o_orderkey", "ORDER_KEY", "bigint"), ("o_orderdate", "SHIPPED", "time"), ("o_orderstatus", "CHAR_STATUS", "string"), ("o_totalprice", "PRICE", "double")]),
}
COMMENTS = {"REF": "an identifier of the fleet", "LINE1": "address, first line", "LINE2": "address, second line"}
# The given tables take part under their own names.
SOURCES = VIEWS | {t.upper(): (t, COLUMNS[t][0][0].upper(), [(n, n.upper(), k) for n, k in cols]) for t, cols in COLUMNS.items()}


def _source(spark, sf, view) -> DataFrame:
    table, _, columns = SOURCES[view]
    return read(spark, sf, table).selectExpr(*[f"{e.format(BLOB='BINARY')} AS {n}" for e, n, _ in columns])


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# Catalog --------------------------------------------------------------------------------------------


@query(
    "column_catalog",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '' AS schema_name, '{n.upper()}' AS column_name, CAST({i} AS INTEGER) AS column_id, '{TYPE_TEXT[k]}' AS data_type, CASE WHEN count({n}) < count(*) THEN 'Y' ELSE 'N' END AS nullable, count(*) AS n_rows FROM {t}"
        for t, cols in COLUMNS.items() for i, (n, k) in enumerate(cols, 1)
    ),
)
def _catalog(spark, sf):
    return pr.column_catalog({t: read(spark, sf, t) for t in TABLES})


_KEYS = {t: ([cols[0][0].upper()] if t != "lineitem" else ["L_ORDERKEY", "L_LINENUMBER"]) for t, cols in COLUMNS.items() if t not in ("labels", "embeddings")}


@query(
    "catalog_keys",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{n.upper()}' AS column_name, CAST({i} AS INTEGER) AS column_id, '{TYPE_TEXT[k]}' AS data_type, '{','.join(_KEYS.get(t, []))}' AS pk_columns FROM {t} HAVING count(*) > 0"
        for t, cols in COLUMNS.items() if t != "benchmark" for i, (n, k) in enumerate(cols, 1)
    ),
)
def _catalog_keys(spark, sf):
    """Catalog columns with key constraints; one table is a view and drops out."""
    columns = materialise(pr.column_catalog({t: read(spark, sf, t) for t in TABLES}), "catalog")
    tables = columns.select("table_name").distinct().withColumn("table_type", F.when(F.col("table_name") == "benchmark", "VIEW").otherwise("BASE TABLE"))
    constraints = tables.where(F.col("table_name").isin(*_KEYS)).select("table_name", F.concat(F.lit("pk_"), "table_name").alias("constraint_name"), F.lit("PRIMARY KEY").alias("constraint_type"))
    constraints = constraints.unionByName(constraints.select("table_name", F.concat(F.lit("fk_"), "table_name").alias("constraint_name"), F.lit("FOREIGN KEY").alias("constraint_type")))
    listed = F.create_map(*[x for t, ks in _KEYS.items() for x in (F.lit(t), F.array(*[F.lit(k) for k in ks]))])
    position = F.array_position(F.try_element_at(listed, F.col("table_name")), F.col("column_name"))
    keys = columns.withColumn("position", position).where("position > 0").select("table_name", F.concat(F.lit("pk_"), "table_name").alias("constraint_name"), "position", "column_name")
    return pr.catalog_keys(columns, constraints, keys, tables)


# Profiles -------------------------------------------------------------------------------------------


def _span_sql(table, derive=None):
    cols = [(n, k) for n, k in COLUMNS[table] if k in ("int", "bigint", "double", "time")]
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{n.upper()}' AS column_name, {bound_text('min', n, k)} AS min, {bound_text('max', n, k)} AS max FROM {table}" for n, k in cols)


@query("profile_minmax", " UNION ALL ".join(_span_sql(t) for t in ("lineitem", "orders", "part", "events")) + " UNION ALL SELECT 'part', 'LARGE', CAST(min(p_size > 25) AS VARCHAR), CAST(max(p_size > 25) AS VARCHAR) FROM part")
def _minmax(spark, sf):
    frames = {t: read(spark, sf, t) for t in ("lineitem", "orders", "part", "events")}
    frames["part"] = frames["part"].withColumn("large", F.col("p_size") > 25)
    return _union([pr.profile_minmax(t, df) for t, df in frames.items()])


def _length_sql(table, cols):
    return " UNION ALL ".join(f"SELECT '{table}' AS table_name, '{n.upper()}' AS column_name, CAST(min({measured(e, k)}) AS INTEGER) AS min_length, CAST(max({measured(e, k)}) AS INTEGER) AS max_length FROM {table}" for e, n, k in cols)


@query(
    "profile_lengths",
    " UNION ALL ".join(_length_sql(t, [(n, n, k) for n, k in COLUMNS[t] if k == "string"]) for t in ("part", "customer", "documents", "pages"))
    + " UNION ALL " + _length_sql("customer", [("CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE c_name END", "half", "string"), ("CAST(c_name AS BLOB)", "bytes", "blob")]),
)
def _lengths(spark, sf):
    frames = {t: read(spark, sf, t) for t in ("part", "customer", "documents", "pages")}
    frames["customer"] = frames["customer"].withColumns({"half": F.when(F.col("c_custkey") % 2 != 0, F.col("c_name")), "bytes": F.encode("c_name", "UTF-8")})
    return _union([pr.profile_lengths(t, df) for t, df in frames.items()])


_SWAPPED = "SELECT o_orderpriority AS column_name, CAST(max(o_custkey) AS VARCHAR(20)) AS min, CAST(min(o_custkey) AS VARCHAR(20)) AS max FROM orders GROUP BY o_orderpriority UNION ALL SELECT p_brand, min(p_name), '5' FROM part GROUP BY p_brand UNION ALL SELECT p_type, CAST(min(p_size) AS VARCHAR(20)), CAST(max(p_size) AS VARCHAR(20)) FROM part GROUP BY p_type"


@query("profile_swap_bounds", f"SELECT column_name, CASE WHEN wrong THEN max ELSE min END AS min, CASE WHEN wrong THEN min ELSE max END AS max FROM (SELECT *, coalesce(TRY_CAST(min AS INTEGER) > TRY_CAST(max AS INTEGER), false) AS wrong FROM ({_SWAPPED}))")
def _swap(spark, sf):
    for t in ("orders", "part"):
        read(spark, sf, t).createOrReplaceTempView(t)
    return pr.swap_bounds(spark.sql(_SWAPPED))


@query("catalog_union_excluded", _span_sql("part") + " UNION ALL SELECT 'part', 'IS_LARGE', 'NULL', 'NULL' UNION ALL SELECT 'part', 'ROW_GUID', 'NULL', 'NULL'")
def _excluded(spark, sf):
    part = read(spark, sf, "part")
    left_out = pr.column_catalog({"part": part.select((F.col("p_size") > 25).alias("is_large"), F.col("p_name").alias("row_guid"))}).select("table_name", "column_name")
    return pr.with_excluded(pr.profile_minmax("part", part), left_out.unionByName(left_out))


_TYPES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'VARCHAR2(' || CAST(p_size AS VARCHAR(20)) || ' BYTE)' WHEN 1 THEN 'NUMBER(' || CAST(p_size AS VARCHAR(20)) || ',2)' WHEN 2 THEN 'CHAR(' || CAST(p_size AS VARCHAR(20)) || ' BYTE)' WHEN 3 THEN 'DATE' WHEN 4 THEN 'VARCHAR' ELSE 'DECIMAL(' || CAST(p_size AS VARCHAR(20)) || ',2)' END AS data_type FROM part"


@query(
    "type_size",
    f"""SELECT p_partkey, data_type, CASE WHEN contains(data_type, 'NUMBER') THEN regexp_replace(split_part(data_type, ',', 1), '[^0-9]', '', 'g')
        WHEN contains(data_type, 'VARCHAR') THEN regexp_replace(split_part(data_type, '(', 2), '[^0-9]', '', 'g') ELSE regexp_replace(data_type, '[^0-9]', '', 'g') END AS size FROM ({_TYPES})""",
)
def _type_size(spark, sf):
    read(spark, sf, "part").createOrReplaceTempView("part")
    return spark.sql(_TYPES).withColumn("size", pr.type_size(F.col("data_type")))


# Classification -------------------------------------------------------------------------------------


def _profile_sql(view):
    table, key, columns = SOURCES[view]
    rows = []
    for i, (e, n, k) in enumerate(columns, 1):
        e = e.format(BLOB="BLOB")
        bounds = [f"coalesce({bound_text(a, e, k)}, '')" if k != "array" else "''" for a in ("min", "max")]
        nullable = f"CASE WHEN count({e}) < count(*) THEN 'Y' ELSE 'N' END" if k != "array" else "'N'"
        rows.append(
            f"SELECT '{view}' AS table_name, 'app' AS schema_name, '{n}' AS column_name, '{TYPE_TEXT[k]}' AS data_type, {nullable} AS nullable, CAST({i} AS INTEGER) AS column_id, "
            f"{w.text(COMMENTS.get(n, ''))} AS comments, '{key}' AS pk_constraint, {bounds[0]} AS min, {bounds[1]} AS max FROM {table} HAVING count(*) > 0"
        )
    return " UNION ALL ".join(rows)


PROFILE_SQL = " UNION ALL ".join(_profile_sql(v) for v in SOURCES)


def profiles(spark, sf) -> DataFrame:
    """Profiles of all views and tables, one aggregate each, kept for the steps that follow."""
    return pr.profile_tables({v: _source(spark, sf, v) for v in SOURCES}, {v: [k] for v, (_, k, _) in SOURCES.items() if k}, "app", COMMENTS)


def _in(column, *needles):
    return "(" + " OR ".join(f"contains({column}, '{x}')" for x in needles) + ")"


def _is_double(column):
    return f"coalesce(contains({column}, '.') AND TRY_CAST({column} AS DOUBLE) IS NOT NULL, false)"


def _whole(column):
    return f"(CASE WHEN regexp_full_match({column}, '[-+]?[0-9]+') THEN coalesce(TRY_CAST({column} AS BIGINT), 0) ELSE 0 END)"


_N, _T = "column_name", "data_type"
_NUM = f"(contains({_T}, 'NUMBER') OR {_T} = 'INT')"
_WHOLE = f"(NOT {_is_double('max')} AND NOT {_is_double('min')})"
_PHONE = f"({_in(_N, 'PHONE_NO', 'PHONE_NUMBER', 'FAX_NO')} OR suffix({_N}, '_PHONE') OR (suffix({_N}, '_NUMBER') AND min = '10' AND max = '10'))"
_VT, _VN = "contains(table_name, 'VEHICLE')", f"contains({_N}, 'VEHICLE')"
_LINE = f"(contains({_N}, 'ADDRESS') AND contains({_N}, '_LINE'))"
NONE = "No Masking required"


def _by_length(options, default="''"):
    return "CASE max " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in options.items()) + f" ELSE {default} END"


# (condition, rule, format SQL, reasoning) in order.
CLASSIFY_SQL = [
    (f"contains({_N}, '_ID')", NONE, "''", "Column Identifier"),
    (f"contains({_T}, 'SDO_GEOMETRY')", "ShufflePolygon", "''", "Column contains Polygon and Geometry"),
    (_in(_T, "BLOB", "VARBINARY"), "Blob", "''", "Column contains binary objects (image and docs)"),
    ("(min = '' AND max = '') OR (min = 'NULL' AND max = 'NULL') OR (min = '1' AND max = '1')", NONE, "''", "No sensitive record found in this column"),
    (_in(_T, "DATE", "TIME"), "DateOfBirth", "''", ""),
    (f"suffix({_N}, '_DATE')", "Date", _by_length({"8": "yyyyMMdd", "10": "yyyy-MM-dd", "6": "yyMMdd"}), "This column is String of DateTime"),
    (f"suffix({_N}, '_TIME')", "TimeSpan", _by_length({"4": "HHmm", "5": "HH:mm", "6": "HHmmss", "8": "HH:mm:ss", "10": "HH:mm:sstt", "11": "HH:mm:ss tt"}), ""),
    (f"contains({_N}, 'LONGITUDE') AND {_in(_T, 'NUMERIC', 'DECIMAL')}", "Longitude", "''", ""),
    (f"contains({_N}, 'LATITUDE') AND {_in(_T, 'NUMERIC', 'DECIMAL')}", "Latitude", "''", ""),
    (_in(_N, "FIRST_NAME", "FIRSTNAME", "MIDDLE_NAME"), "FirstName", "''", ""),
    (f"{_T} = 'CLOB'", "Clob", "''", ""),
    (f"{_N} = 'CITY' OR suffix({_N}, '_CITY')", "City", "'{{ADDRESS.CITY}}'", ""),
    (f"{_N} IN ('STATE', 'PROVINCE')", "State", "'{{ADDRESS.CITY}}'", ""),
    (f"contains({_N}, 'COUNTRY')", "Bogus", "'{{ADDRESS.COUNTRY}}'", ""),
    (_in(_N, "SURNAME", "LASTNAME"), "LastName", "''", ""),
    (_in(_N, "COMPANY_NAME", "ORGANIZATION_NAME"), "Company", "'{{COMPANY.COMPANYNAME}} {{COMPANY.COMPANYSUFFIX}}'", ""),
    (_in(_N, "DESCRIPTION", "TEXT", "MEMO", "COMMENT", "NOTE", "REMARK"), "Rant", "''", ""),
    (f"{_N} = 'YEAR' OR suffix({_N}, '_YEAR')", "RandomYear", "''", ""),
    (f"{_PHONE} AND contains({_T}, 'NUMBER')", "PhoneNumberInt", "'##########'", ""),
    (_PHONE, "PhoneNumber", _by_length({"12": "### ###-####", "14": "(###) ###-####"}, "'##########'"), ""),
    (f"contains({_N}, 'EMAIL_ADDRESS')", "Bogus", "'{{INTERNET.EMAIL}}'", ""),
    (f"contains({_T}, 'MONEY')", "Money", "'{{FINANCE.AMOUNT}}'", ""),
    (f"contains({_N}, 'POSTAL_CODE')", "PostalCode", "''", ""),
    (f"{_LINE} AND contains({_N}, '1')", "fullAddress", "''", ""),
    (f"{_LINE} AND {_in(_N, '2', '3')}", "SecondaryAddress", "''", ""),
    (_LINE, NONE, "''", ""),
    (f"contains({_N}, '_ADDRESS') AND contains({_N}, '1')", "fullAddress", "''", ""),
    (f"contains({_N}, '_ADDRESS') AND {_in(_N, '2', '3')}", "SecondaryAddress", "''", ""),
    (f"suffix({_N}, '_ADDRESS')", "FullAddress", "'{{address.fullAddress}}'", ""),
    (f"contains({_N}, '_ADDRESS')", "Shuffle", "''", ""),
    (f"contains({_N}, 'NAME') AND NOT {_in(_N, 'USERNAME_ONLY')}", "CompanyPersonName", "'{{NAME.FULLNAME}}'", ""),
    (f"contains({_N}, 'USERID')", "RandomUsername", "''", ""),
    (_in(_N, "_AMOUNT", "_AMT"), "RandomDec", "''", ""),
    (f"{_NUM} AND {_WHOLE} AND {_whole('max')} > 2147483647", "RandomInt64", "''", ""),
    (f"{_NUM} AND {_WHOLE} AND {_whole('max')} = 0", NONE, "''", ""),
    (f"{_NUM} AND {_WHOLE}", "RandomInt", "''", ""),
    (_NUM, "RandomDec", "''", ""),
    (f"{_VT} AND ({_N} = 'MAKE' OR suffix({_N}, '_MAKE'))", "Vehicle", "'Manufacturer'", ""),
    (f"{_VT} AND ({_N} = 'MODEL' OR suffix({_N}, '_MODEL'))", "Vehicle", "'Model'", ""),
    (f"{_VT} AND (contains({_N}, '_IDENTIFICATION_NUMBER') OR suffix({_N}, '_VIN') OR {_N} = 'VIN')", "Vehicle", "'Vin'", ""),
    (f"{_VT} AND ({_N} = 'FUEL' OR suffix({_N}, '_FUEL'))", "Vehicle", "'Fuel'", ""),
    (f"{_VT} AND {_in(_N, '_TYPE', '_STYLE')}", "Vehicle", "'Type'", ""),
    (_VT, "Shuffle", "''", ""),
    (f"{_VN} AND contains({_N}, '_MAKE')", "Vehicle", "'Manufacturer'", ""),
    (f"{_VN} AND contains({_N}, '_MODEL')", "Vehicle", "'Model'", ""),
    (f"{_VN} AND {_in(_N, '_IDENTIFICATION', '_REGISTRATION')}", "Vehicle", "'Vin'", ""),
    (f"{_VN} AND suffix({_N}, '_FUEL')", "Vehicle", "'Fuel'", ""),
    (f"{_VN} AND (suffix({_N}, '_TYPE') OR suffix({_N}, 'BODY_STYLE'))", "Vehicle", "'Type'", ""),
    (_VN, "Shuffle", "''", ""),
    (f"suffix({_N}, '_NUMBER') AND contains({_T}, 'VARCHAR')", "StringConcat", "repeat('#', coalesce(TRY_CAST(max AS INTEGER), 0))", ""),
    (f"suffix({_N}, '_DIRECTORY')", "Bogus", "'{{SYSTEM.DIRECTORYPATH}}'", ""),
    (f"{_is_double('max')} AND {_is_double('min')}", "RandomDec", "''", ""),
    ("contains(lower(comments), 'identif')", NONE, "''", ""),
    (f"contains(lower(comments), 'address') AND contains({_N}, 'LINE') AND contains({_N}, '1')", "fullAddress", "''", ""),
    (f"contains(lower(comments), 'address') AND contains({_N}, 'LINE')", "SecondaryAddress", "''", ""),
]


def _chain(pick, default):
    return "CASE " + " ".join(f"WHEN {step[0]} THEN {pick(step)}" for step in CLASSIFY_SQL) + f" ELSE {default} END"


_SWAP_SQL = f"SELECT * EXCLUDE (min, max), CASE WHEN wrong THEN max ELSE min END AS min, CASE WHEN wrong THEN min ELSE max END AS max FROM (SELECT *, coalesce(TRY_CAST(min AS INTEGER) > TRY_CAST(max AS INTEGER), false) AS wrong FROM ({PROFILE_SQL}))"
CLASSIFIED_SQL = f"""SELECT table_name, schema_name, column_name, data_type, nullable, column_id, comments, pk_constraint, min,
    CASE WHEN masking_rule = 'DateOfBirth' AND min = max AND min <> '-- ::' THEN '2024-01-01 00:00:00' ELSE max END AS max, masking_rule, string_format, rule_reasoning,
    CASE WHEN rule_reasoning = 'No sensitive record found in this column' THEN 'Completed' ELSE 'Uncompleted' END AS completed,
    CASE WHEN masking_rule = 'DateOfBirth' THEN 'FALSE' ELSE 'TRUE' END AS retain_empty,
    CASE WHEN rule_reasoning IN ('Column Identifier', 'No sensitive record found in this column') THEN 'FALSE' ELSE 'TRUE' END AS preview
    FROM (SELECT *, {_chain(lambda s: w.text(s[1]), "'Shuffle'")} AS masking_rule, {_chain(lambda s: s[2], "''")} AS string_format, {_chain(lambda s: w.text(s[3]), "''")} AS rule_reasoning FROM ({_SWAP_SQL}))"""


@query("classify_columns", CLASSIFIED_SQL)
def classified(spark, sf):
    return c.classify_columns(profiles(spark, sf))


@query(
    "classify_defaults",
    f"""SELECT table_name, column_name, masking_rule, retain_empty, preview, 'TRUE' AS retain_null, 'TARGET' AS target_schema, '' AS use_value,
        CASE WHEN pk_constraint = '' THEN 'ID_' || table_name ELSE pk_constraint END AS key_column FROM ({CLASSIFIED_SQL})""",
)
def _defaults(spark, sf):
    rows = c.classify_defaults(classified(spark, sf), "target")
    key = c.key_constraint(F.col("pk_constraint"), F.concat(F.lit("ID_"), "table_name"))
    return rows.select("table_name", "column_name", "masking_rule", "retain_empty", "preview", "retain_null", "target_schema", "use_value", key.alias("key_column"))


_BOUNDED = f"({_in(_T, 'DATE', 'NUMBER', 'MONEY', 'DECIMAL', 'FLOAT', 'BIT', 'VARCHAR', 'TEXT')} OR {_T} IN ('INT', 'INTEGER'))"


@query(
    "classify_simple",
    f"""SELECT table_name, column_name, data_type, CASE WHEN contains({_T}, 'DATE') THEN 'DateOfBirth' WHEN contains({_N}, '_ID') THEN 'No Masking required' ELSE 'Shuffle' END AS masking_rule,
        'TRUE' AS retain_null, 'TRUE' AS retain_empty, 'FALSE' AS preview, CASE WHEN {_BOUNDED} THEN min ELSE '' END AS min, CASE WHEN {_BOUNDED} THEN max ELSE '' END AS max FROM ({PROFILE_SQL})""",
)
def _simple(spark, sf):
    return c.classify_simple(profiles(spark, sf))


# Rule sheets ----------------------------------------------------------------------------------------

# Rule texts and formats of a third copy of the sheet, taken in turn: explicit rules and mistakes.
EXPLICIT = [
    ("MaskingOut", "MaskingRight(4)"), ("scramble", ""), ("TimeSpan", "HHmm"), ("PickRandom", "A,Blue,C"), ("math addition", "A,B"), ("Filename", ""), ("RandomHexa", "8"),
    ("Unknown thing", ""), ("Flagged", ""), ("State", ""), ("City", ""), ("Money", ""), ("Lorem", ""), ("StringFormat", "##"), ("Randomint64", ""), ("Date", ""), ("DateOfBirth", ""),
    ("Rant", ""), ("NoMasking", ""), ("Vehicle", "Wheel"), ("Vehicle", ""), ("RandomDec", ""), ("MaskingOut", ""), ("ShufflePolygon", ""), ("PhoneNumber", ""), ("FullName", "x"), ("math", ""),
    ("PostalCode", "y"), ("Blob", ""), ("Bogus", ""),
]
_RULES, _FORMATS = [r for r, _ in EXPLICIT], [f for _, f in EXPLICIT]
_SHEET_COLUMNS = "table_name, schema_name, column_name, data_type, column_id, comments, pk_constraint, min, max, masking_rule, string_format, rule_reasoning, retain_empty, preview"
_AT = f"CAST(column_id % {len(EXPLICIT)} AS INT) + 1"
SHEET_SQL = f"""WITH cl AS ({CLASSIFIED_SQL})
    SELECT {_SHEET_COLUMNS} FROM cl
    UNION ALL SELECT table_name || '_OPEN', schema_name, column_name, CASE WHEN data_type = 'VARCHAR' AND column_id % 3 = 0 THEN 'VARCHAR2(30 BYTE)' WHEN data_type = 'VARCHAR' AND column_id % 3 = 1 THEN 'NTEXT(40)' WHEN data_type = 'VARCHAR' THEN 'NTEXT' ELSE data_type END, column_id, comments, pk_constraint, min, max, 'Replace Value with fake data', string_format, rule_reasoning, retain_empty, preview FROM cl
    UNION ALL SELECT table_name || '_EXPLICIT', schema_name, column_name, data_type, column_id, comments, pk_constraint, min, CASE WHEN column_id % 7 = 0 THEN '-- ::' ELSE max END, list_extract({w.words(_RULES)}, {_AT}), list_extract({w.words(_FORMATS)}, {_AT}), 'addition', retain_empty, preview FROM cl"""


def sheet(spark, sf) -> DataFrame:
    """Three copies of the classified columns: as classified, left open, and with explicit rules and mistakes."""
    cl = classified(spark, sf)
    text, at, nth = F.col("data_type") == "VARCHAR", (F.col("column_id") % len(EXPLICIT)).cast("int"), F.col("column_id") % 3
    kind = F.when(text & (nth == 0), "VARCHAR2(30 BYTE)").when(text & (nth == 1), "NTEXT(40)").when(text, "NTEXT").otherwise(F.col("data_type"))
    opened = cl.withColumns({"table_name": F.concat("table_name", F.lit("_OPEN")), "data_type": kind, "masking_rule": F.lit("Replace Value with fake data")})
    explicit = cl.withColumns(
        {
            "table_name": F.concat("table_name", F.lit("_EXPLICIT")), "max": F.when(F.col("column_id") % 7 == 0, "-- ::").otherwise(F.col("max")),
            "masking_rule": F.get(F.array(*[F.lit(r) for r in _RULES]), at), "string_format": F.get(F.array(*[F.lit(f) for f in _FORMATS]), at), "rule_reasoning": F.lit("addition"),
        }
    )
    rows = cl.unionByName(opened).unionByName(explicit)
    return materialise(rows.withColumns({"retain_null": F.lit("TRUE"), "use_value": F.lit(""), "description": F.lit("")}), "sheet")


@query(
    "rule_sheet_load",
    f"""SELECT table_name, column_name, 'max' AS row_count, data_type, '' AS nullable, CAST(column_id AS VARCHAR) AS column_id, comments, '' AS description, pk_constraint, schema_name, '' AS target_schema,
        'TRUE' AS retain_null, 'FALSE' AS retain_empty, preview, min, max, masking_rule, '' AS rule_set_by, rule_reasoning, '' AS completed, string_format, '' AS use_value FROM ({SHEET_SQL})""",
)
def _sheet_load(spark, sf):
    """A rule sheet under the names sheets use, some columns missing, some cells empty, read back from csv."""
    from veilspark.sources.files import scan_csv
    from veilspark.sources.scratch import scratch_path

    names = {
        "TABLE_NAME": "table_name", "COLUMN_NAME": "column_name", "DATA_TYPE": "data_type", "COLUMN_ID": "column_id", "COMMENTS": "comments", "PKconstraintName": "pk_constraint",
        "SCHEMA": "schema_name", "Preview": "preview", "Min": "min", "max": "max", "Masking Rule": "masking_rule", "Rule Reasoning": "rule_reasoning", "StringFormat": "string_format",
    }
    path = scratch_path(spark, "sheet-csv")
    # "min" and "max" differ from "Min" only by case elsewhere, so the columns are taken one by one.
    rows = sheet(spark, sf)
    rows.select(*[F.col(c).alias(n) for n, c in names.items()]).write.option("header", True).option("sep", "|").option("quoteAll", True).csv(path)
    return rule_sheet(scan_csv(spark, path))


def _cut(column):
    return f"CASE WHEN strpos({column}, '.') > 1 THEN split_part({column}, '.', 1) ELSE {column} END"


_R, _UN, _UT = "upper(masking_rule)", "upper(column_name)", "upper(data_type)"
_SIZE = "nullif(list_extract(string_split(replace(replace(upper(data_type), '(', ' '), ')', ' '), ' '), 2), '')"
_CUTS = ", ".join(f"'{x}'" for x in g.CUT_BOUNDS)
_NAMES = {n.lower(): n for n in g.RULE_TYPES if n not in ("Error", "Filename")} | {"filename": "File"}
_PARSED = "CASE lower(trim(masking_rule)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMES.items()) + " END"
_OPEN_CHOICE = "(" + " OR ".join(f"contains({_R}, '{x}')" for x in g.BY_NAME_RULES) + ")"
_UPHONE = _in(_UN, "PHONE_NO", "FAX_NO", "CONTRACT_NO", "CELL", "_PHONE", "PHONENUMBER")
_PATTERN = "CASE parsed " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in {**g.FIXED_PATTERN, **{n: "" for n in g.NO_PATTERN}}.items()) + " ELSE string_format END"
_UNDATED = "(max = '-- ::' OR min = '-- ::')"
_P10 = "CASE WHEN string_format = '' THEN '##########' ELSE string_format END"
_GMIN, _GMAX = f"CASE WHEN parsed IN ({_CUTS}) THEN {_cut('min')} ELSE min END", f"CASE WHEN parsed IN ({_CUTS}) THEN {_cut('max')} ELSE max END"

# (condition, type, pattern, min, max, ignored, gender) as SQL, in order.
_X, _MIN, _MAX = "NOT open_choice AND ", "min", "max"
CONFIG_SQL_STEPS = [
    (f"contains({_R}, 'NO MASKING') AND contains({_UT}, 'GEOMETRY')", "'Geometry'", "''", _MIN, _MAX, "true", "''"),
    (f"contains({_R}, 'NO MASKING')", "'NoMasking'", "''", _MIN, _MAX, "true", "''"),
    (f"{_R} = 'SHUFFLE'", "'Shuffle'", "''", _MIN, _MAX, "false", "''"),
    (f"contains({_R}, 'MATH')", "'math'", "string_format", _MIN, _MAX, "false", "''"),
    (_X + "parsed IS NULL", "'None'", "''", "''", "''", "true", "''"),
    (_X + "parsed IN ('NULL', 'Ignore', 'Location', 'exception', 'Computed', 'RandomHexa')", "'None'", "''", "''", "''", "false", "''"),
    (_X + "parsed = 'NoMasking'", "'None'", "''", "''", "''", "true", "''"),
    (_X + "parsed = 'MaskingOut'", "parsed", "split_part(string_format, '(', 1)", _MIN, "regexp_replace(string_format, '[^0-9]', '', 'g')", "false", "''"),
    (_X + "parsed = 'DateOfBirth'", "parsed", _PATTERN, _GMIN, "CASE WHEN max = min AND max <> '-- ::' THEN '2024-01-01 00:00:00' ELSE max END", _UNDATED, "''"),
    (_X + "parsed = 'Date'", "parsed", _PATTERN, _GMIN, _GMAX, _UNDATED, "''"),
    (_X + "parsed = 'Rant'", "parsed", _PATTERN, "'1'", _GMAX, "false", "''"),
    (_X + "parsed IN ('PhoneNumber', 'PhoneNumberInt')", "parsed", _P10, _GMIN, _GMAX, "false", "''"),
    (_X + "parsed = 'Blob'", "parsed", "coalesce(file_name, '')", _GMIN, _GMAX, "false", "''"),
    ("NOT open_choice", "parsed", _PATTERN, _GMIN, _GMAX, "false", "''"),
    (f"contains({_UN}, 'LONGITUDE') AND {_in(_UT, 'NUMERIC', 'DECIMAL')}", "'Longitude'", "''", _MIN, _MAX, "false", "''"),
    (f"contains({_UN}, 'LATITUDE') AND {_in(_UT, 'NUMERIC', 'DECIMAL')}", "'Latitude'", "''", _MIN, _MAX, "false", "''"),
    (_in(_UN, "FIRST_NAME", "FIRSTNAME", "MIDDLE_NAME"), "'FirstName'", "'{{NAME.FIRSTNAME}}'", _MIN, _MAX, "false", "''"),
    (f"{_UT} IN ('BLOB', 'IMAGE')", "'Blob'", "coalesce(file_name, string_format)", _MIN, _MAX, "false", "''"),
    (f"{_UT} = 'CLOB'", "'Clob'", "string_format", _MIN, _MAX, "false", "''"),
    (f"contains({_UN}, 'CITY')", "'City'", "'BC'", _MIN, _MAX, "false", "'Canada'"),
    (_in(_UN, "STATE", "PROVINCE"), "'State'", "'Canada'", _MIN, _MAX, "false", "'Canada'"),
    (f"contains({_UN}, 'COUNTRY')", "'Bogus'", "'{{ADDRESS.COUNTRY}}'", _MIN, _MAX, "false", "'Canada'"),
    (f"contains({_UT}, 'GEOMETRY')", "'ShufflePolygon'", "string_format", _MIN, _MAX, "false", "''"),
    (_in(_UN, "SURNAME", "LASTNAME", "LAST_NAME"), "'LastName'", "'{{NAME.LASTNAME}}'", _MIN, _MAX, "false", "''"),
    (_in(_UN, "COMPANY_NAME", "ORGANIZATION_NAME"), "'Company'", "'{{COMPANY.COMPANYNAME}} {{COMPANY.COMPANYSUFFIX}}'", _MIN, _MAX, "false", "''"),
    (f"{_in(_UN, 'DESCRIPTION', 'TEXT', 'MEMO', 'COMMENT', 'NOTE', 'REMARK', 'DESC')} OR contains({_UT}, 'CHAR') OR {_in('comments', *g.COMMENT_WORDS)}", "'Rant'", "'DESCRIPTION'", "'1'", f"coalesce({_SIZE}, max)", "false", "''"),
    (f"contains({_UT}, 'DATE')", "'DateOfBirth'", "''", _MIN, _MAX, "false", "''"),
    (f"{_UN} = 'YEAR'", "'RandomYear'", "''", _MIN, _MAX, "false", "''"),
    (f"{_UPHONE} AND contains({_UT}, 'NUMBER')", "'PhoneNumberInt'", _P10, _MIN, _MAX, "false", "''"),
    (_UPHONE, "'PhoneNumber'", _P10, _MIN, _MAX, "false", "''"),
    (f"contains({_UN}, 'EMAIL_ADDRESS')", "'Bogus'", "'{{INTERNET.EMAIL}}'", _MIN, _MAX, "false", "''"),
    (f"contains({_UT}, 'MONEY')", "'Money'", "'{{FINANCE.AMOUNT}}'", _MIN, _MAX, "false", "''"),
    (f"contains({_UN}, 'POSTAL_CODE')", "'PostalCode'", "''", _MIN, _MAX, "false", "''"),
    (f"contains({_UN}, 'ADDRESS') AND {_SIZE} IS NOT NULL AND {_in('column_name', '2', '3')}", "'SecondaryAddress'", "'{{address.fullAddress}}'", _MIN, _SIZE, "false", "'Canada'"),
    (f"contains({_UN}, 'ADDRESS') AND {_SIZE} IS NOT NULL AND contains({_UN}, 'STREET')", "'StreetAddress'", "'{{address.fullAddress}}'", _MIN, _SIZE, "false", "'Canada'"),
    (f"contains({_UN}, 'ADDRESS')", "'FullAddress'", "'{{address.fullAddress}}'", _MIN, f"coalesce({_SIZE}, max)", "false", "'Canada'"),
    (_in(_UN, "USERID", "USERNAME"), "'RandomUsername'", "''", _MIN, _MAX, "false", "''"),
    (f"contains({_UN}, 'FILE_NAME')", "'File'", "'{{SYSTEM.FILENAME}}'", _MIN, _MAX, "false", "''"),
    (f"{_in(_UN, *g.NAME_WORDS)} OR {_in('comments', *g.NAME_WORDS)}", "'Bogus'", "'{{NAME.FULLNAME}}'", _MIN, _MAX, "false", "''"),
    (f"{_in(_UN, 'AMOUNT', 'AMT')} OR contains(comments, 'Amount')", "'RandomDec'", "''", _MIN, _MAX, "false", "''"),
    (f"{_UN} = 'NAME'", "'Bogus'", "'{{COMPANY.COMPANYNAME}}'", _MIN, _MAX, "false", "''"),
    (f"{_in(_UN, 'AUTHOR', 'EDITOR')} AND contains({_UT}, 'VARCHAR')", "'FullName'", "''", _cut("min"), _cut("max"), "false", "''"),
    (f"contains({_UT}, 'NUMBER')", "'RandomInt'", "''", _MIN, _MAX, "false", "''"),
    (f"{_UN} = 'TOTAL_AREA'", "'Bogus'", "''", _MIN, _MAX, "false", "''"),
]


def _step(i, default):
    return "CASE " + " ".join(f"WHEN {s[0]} THEN {s[i]}" for s in CONFIG_SQL_STEPS) + f" ELSE {default} END"


_ANY_STEP = "(" + " OR ".join(f"({s[0]})" for s in CONFIG_SQL_STEPS) + ")"
CONFIG_SQL = f"""SELECT table_name, column_name, {_step(1, "'Ignore'")} AS type, {_step(5, 'true')} AS "ignore", {_step(2, "''")} AS pattern, {_step(3, 'min')} AS min, {_step(4, 'max')} AS max,
    CASE WHEN contains({_R}, 'MATH') THEN rule_reasoning ELSE '' END AS operator, {_step(6, "''")} AS gender_column, true AS retain_null,
    CASE WHEN NOT open_choice AND NOT contains({_R}, 'MATH') AND parsed IN ('DateOfBirth', 'Date') THEN false ELSE upper(retain_empty) <> 'FALSE' END AS retain_empty, CAST(NULL AS VARCHAR) AS use_value, upper(preview) <> 'FALSE' AS preview,
    NOT coalesce({_ANY_STEP}, false) AS unmapped
    FROM (SELECT *, {_PARSED} AS parsed, {_OPEN_CHOICE} AS open_choice, max(CASE WHEN column_name IN ('FILE_NAME', 'FILENAME') THEN column_name END) OVER (PARTITION BY table_name) AS file_name FROM ({SHEET_SQL}))
    WHERE NOT list_contains(list_transform(string_split(pk_constraint, ','), lambda k: trim(k)), column_name) AND NOT contains({_R}, 'FLAGGED')"""


@query("rule_to_config", CONFIG_SQL)
def config(spark, sf):
    return g.rule_to_config(sheet(spark, sf))


@query("unmapped_columns", f"SELECT table_name, column_name, count(*) OVER () AS n_unmapped FROM ({CONFIG_SQL}) WHERE unmapped")
def _unmapped(spark, sf):
    return g.unmapped_columns(config(spark, sf))


@query("tables_without_key", f"SELECT table_name, count(*) AS n_columns FROM ({SHEET_SQL}) WHERE pk_constraint = '' GROUP BY table_name")
def _without_key(spark, sf):
    return g.tables_without_key(sheet(spark, sf))


_LR = "lower(trim(masking_rule))"
_TEXTY = _in(_UT, *g.TEXT_TYPES)
VIOLATIONS = [
    (f"contains({_LR}, 'math') AND {_TEXTY}", "math on a text type"),
    (f"contains({_LR}, 'math') AND string_format = ''", "math without pattern"),
    (f"{_LR} = 'vehicle' AND string_format = ''", "Vehicle without pattern"),
    (f"{_LR} = 'vehicle' AND string_format NOT IN ('', 'Manufacturer', 'Vin', 'Model', 'Type', 'Fuel')", "Vehicle of unknown kind"),
    (f"{_LR} = 'maskingout' AND NOT {_TEXTY}", "MaskingOut on a type that is not text"),
    (f"{_LR} = 'maskingout' AND string_format = ''", "MaskingOut without pattern"),
    (f"{_LR} = 'scramble' AND NOT {_in(_UT, *g.SCRAMBLE_TYPES)}", "Scramble on another type"),
    (f"{_LR} IN ('timespan', 'stringconcat', 'bogus') AND string_format = ''", "rule without pattern"),
    (f"{_LR} IN ('randomusername', 'dateofbirth', 'date', 'randomstring2') AND (min = '' OR max = '')", "rule without Min and Max"),
    (f"{_LR} = 'date' AND string_format = ''", "Date without pattern"),
    (f"{_LR} = 'pickrandom' AND (string_format = '' OR max = '')", "PickRandom without list or Max"),
    (f"{_LR} = 'pickrandom' AND string_format <> '' AND max <> '' AND list_max(list_transform(string_split(string_format, ','), lambda x: length(x))) > TRY_CAST({_cut('max')} AS INTEGER)", "PickRandom item longer than Max"),
    (f"{_LR} IN ('rant', 'lorem') AND max = ''", "text rule without Max"),
    (f"{_LR} IN ('randomdec', 'randomint') AND max = ''", "number rule without Max"),
    (f"{_LR} IN ('randomdec', 'randomint') AND min = ''", "number rule without Min"),
]


@query("rule_violations", f"WITH sheet AS ({SHEET_SQL}) " + " UNION ALL ".join(f"SELECT table_name, column_name, {w.text(text)} AS violation FROM sheet WHERE {cond}" for cond, text in VIOLATIONS))
def _violations(spark, sf):
    return g.rule_violations(sheet(spark, sf))


@query(
    "column_mapping_report",
    f"""SELECT f.table_name, f.column_name, s.masking_rule, f.type AS rule_applied, f.ignore AS ignored, f.pattern AS format_pattern,
        CASE WHEN f.min = '' THEN 'Null' ELSE f.min END || ' - ' || CASE WHEN f.max = '' THEN 'Null' ELSE f.max END AS min_max FROM ({CONFIG_SQL}) f JOIN ({SHEET_SQL}) s USING (table_name, column_name)""",
)
def _mapping(spark, sf):
    rows = sheet(spark, sf)
    return column_mapping_report(g.rule_to_config(rows), rows)


_OLD = f"SELECT * REPLACE (CASE WHEN column_name = 'SEGMENT' THEN 'Lorem' ELSE type END AS type, CASE WHEN column_name = 'CITY' THEN '5' ELSE min END AS min) FROM cfg WHERE column_name <> 'AUTHOR'"
_PROPS = [x for x in g.CONFIG if x not in ("table_name", "column_name")]


def _long(source, value):
    return " UNION ALL ".join(f"SELECT table_name, column_name, '{x}' AS property, CAST(\"{x}\" AS VARCHAR) AS {value} FROM {source}" for x in _PROPS)


@query(
    "config_diff",
    f"WITH cfg AS ({CONFIG_SQL}), old AS ({_OLD}), a AS ({_long('old', 'old_value')}), b AS ({_long('cfg', 'new_value')}) SELECT table_name, column_name, property, old_value, new_value FROM a FULL JOIN b USING (table_name, column_name, property) WHERE old_value IS DISTINCT FROM new_value",
)
def _config_diff(spark, sf):
    built = config(spark, sf)
    saved = built.where(F.col("column_name") != "AUTHOR").withColumns(
        {"type": F.when(F.col("column_name") == "SEGMENT", "Lorem").otherwise(F.col("type")), "min": F.when(F.col("column_name") == "CITY", "5").otherwise(F.col("min"))}
    )
    return g.config_diff(built, saved)


# Arithmetic rules over catalog positions: sources that come later, are text, or do not exist.
_MATH_PICK = "CASE column_id % 4 WHEN 0 THEN 'L_QUANTITY, L_RETURNFLAG' WHEN 1 THEN column_name WHEN 2 THEN 'L_DISCOUNT' ELSE 'NO_SUCH' END"
_MATH_OPERATOR = "CASE WHEN column_id % 3 = 0 THEN 'multiplication' ELSE 'addition' END"
_LINE_SQL = " UNION ALL ".join(f"SELECT 'lineitem' AS table_name, '{n.upper()}' AS column_name, {i} AS column_id, '{TYPE_TEXT[k]}' AS data_type FROM lineitem HAVING count(*) > 0" for i, (n, k) in enumerate(COLUMNS["lineitem"], 1))


@query(
    "math_source_check",
    f"""WITH c AS ({_LINE_SQL}), r AS (SELECT table_name, column_name, column_id, {_MATH_OPERATOR} AS operator, trim(unnest(string_split({_MATH_PICK}, ','))) AS source FROM c WHERE column_id > 3),
    j AS (SELECT r.*, c.column_id AS pos, c.data_type AS kind FROM r LEFT JOIN c ON c.table_name = r.table_name AND c.column_name = r.source)
    SELECT table_name, column_name, source, 'source must come earlier' AS violation FROM j WHERE source <> column_name AND coalesce(pos, 2147483647) >= column_id
    UNION ALL SELECT table_name, column_name, source, 'source must be numeric' FROM j WHERE NOT {_in("coalesce(kind, '')", 'INT', 'NUM', 'FLOAT', 'DEC', 'DOUBLE')}
    UNION ALL SELECT table_name, column_name, source, 'operator without formula' FROM j WHERE operator = 'multiplication'""",
)
def _math_check(spark, sf):
    catalog = pr.column_catalog({"lineitem": read(spark, sf, "lineitem")})
    rows = catalog.select(
        "table_name", "column_name", F.col("column_id").alias("position"), "data_type", F.when(F.col("column_id") > 3, "math").otherwise("NoMasking").alias("type"),
        F.expr(_MATH_PICK).alias("pattern"), F.expr(_MATH_OPERATOR).alias("operator"),
    )
    return g.math_source_check(rows)
