"""Generator queries: one masked column of a given table per rule type."""

from __future__ import annotations

import datetime as dt

from suite import twin as w
from suite.base import mask_query
from veilspark.functions import pools as p
from veilspark.plans.rules import ColumnRule

LOW, HIGH = dt.datetime(1990, 1, 1), dt.datetime(2024, 1, 1)
GENDER = "CASE c_custkey % 4 WHEN 0 THEN 'M' WHEN 1 THEN 'female' WHEN 2 THEN 'x' END AS gender"


def _gen(name, table, key, column, rule, dom, finish=lambda v: v, as_text=False, sql_value=None):
    keys = (key,) if isinstance(key, str) else key
    scope, key_sql = f"{table}.{column}", w.key(*keys)
    value = sql_value or w.differing(dom, scope, key_sql, column, finish, as_text)
    listed = ", ".join(keys)
    mask_query(
        name, table, key, [ColumnRule(column, **rule)],
        f"SELECT {listed}, {w.kept_null(column, value)} AS masked FROM {table}",
        derive=[*keys, column], output=[*keys, f"{column} AS masked"],
    )


def _gendered(name, rule_type, female, male, everyone):
    scope, key_sql = "customer.c_name", w.key("c_custkey")
    value = (
        f"CASE WHEN lower(gender) IN ('m', 'male') THEN {w.differing(male, scope, key_sql, 'c_name')} "
        f"WHEN lower(gender) IN ('f', 'female') THEN {w.differing(female, scope, key_sql, 'c_name')} "
        f"ELSE {w.differing(everyone, scope, key_sql, 'c_name')} END"
    )
    mask_query(
        name, "customer", "c_custkey", [ColumnRule("c_name", rule_type, gender_column="gender")],
        f"SELECT c_custkey, gender, {w.kept_null('c_name', value)} AS masked FROM (SELECT c_custkey, c_name, {GENDER} FROM customer)",
        derive=["c_custkey", "c_name", GENDER], output=["c_custkey", "gender", "c_name AS masked"],
    )


def cut(n):
    return lambda v: f"substr({v}, 1, {n})"


_gendered("gen_first_name", "FirstName", w.pool(p.FEMALE_NAMES), w.pool(p.MALE_NAMES), w.FIRST)
_gendered("gen_full_name", "FullName", w.cat(w.pool(p.FEMALE_NAMES), " ", w.LAST), w.cat(w.pool(p.MALE_NAMES), " ", w.LAST), w.FULL)


def _gender_aware():
    """Every way a gender is written, another letter and none; the masked name must come from the matching list."""
    gender = "CASE s_suppkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'male' WHEN 2 THEN 'f' WHEN 3 THEN 'Female' WHEN 4 THEN 'MALE' WHEN 5 THEN 'x' END AS gender"
    scope, key_sql = "supplier.s_name", w.key("s_suppkey")
    value = (
        f"CASE WHEN s_suppkey % 7 IN (0, 1, 4) THEN {w.differing(w.pool(p.MALE_NAMES), scope, key_sql, 's_name')} "
        f"WHEN s_suppkey % 7 IN (2, 3) THEN {w.differing(w.pool(p.FEMALE_NAMES), scope, key_sql, 's_name')} ELSE {w.differing(w.FIRST, scope, key_sql, 's_name')} END"
    )
    of_list = "CASE WHEN s_suppkey % 7 IN (0, 1, 4) THEN 'm' WHEN s_suppkey % 7 IN (2, 3) THEN 'f' END"
    female, male = ", ".join(map(w.text, p.FEMALE_NAMES)), ", ".join(map(w.text, p.MALE_NAMES))
    mask_query(
        "gender_aware", "supplier", "s_suppkey", [ColumnRule("s_name", "FirstName", gender_column="gender")],
        f"SELECT s_suppkey, {gender}, {w.kept_null('s_name', value)} AS masked, {of_list} AS list FROM supplier",
        derive=["s_suppkey", "s_name", gender],
        output=["s_suppkey", "gender", "s_name AS masked", f"CASE WHEN lower(gender) IN ('m', 'male', 'f', 'female') THEN CASE WHEN s_name IN ({male}) THEN 'm' WHEN s_name IN ({female}) THEN 'f' END END AS list"],
    )


_gender_aware()

CUSTOMER = ("customer", "c_custkey", "c_name")
SUPPLIER = ("supplier", "s_suppkey", "s_name")
PART = ("part", "p_partkey", "p_name")
_gen("gen_last_name", *CUSTOMER, dict(type="LastName"), w.LAST)
_gen("gen_username", *CUSTOMER, dict(type="RandomUsername", max="12"), w.USER, cut(12))
_gen("gen_company", *SUPPLIER, dict(type="Company"), w.cat(w.COMPANY, " ", w.pool(p.COMPANY_SUFFIXES)))
_supplier_key = w.key("s_suppkey")
_gen(
    "gen_company_person", *SUPPLIER, dict(type="CompanyPersonName", max="20"), None,
    sql_value=(
        f"CASE WHEN {w.h('supplier.s_name', _supplier_key, 'c')} % 2 = 0 THEN {w.differing(w.COMPANY, 'supplier.s_name', _supplier_key, 's_name', cut(20))} "
        f"ELSE {w.differing(w.FULL, 'supplier.s_name', _supplier_key, 's_name', cut(20))} END"
    ),
)

# Dates
ORDER_DATE, ORDER_STATUS = ("orders", "o_orderkey", "o_orderdate"), ("orders", "o_orderkey", "o_orderpriority")
_gen("gen_date_of_birth", *ORDER_DATE, dict(type="DateOfBirth", min="1996-01-01", max="2018-12-30"), w.secs(dt.datetime(1996, 1, 1), dt.datetime(2018, 12, 30)))
_gen("gen_date_text", *ORDER_STATUS, dict(type="Date", pattern="yyyy-MM-dd"), w.via(w.dates(LOW, HIGH), lambda v: f"strftime({v}, '%Y-%m-%d')"))
_day = w.secs(LOW, LOW + dt.timedelta(seconds=86399))
_gen("gen_time_text", "events", "event_id", "event_type", dict(type="TimeSpan", pattern="HH:mm:ss tt"), w.via(_day, lambda v: f"strftime({v}, '%H:%M:%S %p')"))
_gen("gen_year", *ORDER_STATUS, dict(type="RandomYear", min="1995", max="2010"), w.via(w.ints(1995, 2010), lambda v: f"lpad(CAST({v} AS VARCHAR), 4, '0')"))
_gen("gen_month", *ORDER_STATUS, dict(type="RandomMonth", pattern="string"), w.pool(p.MONTHS))
_gen("gen_season", *ORDER_STATUS, dict(type="RandomSeason"), w.via(w.ints(1990, 2024), lambda v: f"(CAST({v} AS VARCHAR) || '/' || lpad(CAST(({v} + 1) % 100 AS VARCHAR), 2, '0'))"))

# Numbers
LINE = ("l_orderkey", "l_linenumber")
_gen("gen_int", "lineitem", LINE, "l_partkey", dict(type="RandomInt", min="1000000", max="9000000"), w.ints(1000000, 9000000, "INTEGER"))
_gen("gen_int64", "orders", "o_orderkey", "o_custkey", dict(type="Randomint64", min="1", max="90000000000"), w.ints(1, 90000000000))
_gen("gen_decimal", "lineitem", LINE, "l_quantity", dict(type="RandomDec", min="100", max="400"), w.decs("100", "400", 6, "DECIMAL(18,6)"))
_gen("gen_money", "lineitem", LINE, "l_extendedprice", dict(type="Money"), w.decs("0", "1000", 2, "DECIMAL(18,2)"))
_gen("gen_longitude", "supplier", "s_suppkey", "s_acctbal", dict(type="Longitude"), w.decs("-180", "180", 4, "DECIMAL(9,4)"))
_gen("gen_latitude", "supplier", "s_suppkey", "s_acctbal", dict(type="Latitude"), w.decs("-90", "90", 4, "DECIMAL(9,4)"))

# Patterns
_gen("gen_hex", *CUSTOMER, dict(type="RandomHexa", pattern="20"), w.cat("0x", w.chars(p.HEX_DIGITS, 20)))
_gen("gen_string2", *PART, dict(type="RandomString2", pattern="BK309056", max="8"), w.chars("BK30956", 8))
_gen("gen_pick", *ORDER_STATUS, dict(type="PickRandom", pattern="1-URGENT,2-HIGH,Yes, NO"), w.pool(["1-URGENT", "2-HIGH", "Yes", " NO"]))
_gen("gen_template_symbols", *CUSTOMER, dict(type="StringFormat", pattern="AC-##??/**#"), w.symbols("AC-##??/**#"))
_gen("gen_phone", *CUSTOMER, dict(type="PhoneNumber", pattern="(###) ###-####", max="12"), w.symbols("(###) ###-####"), cut(12))
_gen("gen_phone_int", *CUSTOMER, dict(type="PhoneNumberInt"), w.via(w.symbols("##########"), lambda v: f"CAST({v} AS BIGINT)"), as_text=True)
_gen("gen_string_concat", *PART, dict(type="StringConcat", pattern="??-####-*", max="8"), w.symbols("??-####-*"), cut(8))
_gen("gen_postal_code", *CUSTOMER, dict(type="PostalCode"), w.symbols("?#?#?#"))
_bogus = w.cat(w.cat(w.USER, "@", w.pool(p.MAIL_HOSTS)), " / ", w.cat(w.pool(p.PRODUCT_ADJECTIVES), " ", w.pool(p.PRODUCT_MATERIALS), " ", w.pool(p.PRODUCTS)), " #", w.digits(4))
_gen("gen_bogus", *CUSTOMER, dict(type="Bogus", pattern="{{INTERNET.EMAIL}} / {{commerce.productName}} #{{RANDOMIZER.DIGITS}}", max="50"), _bogus, cut(50))

# Text
_gen("gen_lorem", *PART, dict(type="Lorem", max="100"), w.filler(3, "\n"), cut(100))
_gen("gen_rant", *PART, dict(type="Rant", min="2", max="260"), w.cat(w.filler(3), "\n\n", w.filler(3)), cut(260))
_utf16 = lambda v: f"to_base64(unhex(regexp_replace(hex({v}), '(..)', '\\100', 'g')))"
_gen("gen_clob", *PART, dict(type="Clob"), w.filler(4), _utf16)

# Things and places
_gen("gen_vehicle", *PART, dict(type="Vehicle", pattern="Vin"), w.chars(p.VIN_ALPHABET, 17))
_gen("gen_full_address", *CUSTOMER, dict(type="FullAddress", max="40"), w.FULL_ADDRESS, cut(40))
_gen("gen_street_address", *CUSTOMER, dict(type="StreetAddress", max="20"), w.STREET, cut(20))
_gen("gen_secondary_address", *CUSTOMER, dict(type="SecondaryAddress", max="8"), w.SECOND_LINE, cut(8))
_gen("gen_state", *CUSTOMER, dict(type="State", pattern="Canada", max="14"), w.pool([s for s in p.STATES["Canada"] if len(s) < 14]))
_gen("gen_city", *CUSTOMER, dict(type="City", pattern="BC", max="10"), w.pool([c for c in p.PLACES["BC"] if len(c) < 10]))
_named = lambda v: f"right(CASE WHEN contains(url, '.') THEN {v} || '.' || list_extract(string_split(url, '.'), -1) ELSE {v} END, 30)"
_gen("gen_file", "pages", "page_id", "url", dict(type="File", max="30"), w.FILE_STEM, _named)
_gen("gen_filename", "pages", "page_id", "url", dict(type="Filename", max="15"), w.FILE_STEM, lambda v: f"right({v}, 15)")
