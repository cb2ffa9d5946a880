"""Location columns: one address record per row, a record per country, the address book itself."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from suite import twin as w
from suite.base import SETTINGS, query, read
from veilspark.functions import pools as p
from veilspark.operators.location import location_by_country, record_weights
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, TableRule
from veilspark.sources import files
from veilspark.sources.scratch import scratch_path

R = ColumnRule
CKEY, SKEY = w.key("c_custkey"), w.key("s_suppkey")

# An address book out of customers and nations, written as files with more columns than are used.
_BOOK_SQL = "SELECT DISTINCT n_name AS city_pcs, CAST(c_custkey % 997 AS VARCHAR) || ' ' || c_mktsegment || ' ST' AS full_addr FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _book(spark, sf, coordinates=False):
    nation = read(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("city_pcs"))
    address = F.concat((F.col("c_custkey") % 997).cast("string"), F.lit(" "), F.col("c_mktsegment"), F.lit(" ST"))
    records = read(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    path = scratch_path(spark, "book")
    records.select(
        F.col("c_acctbal").alias("latitude"), (-F.col("c_acctbal")).alias("longitude"), F.lit("").alias("unit"), address.alias("full_addr"), "city_pcs", F.lit("59").alias("pruid")
    ).write.option("header", True).csv(path)
    return files.address_book(spark, path, coordinates)


@query("address_book_load", "SELECT n_name AS city_pcs, CAST(c_custkey % 997 AS VARCHAR) || ' ' || c_mktsegment || ' ST' AS full_addr FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _load(spark, sf):
    return _book(spark, sf)


_HOME = "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END"


@query(
    "location_record",
    f"""WITH book AS (SELECT *, row_number() OVER (ORDER BY {w.hashed("concat_ws('|', city_pcs, full_addr)")}, city_pcs, full_addr) - 1 AS i FROM ({_BOOK_SQL})),
    src AS (SELECT c_custkey, {_HOME} AS home_address, c_name, {w.h('customer.#loc', CKEY)} % (SELECT count(*) FROM book) AS i FROM customer)
    SELECT c_custkey, city_pcs AS city, 'BC' AS home_province, 'Canada' AS country_name, CASE WHEN home_address IS NOT NULL THEN full_addr END AS home_address,
        {w.differing(w.pool([x for x in p.STATES['Canada'] if len(x) < 30]), 'customer.state', CKEY, 'c_name')} AS state
    FROM src JOIN book USING (i)""",
)
def _record(spark, sf):
    """City, province, country and address of a row come from one record; STATE is no location word."""
    customer = read(spark, sf, "customer").selectExpr(
        "c_custkey", "c_mktsegment AS city", "c_mktsegment AS home_province", "c_mktsegment AS country_name", f"{_HOME} AS home_address", "c_name AS state"
    )
    rules = (
        R("city", "City", pattern="BC"), R("home_province", "State", pattern="Canada"), R("country_name", "Bogus", pattern="{{ADDRESS.COUNTRY}}"),
        R("home_address", "FullAddress"), R("state", "State", pattern="Canada", max="30"),
    )
    settings = replace(SETTINGS, address_book=_book(spark, sf))
    return mask_table(customer, TableRule("customer", ("c_custkey",), rules), settings)


@query(
    "location_weighted",
    "SELECT n_name AS city, count(*) AS n_records, true AS as_often, true AS one_record FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def _weighted(spark, sf):
    """Cities come as often as the book has records of them, within five standard deviations; coordinates are those of the record."""
    book = _book(spark, sf, coordinates=True)
    orders = read(spark, sf, "orders").selectExpr("o_orderkey", "o_orderstatus AS city", "o_orderstatus AS home_address", "o_totalprice AS lat", "o_totalprice AS lon")
    rules = (R("city", "City", pattern="BC"), R("home_address", "FullAddress"), R("lat", "Latitude"), R("lon", "Longitude"))
    weights = record_weights(book)
    masked = mask_table(orders, TableRule("orders", ("o_orderkey",), rules), replace(SETTINGS, address_book=book, city_weights=weights))
    known = book.select(F.col("city_pcs").alias("city"), F.col("full_addr").alias("home_address"), F.col("latitude").alias("lat"), F.lit(True).alias("known")).distinct()
    seen = masked.join(known, ["city", "home_address", "lat"], "left").groupBy("city").agg(F.count("*").alias("n"), F.bool_and(F.coalesce("known", F.lit(False)) & (F.col("lat") == -F.col("lon"))).alias("one_record"))
    total, rows = weights.agg(F.sum("weight")).scalar(), orders.agg(F.count("*")).scalar()
    share = F.col("weight") / total
    near = F.abs(F.col("n") - rows * share) <= 5 * F.sqrt(rows * share * (1 - share))
    return weights.join(seen, F.col("city_pcs") == F.col("city"), "left").select("city", F.col("weight").alias("n_records"), near.alias("as_often"), "one_record")


def _country_sql(country):
    states: dict[str, list[str]] = {}
    for name, state, place in p.PLACE_BOOK:
        if name == country:
            states.setdefault(state, []).append(place)
    names, places, n = list(states), list(states.values()), len(states)
    h = lambda k: w.h("supplier.#loc", SKEY, k)
    listed = "[" + ", ".join(w.words(x) for x in places) + "]"
    line = w.drawn(w.STREET, "supplier.#street", SKEY)
    own_line = w.drawn(w.SECOND_LINE, "supplier.address_2", SKEY)
    return f"""SELECT '{country}' AS book, s_suppkey, '{country}' AS country, state AS province, CASE WHEN ps[pos] = old_city THEN ps[pos % len(ps) + 1] ELSE ps[pos] END AS city, {line} AS address, {own_line} AS address_2
    FROM (SELECT *, CAST({h(1)} % len(ps) AS INT) + 1 AS pos FROM (SELECT *, list_extract({w.words(names)}, CAST(si AS INT) + 1) AS state, list_extract({listed}, CAST(si AS INT) + 1) AS ps FROM (
        SELECT *, CASE WHEN list_extract({w.words(names)}, CAST(s0 AS INT) + 1) = old_state THEN (s0 + 1 + {h("s")} % {n - 1}) % {n} ELSE s0 END AS si
        FROM (SELECT *, {h(0)} % {n} AS s0 FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Ontario' ELSE 'Bretagne' END AS old_state, CASE WHEN s_suppkey % 3 = 0 THEN 'Toronto' ELSE 'Rennes' END AS old_city FROM supplier)))))"""


@query("location_by_country", " UNION ALL ".join(_country_sql(c) for c in ("Canada", "France")))
def _by_country(spark, sf):
    supplier = read(spark, sf, "supplier").selectExpr(
        "s_suppkey", "s_name AS country", "CASE WHEN s_suppkey % 2 = 0 THEN 'Ontario' ELSE 'Bretagne' END AS province",
        "CASE WHEN s_suppkey % 3 = 0 THEN 'Toronto' ELSE 'Rennes' END AS city", "s_name AS address", "s_name AS address_2",
    )
    rules = [R("country", "Bogus"), R("province", "State"), R("city", "City"), R("address", "FullAddress"), R("address_2", "SecondaryAddress")]
    parts = [
        location_by_country(supplier, rules, ["s_suppkey"], "supplier", c, SETTINGS).select(F.lit(c).alias("book"), "*") for c in ("Canada", "France")
    ]
    return parts[0].unionByName(parts[1])
