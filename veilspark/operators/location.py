"""Location columns of a row filled from one address record, so that the row stays coherent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions import pools as p
from veilspark.functions import templates as t
from veilspark.functions.alias import STEPS, alias_table
from veilspark.functions.draw import Draws, key_text
from veilspark.operators.numbering import number_rows, position_by_key
from veilspark.plans.rules import ColumnRule, RuleError, Settings
from veilspark.sources.scratch import materialise, pick, sized_for_join

# Constant parts of an address-book record: fixed values.
BOOK_COUNTRY, BOOK_STATE = "Canada", "BC"


# Entries of the alias table of a weighted book: cities, or groups of them where there are more.
MAX_ENTRIES = 1 << 16
COORDINATES = ("latitude", "longitude")


def _records(book: DataFrame) -> DataFrame:
    """The distinct addresses of a book, each with the coordinates of one record of it if the book has any."""
    held = [c for c in COORDINATES if c in book.columns]
    if not held:
        return book.select("city_pcs", "full_addr").distinct()
    return book.groupBy("city_pcs", "full_addr").agg(F.min(F.struct(*held)).alias("__c")).select("city_pcs", "full_addr", *[F.col(f"__c.{c}").alias(c) for c in held])


def numbered_book(book: DataFrame, buckets: int | None = None) -> DataFrame:
    """An address book ``(city_pcs, full_addr)`` with a dense number."""
    text = key_text(F.col("city_pcs"), F.col("full_addr"))
    return number_rows(_records(book), text, [F.col("city_pcs"), F.col("full_addr")], "__book", buckets)


def record_weights(book: DataFrame) -> DataFrame:
    """``(city_pcs, weight)``: how many records of the book each city has."""
    return book.groupBy("city_pcs").agg(F.count("*").alias("weight"))


def _drawn_by_weight(df: DataFrame, records: DataFrame, weights: DataFrame, draws: Draws) -> DataFrame:
    """The rows with ``__book``, the number of a record whose city comes as often as its weight says.

    Records are numbered city by city, so a city is a first number and a count. An alias table over the cities (or over groups of them, of
    which a row then picks by the running weight) is all that rows look up; within the city every record is as likely. A row's chance
    costs the same whatever the weights, and no city is a key of a shuffle.
    """
    cities = records.groupBy("city_pcs").agg(F.min("__book").alias("first"), F.count("*").alias("many"))
    cities = cities.join(weights.select("city_pcs", F.col("weight").cast("long").alias("weight")), "city_pcs").where("weight > 0")
    count = cities.count()
    groups = min(count, MAX_ENTRIES)
    group = F.pmod(F.xxhash64("city_pcs"), F.lit(MAX_ENTRIES)) if count > MAX_ENTRIES else F.xxhash64("city_pcs")
    listed = F.array_sort(F.collect_list(F.struct("city_pcs", "first", "many", "weight")))
    grouped = materialise(cities.groupBy(group.alias("group")).agg(F.sum("weight").alias("weight"), listed.alias("cities")), "cities")
    # One number for each entry, at most MAX_ENTRIES.
    entries = sorted((r["group"], r["weight"]) for r in grouped.select("group", "weight").collect())
    if not entries:
        raise RuleError("no city of the address book has a weight above 0")
    cuts, others = alias_table([w for _, w in entries])
    spark = df.sparkSession
    table = spark.createDataFrame([(i, g, cuts[i], entries[others[i]][0]) for i, (g, _) in enumerate(entries)], "__i long, __own long, __cut long, __other long")
    drawn = df.withColumn("__i", draws("city") % F.lit(len(entries))).join(F.broadcast(table), "__i")
    drawn = drawn.withColumn("__group", F.when(draws("cut") % F.lit(STEPS) < F.col("__cut"), F.col("__own")).otherwise(F.col("__other"))).drop("__i", "__own", "__cut", "__other")
    grouped, _, small = sized_for_join(grouped.select(F.col("group").alias("__group"), F.col("weight").alias("__weight"), F.col("cities").alias("__cities")))
    drawn = pick(drawn, grouped, "__group", groups, small, draws("salt"))
    # The city at a place in the running weights of its group.
    place = draws("within") % F.col("__weight")
    at = lambda acc, c: F.when(acc["left"] < 0, acc).otherwise(F.struct((acc["left"] - c["weight"]).alias("left"), c["first"].alias("first"), c["many"].alias("many")))
    start = F.struct(place.alias("left"), F.lit(0).cast("long").alias("first"), F.lit(1).cast("long").alias("many"))
    drawn = drawn.withColumn("__city", F.aggregate("__cities", start, at))
    return drawn.withColumn("__book", F.col("__city.first") + draws(0) % F.col("__city.many")).drop("__group", "__weight", "__cities", "__city")


def location_record(
    df: DataFrame, rules: Sequence[ColumnRule], key: Sequence[str], table: str, settings: Settings
) -> DataFrame:
    """Fill the location columns among ``rules`` from one drawn record of the address book per row: every record as likely, or, where the
    settings weigh the cities, each city as often as its weight. Latitude and longitude are the record's, if the book has them."""
    draws = Draws(settings.seed, f"{table}.#loc", key_text(*[F.col(k) for k in key]))
    if settings.city_weights is None:
        book, size, small = sized_for_join(materialise(numbered_book(settings.address_book, settings.buckets), "address-book"))
        if size == 0:
            return df
        drawn = df.withColumn("__book", draws(0) % F.lit(size))
    else:
        records = materialise(position_by_key(_records(settings.address_book), ["city_pcs", "full_addr"], "__book"), "address-book")
        book, size, small = sized_for_join(records)
        if size == 0:
            return df
        drawn = _drawn_by_weight(df, records, settings.city_weights, draws)
    joined = pick(drawn, book, "__book", size, small, draws(1))
    cell = {
        "COUNTRY": F.lit(BOOK_COUNTRY),
        "STATES": F.lit(BOOK_STATE),
        "PROVINCE": F.lit(BOOK_STATE),
        "CITY": F.col("city_pcs"),
        "ADDRESS": F.col("full_addr"),
    }
    masked = {}
    for rule in rules:
        value = F.col(rule.type.lower()).cast(df.schema[rule.name].dataType) if rule.type.lower() in COORDINATES else cell[rule.location_word()]
        masked[rule.name] = F.when(F.col(rule.name).isNotNull(), value) if rule.retain_null else value
    return joined.select(*[masked[n].alias(n) if n in masked else F.col(n) for n in df.columns])


def _book_of(country: str) -> tuple[list[str], list[list[str]]]:
    states: dict[str, list[str]] = {}
    for name, state, place in p.PLACE_BOOK:
        if name.lower() == country.lower():
            states.setdefault(state, []).append(place)
    if not states:
        raise RuleError(f"no place book for country {country!r}")
    return list(states), list(states.values())


def location_by_country(
    df: DataFrame, rules: Sequence[ColumnRule], key: Sequence[str], table: str, country: str, settings: Settings
) -> DataFrame:
    """Fill location columns from country, state and place of a small fixed book; state and place differ from the
    original. Address columns get a street line, or a secondary line for the second and third line of a street."""
    states, places = _book_of(country)
    draws = Draws(settings.seed, f"{table}.#loc", key_text(*[F.col(k) for k in key]))
    state_array = F.array(*[F.lit(s) for s in states])
    place_array = F.array(*[F.array(*[F.lit(x) for x in ps]) for ps in places])
    old = {r.location_word(): F.col(r.name) for r in rules}
    old_state = old.get("STATES", old.get("PROVINCE", F.lit(None).cast("string")))
    old_city = old.get("CITY", F.lit(None).cast("string"))

    n = len(states)
    staged = df.withColumn("__s0", draws(0) % F.lit(n)).withColumn("__p0", draws(1))
    first = F.get(state_array, F.col("__s0").cast("int"))
    shifted = (F.col("__s0") + 1 + draws("s") % F.lit(n - 1)) % F.lit(n)
    staged = staged.withColumn("__s", F.when(first.eqNullSafe(old_state), shifted).otherwise(F.col("__s0")).cast("int"))
    staged = staged.withColumn("__places", F.get(place_array, F.col("__s")))
    at = (F.col("__p0") % F.size("__places")).cast("int")
    place = F.get(F.col("__places"), at)
    other = F.get(F.col("__places"), (at + 1) % F.size("__places"))
    staged = staged.withColumn("__city", F.when(place.eqNullSafe(old_city), other).otherwise(place))

    line_draws = Draws(settings.seed, f"{table}.#street", key_text(*[F.col(k) for k in key]))
    state = F.get(state_array, F.col("__s"))
    cell = {
        "COUNTRY": F.lit(country),
        "STATES": state,
        "PROVINCE": state,
        "CITY": F.col("__city"),
        "ADDRESS": _address_line(rules, df.columns, line_draws, state),
    }
    masked: dict[str, Column] = {}
    for rule in rules:
        value = cell[rule.location_word()]
        if rule.type in _OWN_LINE:
            value = _OWN_LINE[rule.type]().value(Draws(settings.seed, f"{table}.{rule.name}", key_text(*[F.col(k) for k in key])))
        masked[rule.name] = F.when(F.col(rule.name).isNotNull(), value) if rule.retain_null else value
    return staged.select(*[masked[n].alias(n) if n in masked else F.col(n) for n in df.columns])


# Rule types that keep their own generator in this variant.
_OWN_LINE = {"StreetAddress": t.street_address, "SecondaryAddress": t.secondary_address}


def _address_line(rules: Sequence[ColumnRule], columns: Sequence[str], draws: Draws, state: Column) -> Column:
    """The address of the record. The first location column and the other columns of the table decide its form."""
    name, all_names = rules[0].name.upper(), " ".join(columns).upper()
    street = t.street_address().value(draws)
    if "ADDRESS" in name:
        later_line = "STREET" in name and ("2" in name or "3" in name)
        return t.secondary_address().value(draws) if later_line else street
    if "CITY" in all_names and ("STATE" in all_names or "PROVINCE" in all_names):
        return street
    return F.concat(street, F.lit(" "), F.col("__city"), F.lit(", "), state)
