"""Reading dates out of text in the formats rule sheets and spreadsheets use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted formats, first to last: fixed values. Those with a dash after the year are tried day first, as "2020-03-04" is read there.
#   M/d/yyyy h:mm:ss a, M/d/yyyy h:mm a, M/d/yyyy h a, M/d/yyyy h:mm:ss, M/d/yyyy h:mm
#   M-d-yyyy h:mm:ss a, M-d-yyyy h:mm a, M-d-yyyy h a, M-d-yyyy h:mm:ss, M-d-yyyy h:mm
#   yyyy-d-M h:mm:ss a, yyyy-d-M h:mm a, yyyy-d-M h a, yyyy-d-M h:mm:ss, yyyy-d-M h:mm
#   yyyy-M-d h:mm:ss a, yyyy-M-d h:mm a, yyyy-M-d h a, yyyy-M-d h:mm:ss, yyyy-M-d h:mm
#   yyyyMMdd, yyyyMdd hh:mm
# The same by day orders, by how a text starts, and clock formats by the number of colons, without and with AM or PM: fixed values.
_SLASHED, _YEAR_LAST, _YEAR_FIRST = ["M/d/yyyy"], ["M-d-yyyy"], ["yyyy-d-M", "yyyy-M-d"]
_CLOCKS = {(2, True): "h:mm:ss a", (1, True): "h:mm a", (0, True): "h a", (2, False): "h:mm:ss", (1, False): "h:mm"}
_DIGITS_ONLY = ["yyyyMMdd", "yyyyMdd hh:mm"]

# What a text must look like to be worth trying: fixed value.
_LOOKS_LIKE_DATE = r"^(\d{1,4}[-/]\d{1,2}[-/]\d{1,4} \d{1,2}(:\d{2}){0,2}( [AaPp][Mm])?|\d{7,8}( \d{2}:\d{2})?)$"


def parse_date(text: Column, iso: bool = False) -> Column:
    """The first accepted format that fits; null when none does. With ``iso`` a text that begins with the year has the month next.

    A text that cannot match costs an exception per format inside the parser, so its shape picks the one or two
    formats that are tried at all.
    """
    colons = F.length(text) - F.length(F.replace(text, F.lit(":"), F.lit("")))
    half_days = F.lower(F.right(text, F.lit(1))) == "m"

    def tried(formats: list[str]) -> Column:
        return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])

    def by_clock(orders: list[str]) -> Column:
        chain = F
        for (count, half), clock in _CLOCKS.items():
            chain = chain.when((colons == count) & (half_days == F.lit(half)), tried([f"{o} {clock}" for o in orders]))
        return chain.otherwise(F.lit(None).cast("timestamp"))

    parsed = (
        F.when(F.contains(text, F.lit("/")), by_clock(_SLASHED))
        .when(text.rlike(r"^\d{4}-"), by_clock(_YEAR_FIRST[::-1] if iso else _YEAR_FIRST))
        .when(F.contains(text, F.lit("-")), by_clock(_YEAR_LAST))
        .otherwise(tried(_DIGITS_ONLY))
    )
    return F.when(text.rlike(_LOOKS_LIKE_DATE), parsed).cast("timestamp_ntz")


def parse_date_or(text: Column, drawn: Column) -> Column:
    """Null stays null; blank or unreadable text becomes a drawn date."""
    return F.when(text.isNotNull(), F.coalesce(parse_date(text), drawn))
