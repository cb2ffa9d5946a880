"""What to do with a column: rule types, column rules, table rules, run settings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

# Names of the rule types: fixed values, matched without regard to case.
RULE_TYPES = """
None CompanyPersonName Company NULL PostalCode StringConcat Date Shuffle Ignore Money Location NoMasking math
Shufflegeometry Unmask ShufflePolygon exception Vehicle Bogus RandomUsername FirstName LastName DateOfBirth PickRandom
RandomString2 Rant State City Lorem TimeSpan StringFormat FullAddress SecondaryAddress StreetAddress PhoneNumber
PhoneNumberInt Longitude Latitude RandomSeason FullName File Filename Blob Clob RandomDec Geometry RandomYear RandomMonth
RandomInt Randomint64 Computed Scramble MaskingOut RandomHexa Error
""".split()
_BY_LOWER = {name.lower(): name for name in RULE_TYPES}

# Words of a location column name; a name with exactly one of them takes part in the location record.
LOCATION_WORDS = ["COUNTRY", "STATES", "PROVINCE", "CITY", "ADDRESS"]


class RuleError(ValueError):
    """A rule that cannot be applied."""


def rule_type(name: str) -> str:
    """Canonical rule type name; unknown names are an error."""
    try:
        return _BY_LOWER[name.strip().lower()]
    except KeyError:
        raise RuleError(f"unknown rule type {name!r}") from None


@dataclass(frozen=True)
class ColumnRule:
    name: str
    type: str
    ignore: bool = False
    unmask: bool = False
    min: str | None = None
    max: str | None = None
    pattern: str | None = None
    use_value: str | None = None
    preview: bool = False
    operator: str | None = None
    retain_null: bool = True
    retain_empty: bool = False
    # Old and new values: a mapping, or a table of two columns.
    value_mappings: Mapping[str, str] | DataFrame = field(default_factory=dict)
    local_mapping: bool = False
    global_mapping: bool = False
    unique: bool = False
    gender_column: str | None = None
    separator: str | None = None
    source_columns: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "type", rule_type(self.type))

    def limit(self) -> int | None:
        """``max`` as a text length."""
        return int(float(self.max)) if self.max not in (None, "") else None

    def location_word(self) -> str | None:
        hits = [w for w in LOCATION_WORDS if w in self.name.upper()]
        return hits[0] if len(hits) == 1 else None


@dataclass(frozen=True)
class TableRule:
    name: str
    key: tuple[str, ...]
    columns: tuple[ColumnRule, ...]
    row_count: str | None = None
    schema: str = ""
    target_schema: str = ""


@dataclass(frozen=True)
class Settings:
    """Run settings: the secret seed, the fixed 'today', the address book or the country that location columns are filled from,
    weights of the book's cities (``city_pcs``, ``weight``; None: every record is as likely), the number of buckets that numbering spreads its work over (None: by the size of the table; it changes no value), and the folder that
    keeps the numbers given for unique values from one delivery of a table to the next."""

    seed: str = "42"
    as_of: dt.datetime = dt.datetime(2024, 1, 1)
    min_date: dt.datetime = dt.datetime(1990, 1, 1)
    address_book: DataFrame | None = None
    country: str | None = None
    city_weights: DataFrame | None = None
    buckets: int | None = None
    assignments: str | None = None
