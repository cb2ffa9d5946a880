"""One generator per rule type: what a replacement value is made of.

A generator maps a ``ColumnRule`` to a ``Recipe``. Users add their own with ``register``.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import domains as d
from veilspark.functions import pools as p
from veilspark.functions import templates as t
from veilspark.functions.draw import Draws
from veilspark.plans.rules import ColumnRule, RuleError, Settings


@dataclass(frozen=True)
class RowView:
    """What a recipe may look at besides its draws."""

    draws: Draws
    old: Column
    gender: Column | None = None


@dataclass(frozen=True)
class Recipe:
    """A sampler, samplers that replace it under a condition, and a last touch on the text."""

    sampler: d.Sampler
    choices: Callable[[RowView], list[tuple[Column, d.Sampler]]] = lambda row: []
    finish: Callable[[Column, RowView], Column] = lambda value, row: value

    def value(
        self, row: RowView, same: Callable[[Column], Column], hold: Callable[[Column], Column] = lambda value: value
    ) -> Column:
        """The masked value of a row: drawn, and not the ``same`` as the original where there is a second value.

        ``hold`` may keep the first value in a projection of its own, so that it is computed once.
        """
        options = self.choices(row)

        def chosen(pick: Callable[[d.Sampler], Column]) -> Column:
            result = pick(self.sampler)
            for condition, sampler in reversed(options):
                result = F.when(condition, pick(sampler)).otherwise(result)
            return self.finish(result, row)

        first = hold(chosen(lambda sampler: sampler.value(row.draws)))
        if max(s.capacity for s in [self.sampler, *[s for _, s in options]]) < 2:
            return first
        other = chosen(lambda sampler: sampler.value(row.draws, shifted=sampler.capacity > 1))
        return F.when(same(first), other).otherwise(first)

    @property
    def kind(self) -> str:
        return self.sampler.kind


Generator = Callable[[ColumnRule, Settings], Recipe]
_GENERATORS: dict[str, Generator] = {}


def register(rule_type: str, generator: Generator | None = None):
    """Register a generator for a rule type; usable as a decorator."""
    if generator is None:
        return lambda g: register(rule_type, g)
    _GENERATORS[rule_type.lower()] = generator
    return generator


def has_generator(rule_type: str) -> bool:
    return rule_type.lower() in _GENERATORS


def recipe(rule: ColumnRule, settings: Settings) -> Recipe:
    if not has_generator(rule.type):
        raise RuleError(f"rule type {rule.type} of {rule.name} has no generator")
    try:
        return _GENERATORS[rule.type.lower()](rule, settings)
    except RuleError:
        raise
    except ValueError as error:
        raise RuleError(f"{rule.name}: {error}") from error


def _cut(rule: ColumnRule) -> Callable[[Column, RowView], Column]:
    limit = rule.limit()
    return lambda value, row: value if limit is None else F.substring(value, 1, limit)


def _plain(rule_type: str, sampler: Callable[[], d.Sampler], cut: bool) -> None:
    register(rule_type, lambda rule, settings: Recipe(sampler(), finish=_cut(rule) if cut else lambda v, r: v))


# People -----------------------------------------------------------------------------------------


def _gendered(female: d.Sampler, male: d.Sampler) -> Callable[[RowView], list[tuple[Column, d.Sampler]]]:
    def choices(row: RowView):
        if row.gender is None:
            return []
        gender = F.lower(F.trim(row.gender.cast("string")))
        return [(gender.isin("m", "male"), male), (gender.isin("f", "female"), female)]

    return choices


@register("FirstName")
def _first_name(rule, settings):
    return Recipe(t.first_name(), _gendered(d.pool(p.FEMALE_NAMES), d.pool(p.MALE_NAMES)))


@register("FullName")
def _full_name(rule, settings):
    by_gender = [d.concat(d.pool(names), " ", t.last_name()) for names in (p.FEMALE_NAMES, p.MALE_NAMES)]
    return Recipe(t.full_name(), _gendered(*by_gender))


_plain("LastName", t.last_name, cut=False)
_plain("RandomUsername", t.user_name, cut=True)


@register("CompanyPersonName")
def _company_person(rule, settings):
    return Recipe(
        t.full_name(), lambda row: [(row.draws("c") % F.lit(2) == 0, t.company_name())], _cut(rule)
    )


@register("Company")
def _company(rule, settings):
    return Recipe(t.template(rule.pattern or "{{COMPANY.COMPANYNAME}} {{COMPANY.COMPANYSUFFIX}}"), finish=_cut(rule))


# Dates ------------------------------------------------------------------------------------------


def _moment(text: str | None, default: dt.datetime) -> dt.datetime:
    return dt.datetime.fromisoformat(text) if text else default


@register("DateOfBirth")
def _date_of_birth(rule, settings):
    low, high = _moment(rule.min, settings.min_date), _moment(rule.max, settings.as_of)
    return Recipe(d.seconds(low, high))


def _date_pattern(pattern: str) -> str:
    return pattern.replace("tt", "a")


@register("Date")
@register("TimeSpan")
def _date_text(rule, settings):
    """Text by pattern over the default range, in steps as fine as the pattern shows."""
    if not rule.pattern:
        raise RuleError(f"{rule.type} on {rule.name} needs a pattern")
    pattern = _date_pattern(rule.pattern)
    has_day, has_time = bool(re.search("[yMd]", pattern)), bool(re.search("[Hhms]", pattern))
    midnight = settings.min_date
    if has_day and not has_time:
        moments = d.days(settings.min_date, settings.as_of)
    elif has_day:
        moments = d.seconds(settings.min_date, settings.as_of)
    else:
        moments = d.seconds(midnight, midnight + dt.timedelta(seconds=86399))
        if "s" not in pattern:
            (seconds,) = moments.parts
            moments = d.one(d.Domain(1440, lambda i: seconds.render(i * 60), seconds.kind))
    return Recipe(d.formatted(moments, pattern))


def _year_bound(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"\d{4}", text) else default


@register("RandomYear")
def _year(rule, settings):
    low, high = _year_bound(rule.min, settings.min_date.year), _year_bound(rule.max, settings.as_of.year)
    return Recipe(d.mapped(d.integers(low, high), lambda v: F.lpad(v.cast("string"), 4, "0")))


@register("RandomMonth")
def _month(rule, settings):
    if "string" in (rule.pattern or ""):
        return Recipe(d.pool(p.MONTHS))
    return Recipe(d.mapped(d.integers(1, 12), lambda v: F.lpad(v.cast("string"), 2, "0")))


@register("RandomSeason")
def _season(rule, settings):
    years = d.integers(settings.min_date.year, settings.as_of.year)
    season = lambda y: F.concat(y.cast("string"), F.lit("/"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    return Recipe(d.mapped(years, season))


# Numbers ----------------------------------------------------------------------------------------


def _whole(text: str | None) -> int:
    return int(float(text)) if text not in (None, "") else 0


@register("RandomInt")
def _int(rule, settings):
    return Recipe(d.integers(_whole(rule.min), _whole(rule.max), "int"))


@register("Randomint64")
def _int64(rule, settings):
    return Recipe(d.integers(int(rule.min or 0), int(rule.max or 0), "bigint"))


@register("RandomDec")
def _decimal(rule, settings):
    low, high = rule.min or "0", rule.max or "0"
    wide = max(abs(Decimal(low)), abs(Decimal(high))) >= 10**12
    return Recipe(d.decimals(low, high, 6, "decimal(38,6)" if wide else "decimal(18,6)"))


@register("Money")
def _money(rule, settings):
    return Recipe(d.decimals("0", "1000", 2, "decimal(18,2)"))


@register("Longitude")
def _longitude(rule, settings):
    return Recipe(d.decimals("-180", "180", 4, "decimal(9,4)"))


@register("Latitude")
def _latitude(rule, settings):
    return Recipe(d.decimals("-90", "90", 4, "decimal(9,4)"))


# Patterns ---------------------------------------------------------------------------------------


@register("RandomHexa")
def _hex(rule, settings):
    return Recipe(d.concat("0x", d.characters(p.HEX_DIGITS, int(rule.pattern))))


@register("RandomString2")
def _string2(rule, settings):
    alphabet = "".join(dict.fromkeys(rule.pattern or p.LETTERS_LOWER))
    return Recipe(d.characters(alphabet, rule.limit() or 0))


@register("PickRandom")
def _pick(rule, settings):
    if not rule.pattern:
        raise RuleError(f"PickRandom on {rule.name} needs a list")
    return Recipe(d.pool(rule.pattern.split(",")))


@register("StringFormat")
def _string_format(rule, settings):
    return Recipe(t.symbols(rule.pattern or ""))


@register("StringConcat")
@register("PhoneNumber")
def _phone(rule, settings):
    return Recipe(t.symbols(rule.pattern or "##########"), finish=_cut(rule))


@register("PhoneNumberInt")
def _phone_int(rule, settings):
    pattern = rule.pattern or "##########"
    if not re.fullmatch(r"[#\d]{1,15}", pattern):
        raise RuleError(f"PhoneNumberInt on {rule.name} needs a pattern of at most 15 digits")
    return Recipe(d.mapped(t.symbols(pattern), lambda v: v.cast("bigint"), "bigint"))


@register("PostalCode")
def _postal_code(rule, settings):
    return Recipe(t.symbols("?#?#?#"))


@register("Bogus")
def _bogus(rule, settings):
    if not rule.pattern:
        raise RuleError(f"Bogus on {rule.name} needs a pattern")
    return Recipe(t.template(rule.pattern), finish=_cut(rule))


# Text -------------------------------------------------------------------------------------------


@register("Lorem")
def _lorem(rule, settings):
    return Recipe(t.filler(3, "\n", rule.limit()), finish=_cut(rule))


@register("Rant")
def _rant(rule, settings):
    """Paragraphs of three sentences; ``min`` tells how many."""
    paragraphs = max(1, _whole(rule.min))
    limit = rule.limit()
    if limit is not None:
        paragraphs = max(1, min(paragraphs, -(-limit // 100)))
    pieces: list[str | d.Sampler] = [t.filler(3, " ", limit)]
    for _ in range(paragraphs - 1):
        pieces += ["\n\n", t.filler(3)]
    return Recipe(d.concat(*pieces), finish=_cut(rule))


@register("Clob")
def _clob(rule, settings):
    return Recipe(t.filler(4), finish=lambda v, row: F.translate(F.base64(F.encode(v, "UTF-16LE")), "\r\n", ""))


# Things and places ------------------------------------------------------------------------------

VEHICLE_KINDS = {
    "manufacturer": lambda: d.pool(p.VEHICLE_MAKERS),
    "model": lambda: d.pool(p.VEHICLE_MODELS),
    "type": lambda: d.pool(p.VEHICLE_TYPES),
    "vin": lambda: d.characters(p.VIN_ALPHABET, 17),
    "fuel": lambda: d.pool(p.VEHICLE_FUELS),
}


@register("Vehicle")
def _vehicle(rule, settings):
    kind = (rule.pattern or "").lower()
    if kind not in VEHICLE_KINDS:
        raise RuleError(f"Vehicle on {rule.name}: unknown kind {rule.pattern!r}")
    return Recipe(VEHICLE_KINDS[kind](), finish=_cut(rule))


_plain("FullAddress", t.full_address, cut=True)
_plain("StreetAddress", t.street_address, cut=True)
_plain("SecondaryAddress", t.secondary_address, cut=True)


def _shorter(names: list[str], rule: ColumnRule) -> list[str]:
    limit = rule.limit()
    return [n for n in names if limit is None or len(n) < limit]


@register("State")
def _state(rule, settings):
    by_lower = {c.lower(): names for c, names in p.STATES.items()}
    if (rule.pattern or "").lower() not in by_lower:
        raise RuleError(f"State on {rule.name}: unknown country {rule.pattern!r}")
    names = _shorter(by_lower[rule.pattern.lower()], rule)
    if not names:
        raise RuleError(f"State on {rule.name}: no name is shorter than {rule.max}")
    return Recipe(d.pool(names))


@register("City")
def _city(rule, settings):
    if rule.pattern not in p.PLACES:
        raise RuleError(f"City on {rule.name}: unknown province {rule.pattern!r}")
    return Recipe(d.pool(_shorter(p.PLACES[rule.pattern], rule) or ["VIC"]))


def _tail(rule: ColumnRule) -> Callable[[Column], Column]:
    """File names keep their last characters, so that the extension stays."""
    limit = rule.limit()
    return lambda value: value if limit is None else F.right(value, F.lit(limit))


def extension(name: Column) -> Column:
    """What follows the last dot."""
    return F.element_at(F.split(name, r"\."), -1)


@register("File")
def _file(rule, settings):
    tail = _tail(rule)

    def finish(value: Column, row: RowView) -> Column:
        named = F.concat(value, F.lit("."), extension(row.old))
        return tail(F.when(F.contains(row.old, F.lit(".")), named).otherwise(value))

    return Recipe(t.file_stem(), finish=finish)


@register("Filename")
def _filename(rule, settings):
    return Recipe(t.file_stem(), finish=lambda v, row: _tail(rule)(v))


@register("exception")
def _long_name(rule, settings):
    return Recipe(t.file_stem())
