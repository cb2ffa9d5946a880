"""Value domains: numbered sets of replacement values.

A ``Domain`` maps 0..size-1 one-to-one to values. Because every generator is a domain, three things
need writing only once: draw a value, draw another one where the first equals the original (shift the
number), and give each row its own value (number the rows).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilspark.functions import sqltext
from veilspark.functions.draw import Draws, div

# Draws have 60 bits; a packed domain stays well below, so that the remainder is close to uniform.
PACK_LIMIT = 10**15


# Domains up to this size are drawn with one draw; sizes near 2^60 would not be reached evenly.
DRAW_LIMIT = 1 << 56


def _decimal(number: Column) -> Column:
    return number.cast("decimal(19,0)")


@dataclass(frozen=True)
class Domain:
    """``size`` values; ``render`` turns a number below size into its value."""

    size: int
    render: Callable[[Column], Column]
    kind: str = "string"


@dataclass(frozen=True)
class Sampler:
    """A value made of independently drawn parts; text parts are concatenated."""

    parts: tuple[Domain, ...]

    @property
    def kind(self) -> str:
        return self.parts[0].kind if len(self.parts) == 1 else "string"

    @property
    def _lead(self) -> int:
        """The part that is numbered for differing and unique values: the largest one."""
        return max(range(len(self.parts)), key=lambda j: self.parts[j].size)

    @property
    def capacity(self) -> int:
        return self.parts[self._lead].size

    def _with_lead(self, number: Column, draws: Draws) -> Column:
        """The value whose leading part has the given number; the other parts are drawn."""
        values = [
            p.render(number) if j == self._lead else draws.part(j, p.size, p.render) for j, p in enumerate(self.parts)
        ]
        return values[0] if len(values) == 1 else F.concat(*values)

    def value(self, draws: Draws, shifted: bool = False) -> Column:
        """A drawn value; ``shifted`` gives another one for the same draws."""
        size = self.capacity
        if size > DRAW_LIMIT:
            return self._with_lead(self._wide(draws, shifted), draws)
        number = draws(self._lead) % F.lit(size)
        if shifted:
            number = (number + 1 + draws("s") % F.lit(size - 1)) % F.lit(size)
        return self._with_lead(number, draws)

    def _wide(self, draws: Draws, shifted: bool) -> Column:
        """A number below a size that one draw does not reach: two draws together, as decimals."""
        wide = lambda a, b: _decimal(draws(a)) * _decimal(F.lit(DRAW_LIMIT)) + _decimal(draws(b))
        size = F.lit(Decimal(self.capacity)).cast("decimal(38,0)")
        number = (wide(self._lead, "w") % size).cast("decimal(38,0)")
        if shifted:
            step = (wide("s", "t") % (size - 1).cast("decimal(38,0)")).cast("decimal(38,0)")
            number = ((number + 1 + step) % size).cast("decimal(38,0)")
        return number

    def numbered(self, number: Column, draws: Draws) -> Column:
        """The value with the given number."""
        return self._with_lead(number, draws)


def one(domain: Domain) -> Sampler:
    return Sampler((domain,))


def literal(text: str) -> Sampler:
    return one(Domain(1, lambda _: F.lit(text)))


def pool(words: Sequence[str]) -> Sampler:
    """One word of a list."""
    words = list(dict.fromkeys(words))
    array = F.expr(sqltext.texts(words))
    return one(Domain(len(words), lambda i: F.get(array, i.cast("int"))))


def digits(n: int) -> Sampler:
    """n decimal digits with leading zeros."""
    return one(Domain(10**n, lambda i: F.lpad(i.cast("string"), n, "0")))


def characters(alphabet: str, n: int) -> Sampler:
    """n characters, each drawn from an alphabet."""
    base, runs = len(alphabet), []
    longest = 1
    while longest < n and 1 < base <= _CONV_BASE and base ** (longest + 1) <= PACK_LIMIT:
        longest += 1
    while n > 0:
        runs.append(_run(alphabet, min(n, longest)))
        n -= longest
    return concat(*runs)


# Digits of the number system conversion; a longer alphabet is drawn character by character.
_CONV_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CONV_BASE = len(_CONV_DIGITS)


def _run(alphabet: str, n: int) -> Sampler:
    """n characters as the digits of one number; short code for long runs."""
    base = len(alphabet)
    if n == 1:
        letters = F.lit(alphabet)
        return one(Domain(base, lambda i: F.substring(letters, i.cast("int") + 1, F.lit(1))))

    def render(i: Column) -> Column:
        figures = F.lpad(F.conv(i.cast("string"), 10, base), n, "0")
        return figures if alphabet == _CONV_DIGITS[:base] else F.translate(figures, _CONV_DIGITS[:base], alphabet)

    return one(Domain(base**n, render))


def integers(low: int, high: int, kind: str = "bigint") -> Sampler:
    """Whole numbers low..high."""
    low, high = min(low, high), max(low, high)
    start = F.lit(low) if abs(low) < 1 << 63 and high - low < DRAW_LIMIT else F.lit(Decimal(low)).cast("decimal(38,0)")
    return one(Domain(high - low + 1, lambda i: (start + i).cast(kind), kind))


def decimals(low: str, high: str, scale: int, kind: str) -> Sampler:
    """Decimals low..high in steps of 10^-scale."""
    unit = Decimal(10) ** -scale
    first, last = int(Decimal(low) / unit), int(Decimal(high) / unit)
    first, last = min(first, last), max(first, last)
    step, start = F.lit(unit), F.lit(Decimal(first)).cast("decimal(27,0)")
    return one(Domain(last - first + 1, lambda i: ((start + i.cast("decimal(27,0)")).cast("decimal(27,0)") * step).cast(kind), kind))


def seconds(low: dt.datetime, high: dt.datetime) -> Sampler:
    """Timestamps low..high in steps of one second."""
    first, last = (int(t.replace(tzinfo=dt.timezone.utc).timestamp()) for t in (low, high))
    first, last = min(first, last), max(first, last)
    return one(Domain(last - first + 1, lambda i: _timestamp(F.lit(first) + i), "timestamp_ntz"))


def days(low: dt.datetime, high: dt.datetime) -> Sampler:
    """Midnights low..high."""
    first, last = (int(t.replace(tzinfo=dt.timezone.utc).timestamp()) // 86400 for t in (low, high))
    first, last = min(first, last), max(first, last)
    return one(Domain(last - first + 1, lambda i: _timestamp((F.lit(first) + i) * 86400), "timestamp_ntz"))


def _timestamp(epoch: Column) -> Column:
    return F.lit(dt.datetime(1970, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=epoch.cast("decimal(18,6)"))


def formatted(sampler: Sampler, pattern: str) -> Sampler:
    """Timestamps as text."""
    (domain,) = sampler.parts
    return one(Domain(domain.size, lambda i: F.date_format(domain.render(i), pattern)))


def mapped(sampler: Sampler, change: Callable[[Column], Column], kind: str = "string") -> Sampler:
    """The same domain, every value passed through a one-to-one expression."""
    (domain,) = sampler.parts
    return one(Domain(domain.size, lambda i: change(domain.render(i)), kind))


def concat(*pieces: str | Sampler) -> Sampler:
    """Text pieces next to each other, packed so that few draws pay for many pieces."""
    flat: list[Domain] = []
    for piece in pieces:
        flat.extend((literal(piece) if isinstance(piece, str) else piece).parts)
    groups: list[list[Domain]] = [[]]
    size = 1
    for domain in flat:
        if size * domain.size > PACK_LIMIT and groups[-1]:
            groups.append([])
            size = 1
        groups[-1].append(domain)
        size *= domain.size
    return Sampler(tuple(_pack(g) for g in groups if g))


def _pack(group: list[Domain]) -> Domain:
    if len(group) == 1:
        return group[0]
    size = 1
    for domain in group:
        size *= domain.size

    def render(number: Column) -> Column:
        values, below = [], 1
        for domain in group:
            rest = div(number, below) if below > 1 else number
            values.append(domain.render(rest % F.lit(domain.size)))
            below *= domain.size
        return F.concat(*values)

    return Domain(size, render)
