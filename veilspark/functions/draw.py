"""Keyed draws: repeatable, stateless numbers that stand in for a random generator.

A draw is the first 60 bits of an md5 over ``seed|scope|key|k``. It depends on nothing but its
inputs, so a masked value is the same after a retry, on another cluster, in another partition
layout, and in any SQL engine that has md5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DRAW_BITS = 60


def key_text(*columns: Column) -> Column:
    """Text form of a (composite) key; nulls count as empty."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in columns]
    return parts[0] if len(parts) == 1 else F.concat_ws("|", *parts)


def value_key(value: Column, dtype: str) -> Column:
    """Text form of a value; binary floats go through a decimal so that the text is engine neutral."""
    text = value.cast("string")
    if dtype in ("double", "float"):
        text = F.coalesce(value.try_cast("decimal(38,6)").cast("string"), text)
    return F.coalesce(text, F.lit(""))


class Draws:
    """The family of draws of one (scope, key): ``draws(k)`` is the k-th number in [0, 2^60)."""

    def __init__(self, seed: str, scope: str, key: Column):
        self._prefix = F.lit(f"{seed}|{scope}|")
        self._key = key

    def digest(self, k: int | str = 0) -> Column:
        """The 32 hex digits behind draw k."""
        return F.md5(F.concat(self._prefix, self._key, F.lit(f"|{k}")))

    def digest_of(self, block: Column) -> Column:
        """``digest("p0")``, ``digest("p1")``, ... for a block number of the row."""
        return F.md5(F.concat(self._prefix, self._key, F.lit("|p"), block.cast("string")))

    def part(self, k: int, size: int, render: Callable[[Column], Column]) -> Column:
        """The value that draw k picks out of ``size`` values."""
        return render(self(k) % F.lit(size))

    def __call__(self, k: int | str = 0) -> Column:
        return F.conv(F.substring(self.digest(k), 1, DRAW_BITS // 4), 16, 10).cast("bigint")


def div(number: Column, divisor: int) -> Column:
    """Integer division that stays in bigint."""
    return F.call_function("div", number, F.lit(divisor))
