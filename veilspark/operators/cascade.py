"""Ordered rule cascades as data: the first step whose condition holds sets the outcome columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    condition: Column
    outcome: Mapping[str, Column | str | bool]


def decide(df: DataFrame, steps: Sequence[Step], defaults: Mapping[str, Column | str | bool]) -> DataFrame:
    """Add or replace the outcome columns.

    One chain finds the number of the first step that holds; the outcomes are looked up by that number. Every
    condition is evaluated, and compiled, once.
    """
    chain = F
    for number, step in enumerate(steps):
        chain = chain.when(step.condition, F.lit(number))
    numbered = df.withColumn("__step", chain.otherwise(F.lit(len(steps))))
    outcomes = [step.outcome for step in steps] + [{}]
    columns = {}
    for name, default in defaults.items():
        chosen = [o.get(name, default) for o in outcomes]
        constants = F.array(*[F.lit(None if isinstance(v, Column) else v) for v in chosen])
        computed: dict[int, tuple[Column, list[int]]] = {}
        for number, value in enumerate(chosen):
            if isinstance(value, Column):
                computed.setdefault(id(value), (value, []))[1].append(number)
        value = F.get(constants, F.col("__step"))
        for expression, numbers in computed.values():
            value = F.when(F.col("__step").isin(*numbers), expression).otherwise(value)
        columns[name] = value
    return numbered.withColumns(columns).drop("__step")


def has(text: Column, *words: str) -> Column:
    """Contains any of the words."""
    return _any([F.contains(text, F.lit(w)) for w in words])


def ends(text: Column, *words: str) -> Column:
    return _any([F.endswith(text, F.lit(w)) for w in words])


def _any(conditions: Sequence[Column]) -> Column:
    result = conditions[0]
    for condition in conditions[1:]:
        result = result | condition
    return result


def choose(subject: Column, options: Mapping[str, str], default: Column | str = "") -> Column:
    """The option that belongs to the value of a text column."""
    chain = F
    for value, result in options.items():
        chain = chain.when(subject == value, F.lit(result))
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))
