"""Unique masked values: number the rows, spread the numbers with a bijection, render them."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.functions.draw import Draws, key_text
from veilspark.functions.generators import RowView, recipe
from veilspark.functions.redact import is_blank
from veilspark.operators.assignment import AssignmentLog
from veilspark.operators.numbering import bucket_count, number_rows
from veilspark.plans.rules import ColumnRule, RuleError, Settings


def bijection(size: int, seed: str, scope: str) -> tuple[int, int]:
    """Factor and offset of ``(a*i + b) mod size``, one-to-one on 0..size-1 and within 63 bits."""
    digest = int(hashlib.md5(f"{seed}|{scope}|bijection".encode()).hexdigest(), 16)
    ceiling = max(1, min(size - 1, 2**62 // max(size, 1)))
    factor = digest % ceiling + 1
    while math.gcd(factor, size) != 1:
        factor -= 1
    return factor, (digest >> 64) % size


def spread(number: Column, size: int, seed: str, scope: str) -> Column:
    factor, offset = bijection(size, seed, scope)
    return (number % F.lit(size) * F.lit(factor) + F.lit(offset)) % F.lit(size)


# Rule types whose text is a pattern of fixed width: a pattern cut short gives the text cut short.
_PATTERNS = {"StringFormat", "StringConcat", "PhoneNumber"}
# Rule types whose bounds are values, not a length.
_RANGES = {"RandomInt", "Randomint64", "RandomDec", "DateOfBirth", "RandomYear"}


def _uncut(rule: ColumnRule) -> ColumnRule:
    """The rule with a generator whose values need no cutting, since cut values could repeat."""
    if rule.type in _RANGES or rule.limit() is None:
        return rule
    if rule.type in _PATTERNS:
        return replace(rule, pattern=(rule.pattern or "##########")[: rule.limit()], max=None)
    raise RuleError(f"{rule.name}: unique values of rule type {rule.type} cannot be cut to {rule.max} characters")


def mask_unique(df: DataFrame, rule: ColumnRule, key: Sequence[str], scope: str, settings: Settings) -> DataFrame:
    """Replace a column by values of the rule's generator, no value twice.

    A table with more rows than the generator has values is an error before anything is written. Retained nulls and blanks are exempt
    from masking, not from the count. Where the settings name a folder of assignments, numbers once given to keys are kept there, so the
    values of one delivery of a table stand in the next, and none of them comes twice.
    """
    made = recipe(_uncut(rule), settings)
    size, old = made.sampler.capacity, F.col(rule.name)
    text = key_text(*[F.col(k) for k in key])
    draws = Draws(settings.seed, scope, text)
    if settings.assignments:
        numbered = AssignmentLog(df.sparkSession, f"{settings.assignments.rstrip('/')}/{scope}").numbered(df, key, "__n", size, settings.buckets)
    else:
        rows = df.count()
        if rows > size:
            raise RuleError(f"{rule.name}: {rows} rows need unique values, {rule.type} has {size}")
        numbered = number_rows(df, text, [F.col(k) for k in key], "__n", settings.buckets or bucket_count(rows))
    value = made.sampler.numbered(spread(F.col("__n"), size, settings.seed, scope), draws)
    value = made.finish(value, RowView(draws, old))
    masked = value
    if rule.retain_empty and df.schema[rule.name].dataType.simpleString() == "string":
        masked = F.when(is_blank(old), old).otherwise(masked)
    if rule.retain_null:
        masked = F.when(old.isNotNull(), masked)
    return numbered.select(*[masked.alias(n) if n == rule.name else F.col(n) for n in df.columns])
