"""The exception log: values that could not be masked, counted per column and reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilspark.functions import sqltext
from veilspark.functions.generators import has_generator
from veilspark.functions.redact import is_blank, is_numeric
from veilspark.operators.stacking import stack_rows
from veilspark.operators.validate import UNIQUE_SHUFFLE_FAILED
from veilspark.plans.mask import mask_table
from veilspark.plans.rules import ColumnRule, Settings, TableRule

_WITHOUT_GENERATOR = {"None", "NULL", "Location", "Error"}


def _reasons(rule: ColumnRule, kind: T.DataType) -> list[tuple[str, Column]]:
    """(reason, condition over the masked column and ``__old_<name>``) of one rule."""
    new, old = F.col(rule.name), F.col(f"__old_{rule.name}")
    present = old.isNotNull()
    text = old.cast("string")
    if rule.retain_empty and isinstance(kind, T.StringType):
        present = present & ~is_blank(old)
    if rule.type in _WITHOUT_GENERATOR:
        return [("no generator", present)]
    if rule.type == "MaskingOut":
        size = (rule.limit() or 0) * (2 if "middle" in (rule.pattern or "").lower() else 1)
        return [("too short to mask", present & (F.length(text) <= size))]
    if rule.type == "Scramble":
        return [("too short to scramble", present & (F.length(text) <= 1))]
    if rule.type == "math":
        return [("not numeric", ~is_numeric(text))]
    if rule.type in ("Shuffle", "ShufflePolygon"):
        return [(UNIQUE_SHUFFLE_FAILED, present & new.eqNullSafe(old))]
    if has_generator(rule.type) and rule.type != "exception":
        kept = F.lit(bool(rule.use_value)) | new.isNotNull()
        return [("no different value", present & new.cast("string").eqNullSafe(text)), ("value does not fit the column type", present & ~kept)]
    return []


def mask_exceptions(df: DataFrame, rule: TableRule, settings: Settings = Settings()) -> DataFrame:
    """``(table_name, column_name, reason, n)``: one pass, originals kept beside the masked values.

    A rule that cannot be applied is logged for all rows of its column; the other columns go on.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    checks = [
        (r.name, reason, condition)
        for r in rule.columns
        if not r.ignore and r.name in kinds
        for reason, condition in _reasons(r, kinds[r.name])
    ]
    checked = list(dict.fromkeys(name for name, _, _ in checks))
    failures: dict[str, str] = {}
    masked = mask_table(df.select("*", *[F.col(n).alias(f"__old_{n}") for n in checked]), rule, settings, failures=failures)
    checks = [(n, reason, c) for n, reason, c in checks if n not in failures]
    checks += [(n, f"rule not applied: {reason}", F.lit(True)) for n, reason in failures.items()]
    counts = masked.agg(
        *[F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).alias(f"__n{i}") for i, (_, _, c) in enumerate(checks)]
    )
    rows = [[sqltext.text(rule.name), sqltext.text(n), sqltext.text(reason), f"__n{i}"] for i, (n, reason, _) in enumerate(checks)]
    return stack_rows(counts, rows, ["table_name", "column_name", "reason", "n"]).where("n > 0")


def dry_run(df: DataFrame, rule: TableRule, settings: Settings = Settings()) -> DataFrame:
    """``(table_name, column_name, changed_rows)``: what a run would change, with nothing written."""
    names = [r.name for r in rule.columns if not r.ignore and r.name in df.columns]
    masked = mask_table(df.select("*", *[F.col(n).alias(f"__old_{n}") for n in names]), rule, settings)
    counts = masked.agg(
        *[
            F.coalesce(F.sum(F.when(~F.col(n).eqNullSafe(F.col(f"__old_{n}")), 1).otherwise(0)), F.lit(0)).alias(f"__n{i}")
            for i, n in enumerate(names)
        ]
    )
    rows = [[sqltext.text(rule.name), sqltext.text(n), f"__n{i}"] for i, n in enumerate(names)]
    return stack_rows(counts, rows, ["table_name", "column_name", "changed_rows"])
