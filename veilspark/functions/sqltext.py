"""SQL text of names and constants. Wide expressions are built as text: one call per row of cells instead of one
call per cell and operator keeps the driver quick for tables with many columns."""

from __future__ import annotations


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def texts(values) -> str:
    """An array constant."""
    return "array(" + ", ".join(text(v) for v in values) + ")"


def constant(value) -> str:
    """A Python value as text that casts back to it."""
    if value is None:
        return "NULL"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{bytes(value).hex()}'"
    return text(repr(value) if isinstance(value, float) else str(value))
