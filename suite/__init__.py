"""The registered queries, each next to the DuckDB SQL that must give the same rows."""

from suite import generators, growing, places, redaction, rules, scans, sheets, validation  # noqa: F401
from suite.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
