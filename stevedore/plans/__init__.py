"""Registered cases: each runs one job over the test tables, with its DuckDB oracle."""

from stevedore.plans.cases import CASES
from stevedore.plans.oracle import ORACLE_SQL

__all__ = ["CASES", "ORACLE_SQL"]
