"""Log severity order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The severity names and their order, lowest first.
SEVERITY_RANK = {"TRACE": 0, "DEBUG": 1, "INFO": 2, "WARN": 3, "ERROR": 4, "FATAL": 5}


def severity_rank(level: Column | str) -> Column:
    """Rank of a level name (case-insensitive); NULL for names outside ``SEVERITY_RANK``."""
    level = F.upper(F.col(level) if isinstance(level, str) else level)
    rank = None
    for name, value in SEVERITY_RANK.items():
        rank = (F.when if rank is None else rank.when)(level == F.lit(name), F.lit(value))
    return rank
