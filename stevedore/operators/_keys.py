"""Key handling shared by the keyed jobs (merge, fold, snapshot, reconcile).

A NULL key never matches anything, yet a hash shuffle sends every NULL-key row to the
same task.  ``spread_column`` adds one extra grouping / join key that is 0 for rows
with complete keys and a row hash otherwise: complete keys group and join exactly as
before, and NULL-key rows scatter over all tasks and stay distinct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPREAD = "__spread"


def any_key_null(keys: Sequence[str]) -> Column:
    cond = F.lit(False)
    for k in keys:
        cond = cond | F.col(k).isNull()
    return cond


def _hashable(dt: T.DataType) -> bool:
    """xxhash64 rejects maps (and variants), also when nested."""
    text = dt.simpleString()
    return "map<" not in text and "variant" not in text


def spread_column(df: DataFrame, keys: Sequence[str], side: int = 0) -> Column:
    """0 for complete keys, otherwise a deterministic row hash (tagged by ``side``)."""
    cols = [F.col(f.name) for f in df.schema.fields if _hashable(f.dataType)]
    row_hash = F.xxhash64(F.lit(side), *cols)
    # Never 0 for NULL-key rows, so they cannot collide with the complete-key group.
    return F.when(any_key_null(keys), F.when(row_hash == 0, F.lit(1)).otherwise(row_hash)).otherwise(F.lit(0)).cast(
        "long"
    )


def check_keys(df: DataFrame, keys: Sequence[str], what: str) -> None:
    missing = [k for k in keys if k not in df.columns]
    if not keys:
        raise ValueError(f"{what}: at least one key column is required")
    if missing:
        raise ValueError(f"{what}: key columns {missing} not in {df.columns}")
