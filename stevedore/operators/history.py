"""Change history: read a table as of a time, and trim history it no longer needs."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stevedore.operators._keys import SPREAD, check_keys, spread_column
from stevedore.operators._paths import delete, reject_sink_log, subfolders
from stevedore.operators._schemas import read_evolved


def latest_per_key(history: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order_cols`` for each key (``order_cols`` must be a total order).

    ``max_by`` is aggregated partially on every map task before the shuffle, so a hot
    key costs one row per task in the exchange, not all of its rows.
    """
    cols = history.columns
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(*[F.col(c) for c in order_cols])
    return (
        history.withColumn(SPREAD, spread_column(history, keys))
        .groupBy(*keys, SPREAD)
        .agg(F.max_by(row, rank).alias("__last"))
        .select(*[F.col(f"__last.{c}").alias(c) for c in cols])
    )


def _time_literal(df: DataFrame, time_col: str, value) -> Column:
    """``value`` as a literal of ``time_col``'s type, so the filter reaches the scan."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = value.isoformat()
    return F.lit(value).cast(df.schema[time_col].dataType)


def snapshot_as_of(
    history: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    as_of,
    *,
    deleted: Column | str | None = None,
    time_col: str | None = None,
    day_col: str | None = None,
) -> DataFrame:
    """The table as it was at ``as_of``: per key, the newest change at or before it.

    ``time_col`` (default: the first of ``order_cols``) is compared with ``as_of``; a
    version number works the same way as a time.  When the newest change is a
    tombstone (``deleted`` true), the key is absent.  The time filter is a literal,
    so Parquet skips row groups outside it; ``day_col`` names a date partition column
    derived from the time (``write_daily``'s ``day``), whose matching filter then skips
    the partitions after ``as_of`` without listing them.
    """
    keys, order_cols = list(keys), list(order_cols)
    check_keys(history, keys, "snapshot_as_of")
    time_col = time_col or order_cols[0]
    cut = _time_literal(history, time_col, as_of)
    visible = history.filter(F.col(time_col) <= cut)
    if day_col:
        visible = visible.filter(F.col(day_col) <= F.to_date(cut))
    latest = latest_per_key(visible, keys, order_cols)
    if deleted is not None:
        gone = F.expr(deleted) if isinstance(deleted, str) else deleted
        latest = latest.filter(~F.coalesce(gone, F.lit(False)))
    return latest


def retention_cutoff(history: DataFrame, time_col: str, hours: float, now=None) -> Column:
    """``now - hours`` as a literal of ``time_col``'s type; ``now`` defaults to the newest time.

    The default costs one aggregate job over the time column, returning one value.
    """
    if now is None:
        span = F.expr(f"make_dt_interval(0, 0, 0, {float(hours) * 3600.0})")
        text = history.agg(
            F.date_format(F.max(time_col) - span, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("c")
        ).first()["c"]
        if text is None:
            return F.lit(None).cast(history.schema[time_col].dataType)
        return F.lit(text).cast(history.schema[time_col].dataType)
    if isinstance(now, str):
        now = dt.datetime.fromisoformat(now)
    return _time_literal(history, time_col, now - dt.timedelta(hours=hours))


def retain_history(
    history: DataFrame,
    keys: Sequence[str],
    order_cols: Sequence[str],
    *,
    hours: float = 168,
    now=None,
    time_col: str | None = None,
    day_col: str | None = None,
) -> DataFrame:
    """Trim history older than ``hours`` before ``now`` (default: the newest change).

    Keeps every change inside the period plus, per key, the newest change before it,
    so ``snapshot_as_of`` answers identically for every ``as_of`` from the cutoff on.
    With ``day_col`` (a date partition column derived from the time), the recent part
    reads only the partitions from the cutoff's day on.
    """
    keys, order_cols = list(keys), list(order_cols)
    check_keys(history, keys, "retain_history")
    time_col = time_col or order_cols[0]
    cutoff = retention_cutoff(history, time_col, hours, now)
    recent = history.filter(F.col(time_col) >= cutoff)
    if day_col:
        recent = recent.filter(F.col(day_col) >= F.to_date(cutoff))
    # A change with no time sorts first, so it counts as old; it is never dropped unseen.
    older = latest_per_key(history.filter((F.col(time_col) < cutoff) | F.col(time_col).isNull()), keys, order_cols)
    return recent.unionByName(older)


#: The day under which the newest changes from before the kept days are stored: earlier than any real one.
BASELINE_DAY = "0001-01-01"


def _days(spark: SparkSession, root: str, day_col: str) -> list[str]:
    """The days that have a folder, in order (one name each, as in any listing); not the folder of NULL days."""
    names = [unquote(n.partition("=")[2]) for n in subfolders(spark, root) if n.startswith(f"{day_col}=")]
    return sorted(n for n in names if re.fullmatch(r"\d{4}-\d\d-\d\d", n))


def retain_in_place(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    order_cols: Sequence[str],
    *,
    day_col: str = "day",
    hours: float = 168,
    now=None,
    time_col: str | None = None,
) -> list[str]:
    """Trim, in place, a history stored by day (``day_col`` is the date of ``time_col``); returns the days dropped.

    Days that end before the cutoff (``retention_cutoff``; without ``now`` the newest day is read for it) are folded: per key,
    the newest change of theirs goes to the one partition BASELINE_DAY, and the folded days are dropped by name.  So
    ``snapshot_as_of`` answers as before for every ``as_of`` from the cutoff on, with ``day_col`` too.  The next run reads the
    baseline and the days that have become old since: each old day is opened once, kept days and NULL days never.

    The baseline is replaced when all its tasks have finished, and only then are folders deleted.  A run that is cut off in
    between leaves changes in both places: answers are the same, and the next run folds them again.  Files may differ
    in schema (``read_evolved``).  Rows lose nothing but their place: the baseline's rows have their own time, not their own day.
    """
    keys, order_cols, root = list(keys), list(order_cols), path.rstrip("/")
    time_col = time_col or order_cols[0]
    reject_sink_log(spark, root, "retain_in_place")
    days = _days(spark, root, day_col)
    real = [d for d in days if d != BASELINE_DAY]
    day = None
    for last in reversed(real):  # the newest day; an older one only where it has no row with a time
        newest = read_evolved(spark, root, [day_col], folders=[f"{day_col}={last}"])
        check_keys(newest, keys, "retain_in_place")
        cutoff = newest.select(F.date_format(retention_cutoff(newest, time_col, hours, now), "yyyy-MM-dd").alias("day"))
        day = cutoff.agg(F.max("day").alias("day")).first()["day"]
        if day is not None:
            break
    old = [d for d in real if day is not None and d < day]
    if not old:
        return []
    folded = [*([BASELINE_DAY] if BASELINE_DAY in days else []), *old]
    rows = read_evolved(spark, root, [day_col], folders=[f"{day_col}={d}" for d in folded])
    latest = latest_per_key(rows, keys, order_cols).withColumn(day_col, F.lit(BASELINE_DAY))
    writer = latest.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day_col).parquet(root)
    for d in old:
        delete(spark, f"{root}/{day_col}={d}")
    return old
