"""Jobs over parsed log rows ``(source, ts, level, thread, logger, line_no, message, raw)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stevedore.functions.levels import SEVERITY_RANK, severity_rank
from stevedore.operators._paths import exists
from stevedore.operators.tables import overwrite_partitions
from stevedore.session import scratch_path
from stevedore.sources.logs import PLACE_COLUMNS, attach_records

# The words that mark a line as an error, matched in any case.
ERROR_PATTERN = "error|exception|failed"


def filter_severity(logs: DataFrame, min_level: str = "INFO") -> tuple[DataFrame, DataFrame]:
    """``(kept, unranked)``: lines at or above ``min_level``, and lines with no known level.

    Lines whose level is NULL (unparsed) or outside TRACE < DEBUG < INFO < WARN < ERROR < FATAL are
    returned in ``unranked`` rather than dropped.
    """
    level = min_level.upper()
    if level not in SEVERITY_RANK:
        raise ValueError(f"min_level must be one of {list(SEVERITY_RANK)}, got {min_level!r}")
    rank = severity_rank(F.col("level"))
    return logs.filter(rank >= F.lit(SEVERITY_RANK[level])), logs.filter(rank.isNull())


def _matches(pattern: str):
    return F.col("raw").rlike(f"(?i){pattern}")


def error_tail(logs: DataFrame, n: int = 10, pattern: str = ERROR_PATTERN) -> DataFrame:
    """The last ``n`` lines per source whose text matches ``pattern`` (any case).

    "Last" is by place in the file where the lines carry it (``read_log_lines``), so a stack
    trace stays with its error; else by time, newest first, then by text, lines without a time
    after timed ones.  ``recency`` is 1 for the last line.
    A ``row_number() <= n`` filter is planned as a partial WindowGroupLimit before the
    shuffle, so each map task sends at most ``n`` rows per source, however hot.
    """
    if n < 1:
        raise ValueError("n must be positive")
    placed = all(c in logs.columns for c in PLACE_COLUMNS)
    last = [F.desc(c) for c in PLACE_COLUMNS] if placed else [F.col("ts").desc_nulls_last(), F.col("raw").desc()]
    order = Window.partitionBy("source").orderBy(*last)
    return (
        logs.filter(_matches(pattern))
        .withColumn("recency", F.row_number().over(order))
        .filter(F.col("recency") <= n)
    )


def error_verdict(logs: DataFrame, pattern: str = ERROR_PATTERN) -> DataFrame:
    """``(source, n_lines, n_errors, has_errors)`` for every source, including error-free ones.

    Needs only ``source`` and ``raw``: unparsed lines (``value`` renamed ``raw``) are
    enough, and skip the parse entirely.
    """
    hit = _matches(pattern)
    return (
        logs.groupBy("source")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(hit).alias("n_errors"))
        .withColumn("has_errors", F.col("n_errors") > 0)
    )


def with_day(logs: DataFrame, *, moved: bool = False) -> DataFrame:
    """Add ``day``, unless it is there: that of the record a line belongs to, where lines carry their
    place; lines above a file's first record have that record's day.  Without places, the line's own day.

    Places are used where the lines lie (``attach_records``); ``moved=True`` for lines that have left the task that read them.
    """
    if "day" in logs.columns:
        return logs
    if not all(c in logs.columns for c in PLACE_COLUMNS):
        return logs.withColumn("day", F.to_date("ts"))
    owned = attach_records(logs, moved=moved, first="_first_ts")
    return owned.select(*logs.columns, F.to_date(F.coalesce("record_ts", "_first_ts")).alias("day"))


def write_daily(logs: DataFrame, path: str, *, moved: bool = False) -> None:
    """Write logs under ``path/day=yyyy-MM-dd/``; a re-run replaces only the days it holds.

    The rebalance by day is the only shuffle of lines.  With the lines' places (``read_log_lines``), stack traces go with their records.  Lines of files that
    hold no time at all go to the ``day=__HIVE_DEFAULT_PARTITION__`` folder (NULL day), where a write
    replaces those of its own sources and keeps the others'.
    """
    spark = logs.sparkSession
    dated = with_day(logs, moved=moved)
    undated = f"{path.rstrip('/')}/day=__HIVE_DEFAULT_PARTITION__"
    if exists(spark, undated):
        earlier = spark.read.schema(dated.drop("day").schema).parquet(undated)
        sources = dated.select(F.col("source").alias("_s")).distinct()
        others = earlier.join(sources, F.col("source").eqNullSafe(F.col("_s")), "left_anti")
        staged = scratch_path(spark, "undated")
        others.write.parquet(staged)  # the folder is replaced below: nothing may still read it then
        kept = spark.read.schema(others.schema).parquet(staged).withColumn("day", F.lit(None).cast("date"))
        dated = dated.unionByName(kept)
    overwrite_partitions(dated, path, ["day"])


def keep_newest_days(logs: DataFrame, n: int = 30, *, moved: bool = False) -> DataFrame:
    """Lines of the newest ``n`` days that have any line (days, not calendar span).

    The day list (at most ``n`` values) is computed first and applied as a literal
    ``IN`` filter: on a day-partitioned table (``write_daily``'s layout) that is a
    partition filter, so only the kept days' folders are read.  Finding the
    days reads only the ``day`` column (partition values: no data pages).  Stack traces have the day of their
    record.  Lines that belong to no day can't be told to be old: they are kept.
    """
    if n < 1:
        raise ValueError("n must be positive")
    dated = with_day(logs, moved=moved)
    days = [
        r[0]
        for r in dated.select("day").where(F.col("day").isNotNull()).distinct().orderBy(F.desc("day")).limit(n).collect()
    ]
    return dated.filter(F.col("day").isin(days) | F.col("day").isNull())
