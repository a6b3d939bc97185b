"""Inputs the cases derive from the test tables with Spark.

Log lines are formatted from ``events`` in all three layouts, so they grow with it.
The same rules are written in SQL in ``oracle.py``; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stevedore.functions.layouts import format_bracket, format_log4j_line, format_log4j_thread

# Fixed values of the fixture: level per event type, the logger name, and the dates
# the table cases split on.
EVENT_LEVEL = {"error": "ERROR", "click": "WARN", "signup": "DEBUG", "view": "INFO", "purchase": "INFO"}
LOGGER = "EventLog"
SPLIT_DATE = "1998-01-01 00:00:00"
MERGE_TARGET_END = "1999-01-01 00:00:00"
RECONCILE_ACTUAL_FROM = "1996-01-01 00:00:00"
RECONCILE_EXPECTED_TO = "2000-01-01 00:00:00"
AS_OF = "2024-01-15 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


#: Rows of a task that writes a fixture's small files: its sort by partition value stays within about 150 MB.
ROWS_PER_TASK = 1 << 20


def dealt(df: DataFrame, least: int, rows: int, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``df``, of at most ``rows`` rows, dealt evenly over ``least`` tasks, or over more where one would get more than ``per_task``.

    Rows are dealt by a running number: ``repartition(n)`` alone would sort all that a task has read first.
    """
    numbered = df.withColumn("_dealt", F.monotonically_increasing_id())
    return numbered.repartition(max(least, -(-rows // per_task)), "_dealt").drop("_dealt")


def rolled_files(events: int, span: int) -> int:
    """How many of a log's line numbers (``span`` in all) go into a rolled file: 256 events make one, in up to 256 files;
    beyond, files grow to 2**18 events. Even, so that a file ends between a record and its trace."""
    files = max(1, min(-(-events // 256), 256), -(-events // (1 << 18)))
    return 2 * max(1, -(-span // (2 * files)))


def event_level() -> F.Column:
    level = None
    for event_type, name in EVENT_LEVEL.items():
        level = (F.when if level is None else level.when)(F.col("event_type") == event_type, F.lit(name))
    return level.otherwise(F.lit("UNKNOWN"))


def event_log_lines(events: DataFrame) -> DataFrame:
    """``(value, source, ts_event, block, seq)``: one line per event, plus a stack-trace line per error, in
    the order of ``event_id`` (one block for each source).

    Layout by ``event_id``: 0 bracket, 1 Log4j with thread, 2 Log4j with line number.
    """
    level = event_level()
    message = F.concat_ws(
        " ", F.col("event_type"), F.lit("event"), F.col("event_id").cast("string"), F.lit("props"), F.col("props")
    )
    thread = F.concat(F.lit("session-"), F.col("user_id").cast("string"))
    line_no = (F.pmod(F.col("event_id"), F.lit(997)) + 1).cast("int")
    layout = F.pmod(F.col("event_id"), F.lit(3))
    line = (
        F.when(layout == 0, format_bracket(F.col("ts"), level, message))
        .when(layout == 1, format_log4j_thread(F.col("ts"), level, thread, F.lit(LOGGER), message))
        .otherwise(format_log4j_line(F.col("ts"), level, F.lit(LOGGER), line_no, message))
    )
    trace = F.concat(F.lit("java.lang.IllegalStateException: event "), F.col("event_id").cast("string"), F.lit(" failed"))
    # The formatted line is its own column first, so the explode below refers to it
    # instead of carrying a copy of the formatting into each branch.
    formatted = events.select(
        line.alias("line"),
        F.when(F.col("event_type") == "error", trace).alias("trace"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.col("ts").alias("ts_event"),
        "event_id",
    )
    lines = F.when(F.col("trace").isNotNull(), F.array("line", "trace")).otherwise(F.array("line"))
    each = formatted.select(F.posexplode(lines).alias("nth", "value"), "source", "ts_event", "event_id")
    return each.select("value", "source", "ts_event", F.lit(0).cast("long").alias("block"), (2 * F.col("event_id") + F.col("nth")).alias("seq"))
