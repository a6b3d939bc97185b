"""The three log line layouts: writing them and parsing them back.

Layouts (fixed values):

* bracket:        ``[yyyy-MM-dd HH:mm:ss] [LEVEL] message``
* Log4j, thread:  ``%d{yyyy-MM-dd HH:mm:ss.SSS} %-5p [%t] %c{1} - %m%n``
* Log4j, line no: ``%d{yyyy-MM-dd HH:mm:ss.SSS} %-5p %c{1}:%L - %m%n``

Parsing is one regular-expression pass per line: a single anchored alternation whose
replacement string lays every captured field out in a fixed order, split afterwards.
Groups of the layouts that did not match are empty, so ``$1$4$9`` is "the timestamp of
whichever layout matched".  A line that matches none is left unchanged by the replace
and keeps NULL fields (stack-trace continuation lines, for example).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}"
_BRACKET = rf"\[({_DATE})\] \[([A-Za-z]+)\] (.*)"  # groups 1-3
_LOG4J_THREAD = rf"({_DATE}\.\d{{3}}) ([A-Za-z]+) +\[(.*?)\] (\S+) - (.*)"  # groups 4-8; a thread's name may hold brackets
_LOG4J_LINE = rf"({_DATE}\.\d{{3}}) ([A-Za-z]+) +(\S+?):(\d+) - (.*)"  # groups 9-13
LINE_PATTERN = rf"(?s)^(?:{_BRACKET}|{_LOG4J_THREAD}|{_LOG4J_LINE})$"

_MARK = "\u0002"  # starts every rewritten (matched) line
_SEP = "\u0001"  # separates the fields of a rewritten line
_ESC = "\u0003"  # stands before the code of a separator (or of itself) that a line holds
_LAYOUT = _SEP.join([_MARK, "$1$4$9", "$2$5$10", "$6", "$7$11", "$12", "$3$8$13"])

# Parsed shape, after the caller's ``source`` column.
LOG_FIELDS = ["ts", "level", "thread", "logger", "line_no", "message"]


def split_log_line(line: Column) -> Column:
    """The one regex pass: an array ``[mark, ts, level, thread, logger, line_no, message]``
    for a matched line, ``[line]`` otherwise.  Select it as its own column and read
    the fields from that column (``log_fields``): Catalyst then keeps the expensive
    expression in one place instead of copying it into every field.
    """
    escaped = F.replace(F.replace(line, F.lit(_ESC), F.lit(_ESC + "a")), F.lit(_SEP), F.lit(_ESC + "b"))
    plain = F.when(line.contains(_SEP) | line.contains(_ESC), escaped).otherwise(line)
    return F.split(F.regexp_replace(plain, LINE_PATTERN, _LAYOUT), _SEP, -1)


def _unescaped(field: Column) -> Column:
    back = F.replace(F.replace(field, F.lit(_ESC + "b"), F.lit(_SEP)), F.lit(_ESC + "a"), F.lit(_ESC))
    return F.when(field.contains(_ESC), back).otherwise(field)


def log_fields(parts: Column, line: Column) -> list[Column]:
    """The parsed fields (named as ``LOG_FIELDS``) read from ``split_log_line``'s array.

    ``ts`` is TIMESTAMP_NTZ: the wall-clock time as written, with no zone attached.
    A line that matches no layout gets NULL in every field.
    """
    matched = (F.size(parts) == 7) & (F.try_element_at(parts, F.lit(1)) == F.lit(_MARK)) & ~line.startswith(_MARK)

    def field(i: int) -> Column:
        return F.when(matched, F.nullif(_unescaped(F.try_element_at(parts, F.lit(i + 1))), F.lit("")))

    return [
        field(1).try_cast("timestamp_ntz").alias("ts"),
        F.upper(field(2)).alias("level"),
        field(3).alias("thread"),
        field(4).alias("logger"),
        field(5).try_cast("int").alias("line_no"),
        F.when(matched, _unescaped(F.try_element_at(parts, F.lit(7)))).alias("message"),
    ]


def format_bracket(ts: Column, level: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("] ["), level, F.lit("] "), message)


def _pad5(level: Column) -> Column:
    """``%-5p``: left-justified in at least 5 characters (``rpad`` alone would cut longer names)."""
    return F.when(F.length(level) < 5, F.rpad(level, 5, " ")).otherwise(level)


def format_log4j_thread(ts: Column, level: Column, thread: Column, logger: Column, message: Column) -> Column:
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), _pad5(level),
        F.lit(" ["), thread, F.lit("] "), logger, F.lit(" - "), message,
    )


def format_log4j_line(ts: Column, level: Column, logger: Column, line_no: Column, message: Column) -> Column:
    return F.concat(
        F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), _pad5(level),
        F.lit(" "), logger, F.lit(":"), line_no.cast("string"), F.lit(" - "), message,
    )
