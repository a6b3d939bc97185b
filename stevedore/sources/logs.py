"""Text log files -> parsed log rows."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.functions.layouts import LOG_FIELDS, log_fields, split_log_line
from stevedore.session import scratch_path

PARSED_COLUMNS = ["source", *LOG_FIELDS, "raw"]
#: Where a line stands in its file: the start of its split, and its number (ascending in the split).
PLACE_COLUMNS = ["block", "seq"]


def placed(scan: DataFrame) -> DataFrame:
    """``(value, source, block, seq)`` of a text scan.  Both place columns are taken on the scan itself, so
    ``(block, seq)`` is the order of lines in a file, however many tasks read it."""
    return scan.select(
        "value",
        F.col("_metadata.file_path").alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def read_log_lines(spark: SparkSession, path: str, *, recursive: bool = True) -> DataFrame:
    """Lines ``(value, source, block, seq)`` of every text file under ``path``; ``source`` is the file,
    ``(block, seq)`` the line's place in it.

    Plain text is split by ``spark.sql.files.maxPartitionBytes``, so one large file is
    read by many tasks (compressed files are read whole, one task each).
    """
    return placed(spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path))


def parse_logs(lines: DataFrame, *, value: str = "value", source: str = "source") -> DataFrame:
    """``(source, ts, level, thread, logger, line_no, message, raw)`` for each line, and its place if known.

    A pure projection: no shuffle, runs inside whole-stage codegen.  Lines that match
    no layout are kept, with NULL parsed fields and the text in ``raw``.
    """
    place = [c for c in PLACE_COLUMNS if c in lines.columns]
    split = lines.select(
        F.col(source).alias("source"), F.col(value).alias("raw"), split_log_line(F.col(value)).alias("_parts"), *place
    )
    # The fields come out of a one-row generator: Catalyst does not push a filter on a
    # generated column below the generator, so a later filter on, say, ``level`` is
    # applied to the parsed value instead of re-running the regex inside the filter.
    # The cost is one regex pass per line, always: a generator is not pruned even when
    # no parsed field is used (jobs needing only ``raw`` can take the lines unparsed).
    fields = F.inline(F.array(F.struct(*log_fields(F.col("_parts"), F.col("raw")))))
    return split.select("source", fields, "raw", *place)


#: Splits whose last records may be broadcast: about 100 bytes each.
_BROADCAST_SPLITS = 200_000


@F.arrow_udf(T.StructType([T.StructField("ts", T.TimestampNTZType()), T.StructField("level", T.StringType())]))
def _carry(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """The last record at or above each line in its split. Lines come split by split, in order, over any number of batches."""
    last_split, last = None, (None, None)
    for split, ts, level in batches:
        n, of = len(split), split.to_numpy(zero_copy_only=False)
        places = np.arange(n)
        fresh = np.concatenate(([last_split is None or of[0] != last_split], of[1:] != of[:-1])) if n else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(fresh, places, -1))  # -1: the split began in an earlier batch
        found = np.maximum.accumulate(np.where(ts.is_valid().to_numpy(zero_copy_only=False), places, -1))
        own = found >= np.maximum(start, 0)
        at = pa.array(np.where(own, found, n), pa.int64(), mask=~own & (start >= 0))  # place n: what the last batch ended with
        columns = [pa.concat_arrays([c, pa.array([x], c.type)]).take(at) for c, x in zip((ts, level), last, strict=True)]
        yield pa.StructArray.from_arrays(columns, ["ts", "level"])
        if n:
            last_split, last = of[-1], (columns[0][-1].as_py(), columns[1][-1].as_py())


def _split_records(logs: DataFrame) -> DataFrame:
    """(source, block, handed, first): per split the last record above it in its file, and the time of the file's first record."""
    timed = F.when(F.col("ts").isNotNull(), F.col("seq"))
    ends = logs.groupBy("source", "block").agg(
        F.max_by(F.when(F.col("ts").isNotNull(), F.struct("ts", "level")), timed).alias("end"), F.min_by("ts", timed).alias("begin")
    )
    path = scratch_path(logs.sparkSession, "splits")
    ends.write.parquet(path)
    stored = logs.sparkSession.read.schema(ends.schema).parquet(path)
    file = Window.partitionBy("source").orderBy("block")
    above, all_of_it = (file.rowsBetween(Window.unboundedPreceding, end) for end in (-1, Window.unboundedFollowing))
    return stored.select(
        "source", "block", F.last("end", ignorenulls=True).over(above).alias("handed"), F.first("begin", ignorenulls=True).over(all_of_it).alias("first")
    )


def attach_records(logs: DataFrame, *, moved: bool = False, first: str | None = None) -> DataFrame:
    """Add ``record_ts`` and ``record_level``: a continuation line (stack trace) has those of the record above it.

    Lines above a file's first record have none; neither have files without a record. ``first`` names a column to add
    for the time of the file's first record, in lines that have no record.

    No line is moved. One pass gives the last record of each split, a row for each split, from which each split learns what the
    splits before it hand on. A second pass carries records down within the tasks of the scan itself, where lines
    still lie in order (only their times and levels go through Python, in Arrow batches). So the lines must come straight from
    ``read_log_lines`` through projections and filters: lines that have left their task raise an error. ``moved=True`` is for those: it
    shuffles them by split and carries with a window.
    """
    if missing := [c for c in PLACE_COLUMNS if c not in logs.columns]:
        raise ValueError(f"attach_records needs the place columns of read_log_lines, {missing} are missing")
    record = F.when(F.col("ts").isNotNull(), F.struct("ts", "level"))
    if moved:
        upto = Window.partitionBy("source", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        within = logs.withColumn("_own", F.last(record, ignorenulls=True).over(upto))
    else:
        # The upper bits of ``seq`` are the task that read the line.
        astray = F.raise_error(F.lit("attach_records: lines have left the task that read them; pass moved=True"))
        here = F.when(F.shiftright("seq", 33) == F.spark_partition_id(), F.xxhash64("source", "block")).otherwise(astray.cast("long"))
        within = logs.withColumn("_split", here).withColumn("_own", _carry("_split", "ts", "level"))
    splits = _split_records(logs).select(F.col("source").alias("_source"), F.col("block").alias("_block"), "handed", F.col("first").alias("_first"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block"))
    owner = F.when(F.col("_own.ts").isNotNull(), F.col("_own")).otherwise(F.col("handed"))
    added = [owner["ts"].alias("record_ts"), owner["level"].alias("record_level"), *([F.when(owner.isNull(), F.col("_first")).alias(first)] if first else [])]
    if splits.count() <= _BROADCAST_SPLITS:
        return within.join(F.broadcast(splits), same, "left").select(*logs.columns, *added)
    # Too many splits to broadcast: only lines that their own split gives no record meet them, in a shuffle.
    known = F.col("_own.ts").isNotNull()
    nothing = [F.lit(None).cast(splits.schema[c].dataType).alias(c) for c in ("handed", "_first")]
    settled = within.filter(known).select("*", *nothing).select(*logs.columns, *added)
    return settled.unionByName(within.filter(~known).join(splits, same, "left").select(*logs.columns, *added))
