"""Follow log directories as a stream of new (rolled) files.

A file source delivers each new file once, whole.  Lines appended to a file already
read are not delivered, so this follows directories into which closed files are
moved (daily or size-rolled logs), not a file being written (``tail -f``).
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stevedore.operators._paths import delete
from stevedore.operators._schemas import layout, list_files, read_layout, unescaped
from stevedore.operators.logs import with_day
from stevedore.operators.tables import FOLDERS_PER_JOB, overwrite_partitions, packing, union
from stevedore.sources.logs import parse_logs

# Rolled files keep their old modification times: no age makes a new file too old to read.
_NO_AGE_LIMIT = "36500d"


def _reader(spark: SparkSession, path: str, max_files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.format("text").option("recursiveFileLookup", "true").option("maxFileAge", _NO_AGE_LIMIT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(path)


def follow_logs(
    spark: SparkSession,
    path: str,
    *,
    window: str = "1 hour",
    watermark: str = "10 minutes",
    max_files_per_trigger: int | None = None,
    by: tuple[str, ...] = ("level",),
) -> DataFrame:
    """Streaming counts ``(window_start, window_end, *by, n)`` of the lines under ``path``.

    ``by`` names parsed columns to count by, for example ``("source", "level")`` for
    windows per file.

    Lines are parsed as ``parse_logs`` does; lines without a time (continuation lines)
    have no window and are not counted.  The watermark bounds the state: a window is
    final, and is emitted in append mode, once event time passes its end plus
    ``watermark``.
    """
    lines = _reader(spark, path, max_files_per_trigger).select("value", F.col("_metadata.file_path").alias("source"))
    # Watermarks need TIMESTAMP: the wall-clock time is read in the session time zone
    # (UTC by default) and the window bounds are turned back into wall-clock times.
    timed = parse_logs(lines).filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp"))
    return (
        timed.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window).alias("w"), *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            *by,
            "n",
        )
    )


def run_to_path(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    *,
    output_mode: str = "append",
    available_now: bool = True,
) -> StreamingQuery:
    """Run ``stream`` into Parquet at ``path`` with its state in ``checkpoint``.

    ``append``: each micro-batch is written to its own ``batch=<id>`` folder with
    overwrite, so a batch replayed after a failure replaces itself (exactly once).
    ``complete``: each micro-batch holds the whole result and replaces ``path``.
    With ``available_now`` the query processes what is there and stops; the caller
    waits on the returned query.
    """
    if output_mode not in ("append", "complete"):
        raise ValueError(f"output mode must be append or complete, got {output_mode!r}: in update mode, earlier counts would stay")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        if output_mode == "complete":
            batch.write.mode("overwrite").parquet(path)
        else:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def ingest_daily(
    spark: SparkSession,
    path: str,
    out: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Follow ``path`` and append every parsed line to Parquet at ``out`` by ``day`` and ``batch``.

    The streaming counterpart of ``write_daily``: a micro-batch holds whole files, so stack traces get
    the day of their record as in batch.  Each micro-batch is written by its tasks into partitions of its own,
    rebalanced by day (about one file for each day), with dynamic partition overwrite: a batch that is replayed replaces
    what its earlier attempt wrote, so each line lands exactly once, and the driver moves and lists no file.
    ``out`` is a plain table without a sink's log; ``compact_ingested`` joins the files of a day's batches.
    """
    lines = _reader(spark, path, max_files_per_trigger).select(
        "value", F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block")
    )
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        ordered = batch.withColumn("seq", F.monotonically_increasing_id())  # straight on the scan of the batch
        logs = with_day(parse_logs(ordered)).drop("block", "seq").withColumn("batch", F.lit(f"{name}-{batch_id:09d}"))
        overwrite_partitions(logs, out, ["day", "batch"])

    writer = lines.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write_batch)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


#: A batch's folder, or that of several batches joined: stream, first batch, last batch.
_BATCH = re.compile(r"/day=[^/]+/batch=([0-9a-f]{12})-(\d{9})(?:-(\d{9}))?$")


def compact_ingested(spark: SparkSession, out: str, *, target_bytes: int = 128 << 20) -> int:
    """Join the batches of each day of an ``ingest_daily`` table into few files; returns the number of days rewritten.

    The newest batch of each stream stays as it is, since it may yet be replayed; no earlier one can be.  Those
    of a day are rewritten, without a shuffle, into one partition named by its first and last batch, and then
    their folders go.  Should the driver be lost between the two, the next call finds folders whose batches lie within such a
    range, and removes them first; until then a reader sees their lines twice.  Not to be run twice at once.
    """
    root = out.rstrip("/")
    files = list_files(spark, [root])
    sizes = files.groupBy("folder").agg(F.sum("length").alias("bytes")).collect()
    found = [(m[1], int(m[2]), int(m[3] or m[2]), r.folder, r.bytes) for r in sizes if (m := _BATCH.search(r.folder))]
    newest = {name: max(last for other, _, last, *_ in found if other == name) for name, *_ in found}
    days: dict[tuple[str, str], list] = {}
    for name, first, last, at, size in found:
        days.setdefault((at.rpartition("/")[0], name), []).append((first, last, at, size))
    todo = []
    for (day, name), parts in sorted(days.items()):
        stale = [p for p in parts if any(q is not p and q[0] <= p[0] and p[1] <= q[1] and q[1] - q[0] > p[1] - p[0] for q in parts)]
        for p in stale:
            delete(spark, p[2])
        closed = sorted(p for p in parts if p not in stale and (p[1] < newest[name] or p[0] < p[1]))
        if len(closed) > 1:
            todo.append((f"{name}-{closed[0][0]:09d}-{max(p[1] for p in closed):09d}", closed))
    if not todo:
        return 0
    pcols = ["day", "batch"]
    how = layout(spark, root, pcols, list_files(spark, [unescaped(p[2]) for _, closed in todo for p in closed]))
    for key, value in packing(target_bytes).items():
        how.session.conf.set(key, value)  # the session of ``layout``, nobody else's
    by_folder: dict[str, list[str]] = {}
    for names, _ in how.files or []:
        for f in names:
            by_folder.setdefault(f.rpartition("/")[0], []).append(f)
    for at in range(0, len(todo), FOLDERS_PER_JOB):
        scans = []
        for label, closed in todo[at : at + FOLDERS_PER_JOB]:
            rows = read_layout(how, root, [f for p in closed for f in (by_folder[p[2]] if how.files else [p[2]])])
            scans.append(rows.coalesce(max(1, -(-sum(p[3] for p in closed) // target_bytes))).withColumn("batch", F.lit(label)))
        union(scans).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*pcols).parquet(out)
    for label, closed in todo:
        for p in closed:
            if not p[2].endswith(f"/batch={label}"):
                delete(spark, p[2])
    return len(todo)
