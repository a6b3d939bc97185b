"""R7: following a log directory, against the same counts in batch."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from stevedore.sources import parse_logs, read_log_lines
from stevedore.streaming import follow_logs, run_to_path


def _write(root: str, name: str, lines: list[str]) -> None:
    path = os.path.join(root.removeprefix("file:"), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


DAY1 = [
    "[2024-03-01 10:00:00] [INFO] a",
    "[2024-03-01 10:30:00] [ERROR] b failed",
    "java.lang.RuntimeException: no time",
    "2024-03-01 11:15:00.000 INFO  [main] X - c",
]
DAY2 = ["[2024-03-02 08:00:00] [WARN] d", "2024-03-02 08:59:59.999 WARN Y:1 - e"]


def test_complete_mode_matches_batch(spark, scratch):
    logs = f"{scratch}/in"
    _write(logs, "day=2024-03-01/hive.log", DAY1)
    _write(logs, "day=2024-03-02/hive.log", DAY2)
    out = f"{scratch}/out"
    query = run_to_path(follow_logs(spark, logs), out, f"{scratch}/ckpt", output_mode="complete")
    query.awaitTermination()
    streamed = spark.read.parquet(out)
    batch = (
        parse_logs(read_log_lines(spark, logs))
        .filter("ts IS NOT NULL")
        .groupBy(F.date_trunc("hour", "ts").alias("window_start"), "level")
        .count()
    )
    got = sorted((str(r.window_start), r.level, r.n) for r in streamed.collect())
    exp = sorted((str(r.window_start), r.level, r["count"]) for r in batch.collect())
    assert got == exp and sum(g[2] for g in got) == 5


def test_new_files_are_picked_up_by_a_restarted_query(spark, scratch):
    logs, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    _write(logs, "day=2024-03-01/hive.log", DAY1)
    run_to_path(follow_logs(spark, logs), out, ckpt, output_mode="complete").awaitTermination()
    _write(logs, "day=2024-03-02/hive.log", DAY2)
    run_to_path(follow_logs(spark, logs), out, ckpt, output_mode="complete").awaitTermination()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 5


def test_append_mode_emits_closed_windows_only(spark, scratch):
    logs, out = f"{scratch}/in", f"{scratch}/out"
    _write(logs, "day=2024-03-01/hive.log", DAY1)
    _write(logs, "day=2024-03-02/hive.log", DAY2)
    stream = follow_logs(spark, logs, window="1 hour", watermark="0 seconds", max_files_per_trigger=1)
    run_to_path(stream, out, f"{scratch}/ckpt", output_mode="append").awaitTermination()
    got = sorted((str(r.window_start), r.level, r.n) for r in spark.read.parquet(out).collect())
    # The 08:00 window on day 2 is still open when the input ends, so it is not emitted.
    assert got == [
        ("2024-03-01 10:00:00", "ERROR", 1),
        ("2024-03-01 10:00:00", "INFO", 1),
        ("2024-03-01 11:00:00", "INFO", 1),
    ]


def test_windows_per_source(spark, scratch):
    logs, out = f"{scratch}/in", f"{scratch}/out"
    _write(logs, "host-a/hive.log", DAY1)
    _write(logs, "host-b/hive.log", DAY2)
    stream = follow_logs(spark, logs, by=("source", "level"))
    run_to_path(stream, out, f"{scratch}/ckpt", output_mode="complete").awaitTermination()
    got = {(r.source.rsplit("/", 2)[-2], str(r.window_start), r.level): r.n for r in spark.read.parquet(out).collect()}
    assert got == {
        ("host-a", "2024-03-01 10:00:00", "INFO"): 1,
        ("host-a", "2024-03-01 10:00:00", "ERROR"): 1,
        ("host-a", "2024-03-01 11:00:00", "INFO"): 1,
        ("host-b", "2024-03-02 08:00:00", "WARN"): 2,
    }


def test_ingest_daily_matches_batch_and_is_exactly_once(spark, scratch):
    from stevedore.operators import write_daily
    from stevedore.streaming import ingest_daily

    logs, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    _write(logs, "day=2024-03-01/hive.log", DAY1)
    ingest_daily(spark, logs, out, ckpt).awaitTermination()
    _write(logs, "day=2024-03-02/hive.log", DAY2)
    ingest_daily(spark, logs, out, ckpt).awaitTermination()
    ingest_daily(spark, logs, out, ckpt).awaitTermination()  # nothing new: nothing added
    streamed = spark.read.parquet(out)
    batch_path = f"{scratch}/batch"
    write_daily(parse_logs(read_log_lines(spark, logs)), batch_path)
    batch = spark.read.parquet(batch_path)
    cols = ["source", "ts", "level", "message", "raw", "day"]
    assert streamed.count() == len(DAY1) + len(DAY2)
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_update_mode_is_rejected(spark, scratch):
    import pytest

    _write(f"{scratch}/in", "a.log", DAY1)
    with pytest.raises(ValueError, match="update"):
        run_to_path(follow_logs(spark, f"{scratch}/in"), f"{scratch}/out", f"{scratch}/ckpt", output_mode="update")


def _rows(spark, path):
    return sorted(tuple(r) for r in spark.read.parquet(path).select("source", "raw", "day").collect())


def test_old_files_that_arrive_late_are_read_and_output_can_be_compacted(spark, scratch):
    import glob
    import time

    from stevedore.operators import compact_in_place, write_daily
    from stevedore.streaming import compact_ingested, ingest_daily

    logs, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    rewritten = []
    for i in range(4):
        _write(logs, f"host-{i}/hive.log", DAY1)
        if i == 2:  # a rolled file moved in keeps its time of ten days ago
            old = time.time() - 10 * 86400
            os.utime(os.path.join(logs.removeprefix("file:"), "host-2/hive.log"), (old, old))
        ingest_daily(spark, logs, out, ckpt).awaitTermination()
        rewritten.append(compact_ingested(spark, out))
    assert rewritten[:2] == [0, 0] and all(rewritten[2:])  # the newest batch is left alone
    plain = out.removeprefix("file:")
    days = glob.glob(f"{plain}/day=*")
    assert all(len(glob.glob(f"{d}/batch=*")) == len(glob.glob(f"{d}/batch=*/*.parquet")) == 2 for d in days)
    write_daily(parse_logs(read_log_lines(spark, logs)), f"{scratch}/batch")
    assert _rows(spark, out) == _rows(spark, f"{scratch}/batch") and len(_rows(spark, out)) == 4 * len(DAY1)
    assert compact_in_place(spark, out, ["day", "batch"]) == 0


def test_a_compaction_that_was_cut_off_is_finished(spark, scratch):
    import glob
    import shutil

    from stevedore.streaming import compact_ingested, ingest_daily

    logs, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    for i in range(3):
        _write(logs, f"host-{i}/hive.log", DAY1)
        ingest_daily(spark, logs, out, ckpt).awaitTermination()
    expected, plain = _rows(spark, out), out.removeprefix("file:")
    earlier = f"{scratch}/earlier".removeprefix("file:")
    shutil.copytree(plain, earlier)
    assert compact_ingested(spark, out)
    for folder in glob.glob(f"{earlier}/day=*/batch=*"):  # as if the old folders had stayed
        shutil.copytree(folder, folder.replace(earlier, plain), dirs_exist_ok=True)
    assert len(_rows(spark, out)) > len(expected)
    compact_ingested(spark, out)
    assert _rows(spark, out) == expected


def test_a_replayed_batch_lands_once(spark, scratch):
    from stevedore.streaming import ingest_daily

    logs, out, ckpt = f"{scratch}/in", f"{scratch}/out", f"{scratch}/ckpt"
    _write(logs, "hive.log", DAY1)
    ingest_daily(spark, logs, out, ckpt).awaitTermination()
    plain = ckpt.removeprefix("file:")
    os.rename(f"{plain}/commits", f"{plain}/commits-old")  # as after a crash before the commit: the batch runs again
    ingest_daily(spark, logs, out, ckpt).awaitTermination()
    assert spark.read.parquet(out).count() == len(DAY1)
