"""R7: records whose lines span files and micro-batches, and files that come late: against the same counts by hand."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stevedore.streaming import follow_records, run_to_path

HEARTBEAT = "[2100-01-01 00:00:00] [INFO] end"


def _write(root, name, lines):
    path = os.path.join(root.removeprefix("file:"), name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("".join(x + "\n" for x in lines))
    at = 1_700_000_000 + len(os.listdir(os.path.dirname(path)))  # files come in the order in which they were written
    os.utime(path, (at, at))


def _run(spark, scratch, **options):
    stream = follow_records(spark, f"{scratch}/in", place=lambda p: F.regexp_extract(p, r"([^/]+)$", 1), **options)
    run_to_path(stream, f"{scratch}/out", f"{scratch}/ckpt").awaitTermination()
    return spark.read.parquet(f"{scratch}/out")


def _counts(lines):
    """(hour, level) -> lines, traces with their record."""
    out, owner = Counter(), (None, None)
    for line in lines:
        if m := re.match(r"\[(\d{4}-\d\d-\d\d \d\d):\d\d:\d\d\] \[(\w+)\]", line):
            owner = (m[1] + ":00:00", m[2])
        out[owner] += 1
    return out


def _summed(rows):
    out = Counter()
    for r in rows:
        out[r.window_start and str(r.window_start), r.level] += r.n
    return out


def _log(rng, n, start=0):
    lines = []
    for i in range(n):
        hour, minute = divmod(start + i * 7 + rng.randint(0, 40), 60)
        lines.append(f"[2024-03-{1 + hour // 24:02d} {hour % 24:02d}:{minute:02d}:00] [{rng.choice(['INFO', 'WARN', 'ERROR'])}] x{i}")
        lines.extend(f"  at frame {k}" for k in range(rng.choice([0, 0, 1, 5])))
    return lines


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_traces_over_files_and_batches(spark, scratch, per_trigger):
    rng = random.Random(3)
    logs = {name: ["above all records", *_log(rng, 150)] for name in ("a", "b")}
    cut = {n: sorted(rng.sample(range(1, len(x)), 5)) for n, x in logs.items()}
    for half in (0, 1):  # the second half comes to a restarted query
        for name, lines in logs.items():
            bounds = [0, *cut[name], len(lines)]
            for k in range(3 * half, 3 * half + 3):
                _write(f"{scratch}/in", f"{name}.log.{k:04d}", lines[bounds[k] : bounds[k + 1]])
        if half:
            _write(f"{scratch}/in", "c.log.0009", [HEARTBEAT])
        out = _run(spark, scratch, max_files_per_trigger=per_trigger)
    rows = out.collect()
    expected = {n: _counts(x) for n, x in logs.items()}
    assert {r.series.rsplit("/", 1)[1] for r in rows} == {"a.log", "b.log"}
    for name in logs:
        assert _summed(r for r in rows if r.series.endswith(f"/{name}.log")) == expected[name]
    # Every window is given out once on time.
    on_time = [(r.series, r.window_start, r.level) for r in rows if not r.late and r.window_start]
    assert len(on_time) == len(set(on_time))


def test_late_lines_are_given_out_as_such(spark, scratch):
    _write(f"{scratch}/in", "a.log.1", ["[2024-03-01 10:00:00] [INFO] a", "[2024-03-01 15:00:00] [ERROR] b"])
    first = _run(spark, scratch).collect()
    assert [(str(r.window_start), str(r.window_end), r.level, r.n, r.late) for r in first] == [("2024-03-01 10:00:00", "2024-03-01 11:00:00", "INFO", 1, False)]
    _write(f"{scratch}/in", "a.log.2", ["  trace of b", "[2024-03-01 10:30:00] [WARN] late", "  its trace", "[2024-03-01 15:59:00] [ERROR] in time"])
    _run(spark, scratch)
    _write(f"{scratch}/in", "z.log.1", [HEARTBEAT])
    rows = _run(spark, scratch).collect()
    got = sorted((str(r.window_start), r.level, r.n, r.late) for r in rows)
    assert got == [("2024-03-01 10:00:00", "INFO", 1, False), ("2024-03-01 10:00:00", "WARN", 2, True), ("2024-03-01 15:00:00", "ERROR", 3, False)]


def test_a_file_behind_its_successors_keeps_their_record(spark, scratch):
    _write(f"{scratch}/in", "a.log.2", ["[2024-03-01 10:00:00] [INFO] second"])
    _run(spark, scratch)
    _write(f"{scratch}/in", "a.log.1", ["trace of an unknown record", "[2024-03-01 10:00:00] [WARN] first"])
    _run(spark, scratch)
    _write(f"{scratch}/in", "a.log.3", ["trace of second"])
    _write(f"{scratch}/in", "z.log.1", [HEARTBEAT])
    rows = _run(spark, scratch).collect()
    assert _summed(rows) == {("2024-03-01 10:00:00", "INFO"): 2, ("2024-03-01 10:00:00", "WARN"): 1, (None, None): 1}
    assert not any(r.late for r in rows)


def test_splits_of_one_file(spark, scratch):
    lines = _log(random.Random(4), 4000)
    _write(f"{scratch}/in", "a.log.1", lines)
    _write(f"{scratch}/in", "z.log.1", [HEARTBEAT])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000b")
    try:
        rows = _run(spark, scratch).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert _summed(rows) == _counts(lines)


def test_empty_files_and_windows_of_no_length(spark, scratch):
    _write(f"{scratch}/in", "a.log.1", [])
    _write(f"{scratch}/in", "a.log.2", ["no record at all"])
    rows = _run(spark, scratch).collect()
    assert [(r.window_start, r.level, r.n, r.late) for r in rows] == [(None, None, 1, False)]
    with pytest.raises(ValueError, match="window"):
        follow_records(spark, f"{scratch}/in", window="0 seconds")
