"""C3, C4: as-of reads and history trimming."""

from __future__ import annotations

import datetime as dt
from pathlib import Path

import pytest
from conftest import SF01

from stevedore.operators import read_evolved, retain_history, retain_in_place, snapshot_as_of

KEYS, ORDER = ["user_id"], ["ts", "event_id"]


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{SF01}/events.parquet")


def test_snapshot_tombstone_hides_key(spark):
    h = spark.createDataFrame(
        [(1, 1, "put"), (1, 2, "del"), (2, 1, "put"), (2, 3, "put")], "k INT, ver INT, op STRING"
    )
    assert sorted(tuple(r) for r in snapshot_as_of(h, ["k"], ["ver"], 2, deleted="op = 'del'").collect()) == [
        (2, 1, "put")
    ]
    assert sorted(tuple(r) for r in snapshot_as_of(h, ["k"], ["ver"], 1).collect()) == [(1, 1, "put"), (2, 1, "put")]


@pytest.mark.parametrize(
    "as_of", ["2024-01-24 00:00:00", "2024-01-27 12:00:00", "2024-01-31 00:00:00", dt.datetime(2024, 1, 29)]
)
def test_retention_keeps_every_answer_inside_the_period(events, as_of):
    trimmed = retain_history(events, KEYS, ORDER, hours=168)
    assert trimmed.count() < events.count()
    deleted = "event_type = 'error'"
    assert same(
        snapshot_as_of(events, KEYS, ORDER, as_of, deleted=deleted),
        snapshot_as_of(trimmed, KEYS, ORDER, as_of, deleted=deleted),
    )


def test_retention_exactly_at_cutoff(events):
    newest = events.agg({"ts": "max"}).first()[0]
    cutoff = newest - dt.timedelta(hours=168)
    trimmed = retain_history(events, KEYS, ORDER, hours=168)
    assert same(snapshot_as_of(events, KEYS, ORDER, cutoff), snapshot_as_of(trimmed, KEYS, ORDER, cutoff))


def test_retention_with_explicit_now_and_null_times(spark):
    h = spark.createDataFrame(
        [(1, None, "a"), (1, "2024-01-01 00:00:00", "b"), (2, None, "c"), (1, "2024-01-09 00:00:00", "d")],
        "k INT, ts STRING, v STRING",
    ).selectExpr("k", "CAST(ts AS TIMESTAMP_NTZ) AS ts", "v")
    out = retain_history(h, ["k"], ["ts"], hours=24, now="2024-01-09 12:00:00")
    got = sorted((r.k, r.v) for r in out.collect())
    assert got == [(1, "b"), (1, "d"), (2, "c")]


def test_day_partitions_are_pruned(spark, events, scratch):
    from pyspark.sql import functions as F

    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(scratch)
    daily = spark.read.parquet(scratch)
    snap = snapshot_as_of(daily, KEYS, ORDER, "2024-01-05 12:00:00", day_col="day")
    scan = next(line for line in snap._jdf.queryExecution().executedPlan().toString().splitlines()
                if "FileScan parquet" in line)
    assert "PartitionFilters: [" in scan and "day#" in scan.split("PartitionFilters: [", 1)[1]
    plain = snapshot_as_of(events, KEYS, ORDER, "2024-01-05 12:00:00")
    assert same(snap.drop("day"), plain)
    trimmed = retain_history(daily, KEYS, ORDER, hours=168, day_col="day")
    assert same(trimmed.drop("day"), retain_history(events, KEYS, ORDER, hours=168))


def daily(spark, events, path):
    from pyspark.sql import functions as F

    events.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)


def days_of(path):
    return sorted(p.name.partition("=")[2] for p in Path(path).iterdir() if p.is_dir())


def test_retention_in_place_keeps_every_answer(spark, events, scratch):
    """Two runs: every as-of from the cutoff on is answered as before, with and without the day filter."""
    daily(spark, events, scratch)
    before = days_of(scratch)
    assert retain_in_place(spark, scratch, KEYS, ORDER, hours=240) and "0001-01-01" in days_of(scratch)
    newest = events.agg({"ts": "max"}).first()[0]
    cutoff = newest - dt.timedelta(hours=168)
    kept = [d for d in before if d >= cutoff.date().isoformat()]
    files = {p: p.stat().st_mtime_ns for d in kept for p in Path(scratch, f"day={d}").glob("*.parquet")}
    dropped = retain_in_place(spark, scratch, KEYS, ORDER, hours=168)
    assert 0 < len(dropped) < 4 and days_of(scratch) == ["0001-01-01", *kept]  # days folded before aren't there to be read
    assert files == {p: p.stat().st_mtime_ns for d in kept for p in Path(scratch, f"day={d}").glob("*.parquet")}
    assert retain_in_place(spark, scratch, KEYS, ORDER, hours=168) == []
    trimmed = spark.read.parquet(scratch)
    for as_of in (cutoff, cutoff + dt.timedelta(hours=30), newest):
        plain = snapshot_as_of(events, KEYS, ORDER, as_of, deleted="event_type = 'error'")
        for day_col in (None, "day"):
            assert same(plain, snapshot_as_of(trimmed, KEYS, ORDER, as_of, deleted="event_type = 'error'", day_col=day_col).drop("day"))


def test_retention_in_place_cut_off_before_old_days_go(spark, events, scratch, monkeypatch):
    """The baseline is there and so are the old days: same answers, and the next run ends the work."""
    from stevedore.operators import history

    daily(spark, events, scratch)

    def lost(*_):
        raise RuntimeError("driver lost")

    with monkeypatch.context() as m:
        m.setattr(history, "delete", lost)
        with pytest.raises(RuntimeError):
            retain_in_place(spark, scratch, KEYS, ORDER, hours=168)
    cutoff = events.agg({"ts": "max"}).first()[0] - dt.timedelta(hours=168)
    plain = snapshot_as_of(events, KEYS, ORDER, cutoff)
    assert same(plain, snapshot_as_of(spark.read.parquet(scratch).drop("day"), KEYS, ORDER, cutoff))
    assert retain_in_place(spark, scratch, KEYS, ORDER, hours=168)
    assert same(plain, snapshot_as_of(spark.read.parquet(scratch).drop("day"), KEYS, ORDER, cutoff))


def test_retention_in_place_of_changed_files_and_null_days(spark, scratch):
    """Old files without a later column and with a narrower key; rows of no day stay; an empty or missing table has no days."""
    for rows in (
        "SELECT 1 AS k, TIMESTAMP'2024-01-01 01:00:00' AS at",
        "SELECT 3000000000 AS k, CAST(NULL AS TIMESTAMP) AS at, 'x' AS v",
        "SELECT * FROM VALUES (1L, TIMESTAMP'2024-01-02 02:00:00', 'a'), (2L, TIMESTAMP'2024-01-02 01:00:00', 'b'), (2L, TIMESTAMP'2024-03-01 00:00:00', 'c') AS t(k, at, v)",
        "SELECT 4 AS k, TIMESTAMP'2024-01-02 03:00:00' AS at",
    ):
        spark.sql(rows).selectExpr("*", "to_date(at) AS day").write.mode("append").partitionBy("day").parquet(scratch)
    assert retain_in_place(spark, scratch, ["k"], ["at"], hours=24) == ["2024-01-01", "2024-01-02"]
    got = {(r.k, r.v, r.day) for r in read_evolved(spark, scratch, ["day"]).collect()}
    assert got == {(1, "a", "0001-01-01"), (2, "b", "0001-01-01"), (4, None, "0001-01-01"), (2, "c", "2024-03-01"), (3000000000, "x", None)}
    assert retain_in_place(spark, f"{scratch}-none", ["k"], ["at"]) == []
