"""Fixtures of the cases grow in tasks and in file size, not in rows of a task or in files without end."""

from __future__ import annotations

import pytest
from conftest import SF001, SF01
from oracle_util import compare, duck
from pyspark.sql import functions as F

from stevedore.plans import CASES, cases
from stevedore.plans import fixtures as fx
from stevedore.plans.oracle import ORACLE_SQL


@pytest.mark.parametrize(("rows", "tasks"), [(0, 4), (1000, 4), (10_000, 10)])
def test_rows_are_dealt_evenly_without_a_sort(spark, rows, tasks):
    df = fx.dealt(spark.range(rows).select(F.lit(None).cast("long").alias("k")), 4, rows, 1000)
    assert "Sort" not in df._jdf.queryExecution().executedPlan().toString() and df.columns == ["k"]
    counts = [n for _, n in df.groupBy(F.spark_partition_id()).count().collect()]
    assert df.rdd.getNumPartitions() == tasks and sum(counts) == rows and max(counts, default=0) <= max(1300, rows // 4 + 100)


@pytest.mark.parametrize("name", ["compact_in_place", "compact_evolved"])
def test_no_task_writes_a_fixed_share_of_the_table(spark, monkeypatch, name):
    seen = []

    def dealt(df, least, rows, per_task=fx.ROWS_PER_TASK):
        parts = fx.dealt(df, least, rows, per_task // fx.ROWS_PER_TASK * 5000)
        seen.append(max(n for _, n in parts.groupBy(F.spark_partition_id()).count().collect()))
        return parts

    monkeypatch.setattr(cases, "dealt", dealt)
    ok, message = compare(CASES[name](spark, SF01), duck(SF01), ORACLE_SQL[name])
    assert ok, message
    assert len(seen) == 2 and max(seen) <= 10_000  # of 60,000


@pytest.mark.parametrize("events", [0, 1, 1000, 100_000, 6_000_000, 36_000_000, 500_000_000])
def test_rolled_files_grow_before_they_become_many(events):
    span = max(1, 2 * events)
    width = fx.rolled_files(events, span)
    files = span // width + 1
    assert width % 2 == 0  # a file ends between a record and its trace
    assert files <= max(257, events // (1 << 18) + 2) and (events < 512 or files >= 2)
    assert width <= max(2 * 256, span // 256 + 2) and width // 2 <= (1 << 18) + 1


def test_records_are_rolled_by_the_number_of_events(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(cases, "rolled_files", lambda *args: seen.append(args) or fx.rolled_files(*args))
    events = spark.read.parquet(f"{SF001}/events.parquet")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    ok, message = compare(CASES["follow_records"](spark, SF001), duck(SF001), ORACLE_SQL["follow_records"])
    assert ok, message
    assert seen == [(events.count(), 2 * (high - low) + 2)]
