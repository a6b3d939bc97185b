"""Empty inputs: every job returns an empty result of the right shape, without error."""

from __future__ import annotations

from stevedore.operators import (
    compact,
    error_tail,
    error_verdict,
    evolve_append,
    filter_severity,
    fold_batches,
    keep_newest_days,
    merge_upsert,
    reconcile,
    retain_history,
    snapshot_as_of,
)
from stevedore.sources import parse_logs

HIST = "k INT, ts TIMESTAMP_NTZ, v STRING"


def test_keyed_jobs_on_empty_inputs(spark):
    empty = spark.createDataFrame([], HIST)
    some = spark.createDataFrame([(1, None, "a")], HIST)
    assert merge_upsert(empty, empty, ["k"]).count() == 0
    assert merge_upsert(some, empty, ["k"]).count() == 1
    assert merge_upsert(empty, some, ["k"]).count() == 1
    assert snapshot_as_of(empty, ["k"], ["ts"], "2024-01-01").count() == 0
    assert retain_history(empty, ["k"], ["ts"]).count() == 0
    assert fold_batches(empty.withColumn("b", empty.k), ["k"], "b", ["ts"]).count() == 0
    assert reconcile(empty, empty, ["k"]).count() == 0
    assert evolve_append(empty, empty).count() == 0


def test_log_jobs_on_empty_inputs(spark):
    logs = parse_logs(spark.createDataFrame([], "source STRING, value STRING"))
    kept, unranked = filter_severity(logs)
    assert kept.count() == 0 and unranked.count() == 0
    assert error_tail(logs).count() == 0
    assert error_verdict(logs).count() == 0
    assert keep_newest_days(logs, 3).count() == 0


def test_compact_empty_folder(spark, scratch):
    spark.createDataFrame([], "a INT, p STRING").write.partitionBy("p").parquet(f"{scratch}/in")
    assert compact(spark, f"{scratch}/in", f"{scratch}/out", partition_by=["p"], schema="a INT, p STRING") == 0
