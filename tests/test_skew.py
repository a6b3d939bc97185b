"""Hot keys: one key holding a third of all rows, and NULL keys, against brute force."""

from __future__ import annotations

import pandas as pd
import pytest
from conftest import SF01
from pyspark.sql import functions as F

from stevedore.operators import error_tail, fold_batches, merge_upsert, snapshot_as_of
from stevedore.operators._keys import SPREAD, spread_column
from stevedore.sources import parse_logs


@pytest.fixture(scope="module")
def hot_events(spark):
    """events where every third event belongs to user 0."""
    events = spark.read.parquet(f"{SF01}/events.parquet")
    return events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")))


def test_hot_key_fold_matches_brute_force(hot_events):
    df = hot_events.withColumn("batch", F.weekday("ts"))
    got = fold_batches(df, ["user_id"], "batch", ["ts", "event_id"]).toPandas()
    pdf = df.toPandas().sort_values(["user_id", "batch", "ts", "event_id"])
    winners = pdf.groupby("user_id").tail(1).set_index("user_id")["event_id"]
    n_batches = pdf.groupby("user_id")["batch"].nunique()
    got = got.set_index("user_id")
    assert got["event_id"].sort_index().tolist() == winners.sort_index().tolist()
    assert got["n_batches"].sort_index().tolist() == n_batches.sort_index().tolist()
    assert (pdf.user_id == 0).mean() > 0.33


def test_hot_key_snapshot_matches_brute_force(hot_events):
    got = snapshot_as_of(hot_events, ["user_id"], ["ts", "event_id"], "2024-01-20 00:00:00").toPandas()
    pdf = hot_events.toPandas()
    pdf = pdf[pdf.ts <= pd.Timestamp("2024-01-20")].sort_values(["user_id", "ts", "event_id"])
    expected = pdf.groupby("user_id").tail(1)
    assert sorted(got.event_id) == sorted(expected.event_id)


def test_hot_source_error_tail_matches_brute_force(spark, hot_events):
    lines = hot_events.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("source"),
        F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("] [INFO] "), F.col("event_type"),
                 F.lit(" "), F.col("event_id").cast("string")).alias("value"),
    )
    logs = parse_logs(lines)
    got = error_tail(logs, n=25).toPandas()
    pdf = logs.toPandas()
    pdf = pdf[pdf.raw.str.contains("error|exception|failed", case=False)]
    pdf = pdf.sort_values(["source", "ts", "raw"], ascending=[True, False, False])
    expected = pdf.groupby("source").head(25)
    assert sorted(got.raw) == sorted(expected.raw)
    assert (got.source == "user-0").sum() == 25


def test_null_keys_are_spread_over_tasks(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    spread = df.withColumn(SPREAD, spread_column(df, ["k"]))
    per_task = (
        spread.filter("k IS NULL").repartition(8, "k", SPREAD).groupBy(F.spark_partition_id()).count().collect()
    )
    assert len(per_task) == 8 and max(r["count"] for r in per_task) < 0.25 * 10000


def test_merge_with_a_third_null_keys(spark):
    target = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), F.lit("t").alias("v")
    )
    source = spark.range(15000, 45000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("k"), F.lit("s").alias("v")
    )
    out = merge_upsert(target, source, ["k"])
    counts = {(r.v, r.k_null): r["count"] for r in out.groupBy("v", F.col("k").isNull().alias("k_null")).count().collect()}
    # Non-null target keys below 15000 stay; all non-null source keys are written; NULL keys never match.
    assert counts == {("t", False): 10000, ("t", True): 10000, ("s", False): 20000, ("s", True): 10000}
