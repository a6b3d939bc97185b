"""Path tables whose files don't all have one schema, compaction without a shuffle, merges that rewrite single files."""

from __future__ import annotations

import glob
import os

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from stevedore.operators import compact, compact_in_place, merge_into_path, read_evolved
from stevedore.operators import tables as tables_module


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def names(path):
    root = path.removeprefix("file:")
    return {os.path.relpath(f, root) for f in glob.glob(os.path.join(root, "**", "*.parquet"), recursive=True)}


@pytest.fixture()
def mixed(spark, scratch):
    """p=1: INT keys, without w; p=2: BIGINT keys, with w; p=3: both kinds of files."""
    path = f"{scratch}/mixed"
    old = spark.range(0, 20, 1, 4).selectExpr("CAST(id AS INT) AS k", "concat('v', id) AS v")
    new = spark.range(100, 120, 1, 4).selectExpr("id + 5000000000 AS k", "concat('n', id) AS v", "7 AS w")
    old.withColumn("p", F.lit("1")).write.partitionBy("p").parquet(path)
    old.withColumn("p", F.lit("3")).write.mode("append").partitionBy("p").parquet(path)
    new.withColumn("p", F.lit("2")).write.mode("append").partitionBy("p").parquet(path)
    new.withColumn("p", F.lit("3")).write.mode("append").partitionBy("p").parquet(path)
    expected = [(i, f"v{i}", None, p) for i in range(20) for p in "13"]
    expected += [(i + 5_000_000_000, f"n{i}", 7, p) for i in range(100, 120) for p in "23"]
    return path, sorted(expected, key=repr)


def test_read_evolved(spark, mixed):
    path, expected = mixed
    df = read_evolved(spark, path, ["p"])
    assert df.dtypes == [("k", "bigint"), ("v", "string"), ("w", "int"), ("p", "string")]
    assert rows(df) == expected
    one = read_evolved(spark, path, ["p"], folders=["p=1"])
    assert one.dtypes[:2] == [("k", "int"), ("v", "string")] and one.count() == 20


def test_compaction_keeps_every_column(spark, scratch, mixed):
    path, expected = mixed
    assert compact(spark, path, f"{scratch}/copy", partition_by=["p"]) == 3
    assert len(names(f"{scratch}/copy")) == 3
    assert rows(read_evolved(spark, f"{scratch}/copy", ["p"])) == expected
    assert spark.read.parquet(f"{scratch}/copy").dtypes[0] == ("k", "bigint")
    assert compact_in_place(spark, path, ["p"]) == 3
    assert rows(read_evolved(spark, path, ["p"])) == expected and len(names(path)) == 3
    assert compact_in_place(spark, path, ["p"]) == 0


def test_merge_keeps_every_column(spark, mixed):
    path, expected = mixed
    source = spark.createDataFrame([(3, "new", 9, "3"), (5_000_000_101, "new", None, "3")], "k LONG, v STRING, w INT, p STRING")
    assert merge_into_path(spark, path, source, ["k"], ["p"]) == 1
    changed = {(3, "3"): (3, "new", 9, "3"), (5_000_000_101, "3"): (5_000_000_101, "new", None, "3")}
    assert rows(read_evolved(spark, path, ["p"])) == sorted((changed.get((r[0], r[3]), r) for r in expected), key=repr)


def test_merge_evolves_only_when_asked(spark, mixed):
    path, expected = mixed
    source = spark.createDataFrame([(6_000_000_000, "x", 1, 2.5, "1")], "k LONG, v STRING, w INT, z DOUBLE, p STRING")
    with pytest.raises((TypeError, ValueError)):
        merge_into_path(spark, path, source, ["k"], ["p"])
    assert rows(read_evolved(spark, path, ["p"])) == expected
    merge_into_path(spark, path, source, ["k"], ["p"], evolve=["w", "z"])
    got = read_evolved(spark, path, ["p"])
    assert [c for c, _ in got.dtypes] == ["k", "v", "w", "z", "p"] and got.count() == len(expected) + 1
    assert rows(got.filter("z IS NOT NULL")) == [(6_000_000_000, "x", 1, 2.5, "1")]


def test_types_that_do_not_widen_raise_and_lose_nothing(spark, scratch):
    path = f"{scratch}/bad"
    spark.createDataFrame([(1, 1)], "k INT, p INT").write.partitionBy("p").parquet(path)
    spark.createDataFrame([("x", 1)], "k STRING, p INT").write.mode("append").partitionBy("p").parquet(path)
    before = names(path)
    for job in (lambda: compact_in_place(spark, path, ["p"]), lambda: compact(spark, path, f"{scratch}/out", partition_by=["p"])):
        with pytest.raises(TypeError, match="k: (int vs string|string vs int)"):
            job()
    assert names(path) == before


def test_one_key_rewrites_one_file(spark, scratch):
    path = f"{scratch}/t"
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    orders.repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey").write.partitionBy("o_orderstatus").parquet(path)
    before = names(path)
    one = orders.filter("o_orderstatus = 'O'").orderBy("o_orderkey").limit(1).withColumn("o_totalprice", F.lit(-1.0))
    assert merge_into_path(spark, path, one, ["o_orderkey"], ["o_orderstatus"]) == 1
    after = names(path)
    assert len(before - after) == 1 and len(after - before) == 1
    back = spark.read.parquet(path).select(*orders.columns)
    key = one.first().o_orderkey
    assert back.filter(F.col("o_orderkey") == key).first().o_totalprice == -1.0
    rest = F.col("o_orderkey") != key
    assert rows(back.filter(rest)) == rows(orders.filter(rest))
    # A key that the table doesn't hold is a new file, and none is rewritten.
    fresh = one.withColumn("o_orderkey", F.lit(-5).cast("long"))
    merge_into_path(spark, path, fresh, ["o_orderkey"], ["o_orderstatus"])
    assert after < names(path)
    # A delete that empties one file of a partition removes that file.
    merge_into_path(spark, path, fresh, ["o_orderkey"], ["o_orderstatus"], delete_when=F.lit(True))
    assert names(path) == after


def test_compaction_moves_no_row_and_keeps_their_order(spark, scratch, monkeypatch):
    path = f"{scratch}/t"
    spark.range(0, 40_000, 1, 40).selectExpr("id AS k", "CAST(id % 2 AS STRING) AS p").write.partitionBy("p").parquet(path)
    plans, packed = [], tables_module._packed

    def spied(*args):
        df = packed(*args)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        assert df.rdd.getNumPartitions() == 2
        return df

    monkeypatch.setattr(tables_module, "_packed", spied)
    assert compact_in_place(spark, path, ["p"]) == 2
    assert len(plans) == 1 and "Exchange" not in plans[0] and "Sort" not in plans[0]
    ids = [r.k for r in spark.read.parquet(f"{path}/p=0").collect()]
    assert sorted(ids) == list(range(0, 40_000, 2))
    breaks = sum(b != a + 2 for a, b in zip(ids, ids[1:], strict=False))
    assert breaks < 40  # the rows of each of the 40 files still lie together, in order
