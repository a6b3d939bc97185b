"""R9 by digests of key ranges: same differences as the plain join, and few rows moved."""

from __future__ import annotations

import random

import pytest
from conftest import SF01
from pyspark.sql import functions as F

from stevedore.operators import reconcile, reconcile_ranges
from stevedore.operators.reconcile import differing_ranges


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_few_differences_move_few_rows(spark):
    """Of 15,000 rows, those in the ranges of five differences are left for the join."""
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    keys = sorted(r.o_orderkey for r in orders.select("o_orderkey").collect())
    gone, new, changed = keys[10], keys[-1] + 7, keys[100:103]
    actual = orders.filter(F.col("o_orderkey") != gone).withColumn("o_totalprice", F.when(F.col("o_orderkey").isin(changed), -1).otherwise(F.col("o_totalprice")))
    actual = actual.unionByName(orders.limit(1).withColumn("o_orderkey", F.lit(new).cast("long")))
    columns = [c for c in orders.columns if c != "o_orderkey"]
    sides = differing_ranges(orders, actual, ["o_orderkey"], columns, ranges=64)
    assert all(4 <= df.count() < 60 for df in sides)
    got = rows(reconcile_ranges(orders, actual, ["o_orderkey"], ranges=64))
    assert got == rows(reconcile(orders, actual, ["o_orderkey"])) and len(got) == 5
    assert [df.count() for df in differing_ranges(orders, orders.repartition(3), ["o_orderkey"], columns)] == [0, 0]


@pytest.mark.parametrize("seed", range(3))
def test_same_result_as_the_join(spark, seed):
    """NULL keys, NULLs that change places, arrays, columns of one side, other integer widths, negative zero."""
    rng = random.Random(seed)

    def side(kind, extra):
        out = []
        for k in [*range(40), None, None]:
            if rng.random() < 0.9:
                x, y = rng.choice([(1, None), (None, 1), (1, 1)])
                out.append((k, x, y, rng.choice([0.0, -0.0]), rng.choice([[1, None], [None, 1]]), "e"))
        df = spark.createDataFrame(out, f"k {kind}, x INT, y INT, z DOUBLE, l ARRAY<INT>, {extra} STRING")
        return df

    expected, actual = side("INT", "left_only"), side("BIGINT", "right_only")
    assert rows(reconcile_ranges(expected, actual, ["k"], ranges=4)) == rows(reconcile(expected, actual, ["k"]))
    only = ["x", "z"]
    assert rows(reconcile_ranges(expected, actual, ["k"], columns=only, ranges=4)) == rows(reconcile(expected, actual, ["k"], columns=only))


def test_duplicates_types_and_empty_sides(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k INT, v STRING")
    none = a.limit(0)
    assert rows(reconcile_ranges(a, none, ["k"])) == [(1, "missing", None), (2, "missing", None)]
    assert rows(reconcile_ranges(none, a, ["k"])) == [(1, "extra", None), (2, "extra", None)] and rows(reconcile_ranges(none, none, ["k"])) == []
    # {x, x} and {y, y} under one key: sums of hashes don't cancel out as exclusive ors would.
    twice = [spark.createDataFrame([(1, v), (1, v)], "k INT, v STRING") for v in "xy"]
    with pytest.raises(Exception, match="duplicate key"):
        reconcile_ranges(*twice, ["k"]).collect()
    assert rows(reconcile_ranges(twice[0], twice[0], ["k"])) == []
    with pytest.raises(TypeError, match="v is"):
        reconcile_ranges(a, a.withColumn("v", F.lit(1)), ["k"])
    with pytest.raises(ValueError, match="neither side"):
        reconcile_ranges(a, a, ["k"], columns=["w"])
