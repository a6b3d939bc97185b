"""C1, C2, C8: upsert, append with schema evolution, folding concurrent batches."""

from __future__ import annotations

import pytest
from conftest import SF01
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stevedore.operators import evolve_append, evolve_table, fold_batches, merge_upsert

SCHEMA = "k INT, v STRING, flag BOOLEAN"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merge_update_insert_delete(spark):
    target = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", False)], SCHEMA)
    source = spark.createDataFrame([(2, "B", False), (3, "C", True), (4, "D", False), (5, "E", True)], SCHEMA)
    out = merge_upsert(target, source, ["k"], delete_when="flag")
    assert rows(out) == [(1, "a", False), (2, "B", False), (4, "D", False)]


def test_merge_duplicate_source_key_raises(spark):
    target = spark.createDataFrame([(1, "a", False)], SCHEMA)
    source = spark.createDataFrame([(1, "x", False), (1, "y", False)], SCHEMA)
    with pytest.raises(PySparkException, match="duplicate key"):
        merge_upsert(target, source, ["k"]).collect()


def test_merge_null_keys_never_match(spark):
    target = spark.createDataFrame([(None, "t", False), (1, "a", False)], SCHEMA)
    source = spark.createDataFrame([(None, "s1", False), (None, "s2", False), (1, "A", False)], SCHEMA)
    out = merge_upsert(target, source, ["k"])
    assert rows(out) == sorted([(None, "t", False), (None, "s1", False), (None, "s2", False), (1, "A", False)], key=repr)


def test_merge_twice_is_idempotent(spark):
    orders = spark.read.parquet(f"{SF01}/orders.parquet")
    target = orders.filter("o_orderdate < '1999-01-01'")
    source = orders.filter("o_orderdate >= '1998-01-01'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    once = merge_upsert(target, source, ["o_orderkey"], delete_when="o_orderstatus = 'F'")
    twice = merge_upsert(once, source, ["o_orderkey"], delete_when="o_orderstatus = 'F'")
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


def test_merge_composite_keys_and_casts(spark):
    target = spark.createDataFrame([(1, 1, 10.0), (1, 2, 20.0)], "a INT, b INT, x DOUBLE")
    source = spark.createDataFrame([(1, 2, 25), (2, 1, 5)], "a INT, b INT, x INT")
    out = merge_upsert(target, source, ["a", "b"])
    assert out.schema["x"].dataType.simpleString() == "double"
    assert rows(out) == [(1, 1, 10.0), (1, 2, 25.0), (2, 1, 5.0)]


def test_merge_rejects_missing_columns(spark):
    target = spark.createDataFrame([(1, "a", False)], SCHEMA)
    with pytest.raises(ValueError, match="lacks"):
        merge_upsert(target, spark.createDataFrame([(1,)], "k INT"), ["k"])


def test_evolve_adds_widens_and_nulls(spark):
    base = spark.createDataFrame([(1, 10)], "id INT, n INT")
    incoming = spark.createDataFrame([(2, 3_000_000_000, "x")], "id INT, n BIGINT, tag STRING")
    out = evolve_append(base, incoming)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["int", "bigint", "string"]
    assert rows(out) == [(1, 10, None), (2, 3_000_000_000, "x")]


def test_evolve_rejects_string_vs_number_before_reading(spark, scratch):
    spark.createDataFrame([(1, 2)], "id INT, n INT").write.parquet(f"{scratch}/base")
    base = spark.read.parquet(f"{scratch}/base")
    incoming = spark.createDataFrame([(2, "many")], "id INT, n STRING")
    tracker = spark.sparkContext.statusTracker()
    jobs_before = set(tracker.getJobIdsForGroup())
    with pytest.raises(TypeError, match="n: int vs string"):
        evolve_append(base, incoming)
    assert set(tracker.getJobIdsForGroup()) == jobs_before


def test_evolve_table_adds_columns(spark, scratch):
    name = "evolve_t"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} (id INT, n BIGINT) USING parquet LOCATION '{scratch}/evolve_t'")
    spark.sql(f"INSERT INTO {name} VALUES (1, 10)")
    out = evolve_table(spark.createDataFrame([(2, 20, "x")], "id INT, n INT, tag STRING"), name)
    assert out.columns == ["id", "n", "tag"]
    assert rows(out) == [(1, 10, None), (2, 20, "x")]
    spark.sql(f"DROP TABLE {name}")


def test_fold_batches_latest_writer_wins_and_counts(spark):
    df = spark.createDataFrame(
        [(1, 0, 1, "a"), (1, 2, 1, "b"), (1, 2, 0, "c"), (2, 1, 5, "d"), (None, 1, 1, "n1"), (None, 1, 1, "n2")],
        "k INT, batch INT, seq INT, v STRING",
    )
    out = fold_batches(df, ["k"], "batch", ["seq"])
    assert rows(out) == sorted(
        [(1, 2, 1, "b", 2), (2, 1, 5, "d", 1), (None, 1, 1, "n1", 1), (None, 1, 1, "n2", 1)], key=repr
    )


def _files_by_partition(path: str) -> dict[str, set[str]]:
    import glob
    import os

    root = path.removeprefix("file:")
    out: dict[str, set[str]] = {}
    for f in glob.glob(os.path.join(root, "*", "*.parquet")):
        out.setdefault(os.path.basename(os.path.dirname(f)), set()).add(os.path.basename(f))
    return out


def test_merge_into_path_rewrites_only_touched_partitions(spark, scratch):
    from stevedore.operators import merge_into_path, overwrite_partitions

    target = spark.createDataFrame(
        [(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, "d", "z")], "k INT, v STRING, part STRING"
    )
    path = f"{scratch}/t"
    overwrite_partitions(target, path, ["part"])
    before = _files_by_partition(path)
    source = spark.createDataFrame(
        [(2, "B", "x", False), (5, "E", "x", False), (3, "c", "y", True)], "k INT, v STRING, part STRING, gone BOOLEAN"
    )
    n = merge_into_path(spark, path, source, ["k"], ["part"], delete_when="gone")
    assert n == 2
    after = _files_by_partition(path)
    assert after["part=z"] == before["part=z"]  # untouched: same files
    assert "part=y" not in after  # emptied by the delete
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("k", "v", "part").collect())
    assert got == [(1, "a", "x"), (2, "B", "x"), (4, "d", "z"), (5, "E", "x")]


def test_merge_into_path_opens_only_touched_folders(spark, scratch):
    from stevedore.operators import merge_into_path, overwrite_partitions

    target = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k INT, v STRING, part STRING")
    path = f"{scratch}/t"
    overwrite_partitions(target, path, ["part"])
    # A file that can't be read, in an untouched partition, doesn't matter.
    broken = f"{path}/part=y/part-broken.parquet".removeprefix("file:")
    with open(broken, "w") as f:
        f.write("no parquet")
    merge_into_path(spark, path, target.filter("part = 'x'").withColumn("v", F.lit("A")), ["k"], ["part"])
    assert spark.read.parquet(f"{path}/part=x").collect()[0].v == "A"


def test_merge_into_path_removes_emptied_partitions_at_any_count(spark, scratch):
    from stevedore.operators import merge_into_path, overwrite_partitions

    target = spark.createDataFrame([(i, f"v{i}", i) for i in range(30)], "k INT, v STRING, part INT")
    path = f"{scratch}/t"
    overwrite_partitions(target, path, ["part"])
    assert merge_into_path(spark, path, target.filter("k < 29"), ["k"], ["part"], delete_when=F.lit(True)) == 29
    assert [r.k for r in spark.read.parquet(path).collect()] == [29]
    assert set(_files_by_partition(path)) == {"part=29"}


def test_path_jobs_keep_partition_text(spark, scratch):
    """Values that look like numbers or dates, NULL, and characters that folder names escape."""
    from stevedore.operators import compact, compact_in_place, merge_into_path, overwrite_partitions

    texts = ["01", "1", "2024-01", "1e3", None, "a/b=c d", "10"]
    target = spark.createDataFrame([(i, 1, p) for i, p in enumerate(texts)], "k INT, v INT, p STRING")
    path = f"{scratch}/t"
    for _ in range(2):
        overwrite_partitions(target, path, ["p"], mode="append")
    source = target.withColumn("v", F.lit(9))
    read = lambda at: spark.read.schema("k INT, v INT, p STRING").parquet(at)
    assert compact_in_place(spark, path, ["p"]) == len(texts)
    assert rows(read(path)) == rows(target.union(target))
    for _ in range(2):  # twice: nothing is inserted a second time
        assert merge_into_path(spark, path, source, ["k"], ["p"]) == len(texts)
        assert rows(read(path)) == rows(source.union(source))
    compact(spark, path, f"{scratch}/out", partition_by=["p"])
    assert rows(read(f"{scratch}/out")) == rows(source.union(source))


def test_path_jobs_refuse_file_sink_output(spark, scratch):
    from stevedore.operators import compact_in_place, merge_into_path, overwrite_partitions

    df = spark.createDataFrame([(1, 1)], "k INT, p INT")
    df.write.partitionBy("p").parquet(f"{scratch}/t")
    spark.createDataFrame([("v1",)], "s STRING").write.text(f"{scratch}/t/_spark_metadata")
    for job in (
        lambda: merge_into_path(spark, f"{scratch}/t", df, ["k"], ["p"]),
        lambda: compact_in_place(spark, f"{scratch}/t", ["p"]),
        lambda: overwrite_partitions(df, f"{scratch}/t", ["p"]),
    ):
        with pytest.raises(ValueError, match="file sink"):
            job()


def test_reconcile_reports_every_difference_and_rejects_duplicates(spark):
    from stevedore.operators import reconcile

    exp = spark.createDataFrame([(1, "a", 1.0), (2, "b", None), (3, "c", 3.0), (None, "n", 0.0)], "k INT, s STRING, x DOUBLE")
    act = spark.createDataFrame([(1, "a", 1.0), (2, "B", None), (4, "d", 4.0), (None, "n", 0.0)], "k INT, s STRING, x DOUBLE")
    got = sorted(((r.k, r.status, r.changed_columns) for r in reconcile(exp, act, ["k"]).collect()), key=repr)
    assert got == sorted(
        [(2, "changed", "s"), (3, "missing", None), (4, "extra", None), (None, "missing", None), (None, "extra", None)],
        key=repr,
    )
    dup = spark.createDataFrame([(1, "a", 1.0), (1, "z", 1.0)], "k INT, s STRING, x DOUBLE")
    with pytest.raises(PySparkException, match="duplicate key"):
        reconcile(exp, dup, ["k"]).collect()


def test_keyed_jobs_accept_map_columns(spark):
    from stevedore.operators import reconcile, snapshot_as_of

    df = spark.createDataFrame([(1, 1, {"a": 1}), (None, 2, {"b": 2})], "k INT, ver INT, m MAP<STRING, INT>")
    assert merge_upsert(df, df.filter("k IS NOT NULL"), ["k"]).count() == 2
    assert snapshot_as_of(df, ["k"], ["ver"], 5).count() == 2
    assert fold_batches(df, ["k"], "ver", ["ver"]).count() == 2
    assert reconcile(df.drop("m"), df.drop("m"), ["k"]).count() == 2  # the NULL-key row on each side


def test_colocated_merge_moves_only_the_source(spark):
    from stevedore.operators.tables import session_conf
    from stevedore.plans import CASES

    with session_conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        df = CASES["merge_colocated"](spark, SF01)
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SortMergeJoin" in plan


def test_colocated_merge_equals_default_merge(spark):
    target = spark.createDataFrame(
        [(1, "a", False), (2, "b", False), (None, "t", False), (3, "c", False)], SCHEMA
    )
    source = spark.createDataFrame(
        [(2, "B", False), (3, "C", True), (4, "D", False), (None, "s", False), (None, "x", True)], SCHEMA
    )
    a = merge_upsert(target, source, ["k"], delete_when="flag")
    b = merge_upsert(target, source, ["k"], delete_when="flag", colocated=True)
    assert rows(a) == rows(b)
    with pytest.raises(ValueError, match="duplicate key"):
        merge_upsert(target, source.union(source.filter("k = 2")), ["k"], colocated=True)


def test_merge_with_a_column_named_spread(spark):
    target = spark.createDataFrame([(1, 5), (2, 6)], "k INT, spread INT")
    source = spark.createDataFrame([(2, 7), (3, 8)], "k INT, spread INT")
    assert rows(merge_upsert(target, source, ["k"])) == [(1, 5), (2, 7), (3, 8)]


def test_fold_batches_takes_any_number_of_batches(spark):
    df = spark.createDataFrame([(1, b, b, "v") for b in range(300)], "k INT, batch INT, seq INT, v STRING")
    assert fold_batches(df, ["k"], "batch", ["seq"]).first().n_batches == 300


def test_widening_agrees_with_spark_union(spark):
    """Where evolve_append widens, it widens to the type Spark's own union picks."""
    from itertools import product

    from stevedore.functions.types import wider_type

    names = ["tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp_ntz", "timestamp"]
    names += ["decimal(3,1)", "decimal(10,0)", "decimal(20,2)", "decimal(25,20)", "decimal(38,0)"]
    for a, b in product(names, names):
        ta, tb = spark.createDataFrame([], f"x {a}"), spark.createDataFrame([], f"x {b}")
        ours = wider_type(ta.schema["x"].dataType, tb.schema["x"].dataType)
        if ours is None:
            continue
        theirs = ta.unionByName(tb).schema["x"].dataType
        assert ours == theirs, (a, b, ours, theirs)


def test_decimals_without_room_are_incompatible(spark):
    base, wide = spark.createDataFrame([], "x DECIMAL(38,0)"), spark.createDataFrame([], "x DECIMAL(38,18)")
    with pytest.raises(TypeError, match="decimal"):
        evolve_append(base, wide)
    exact = evolve_append(spark.sql("SELECT CAST('12345678901234567.89' AS DECIMAL(20,2)) AS x"), spark.sql("SELECT 1 AS x"))
    assert sorted(str(r.x) for r in exact.collect()) == ["1.00", "12345678901234567.89"]


def test_names_match_in_any_case(spark):
    both = evolve_append(spark.createDataFrame([(1,)], "id INT"), spark.createDataFrame([(2, 3)], "ID INT, Z INT"))
    assert both.columns == ["id", "Z"] and rows(both) == sorted([(1, None), (2, 3)], key=repr)


def test_merge_rejects_narrowing_and_unused_columns(spark):
    target = spark.createDataFrame([(1, 5)], "k INT, v INT")
    with pytest.raises(TypeError, match="v: double into int"):
        merge_upsert(target, spark.createDataFrame([(1, 1.7)], "k INT, v DOUBLE"), ["k"])
    with pytest.raises(ValueError, match="lacks source columns"):
        merge_upsert(target, spark.createDataFrame([(1, 1, 1)], "k INT, v INT, w INT"), ["k"])


def test_evolve_table_widens_by_rewriting_and_checks_first(spark, scratch):
    spark.sql(f"CREATE DATABASE widen LOCATION '{scratch}/widen'")
    spark.createDataFrame([(1, "a")], "id INT, p STRING").write.partitionBy("p").saveAsTable("widen.t")
    out = evolve_table(spark.createDataFrame([(1 << 40, "b", True)], "id BIGINT, p STRING, z BOOLEAN"), "widen.t")
    assert out.schema["id"].dataType.simpleString() == "bigint"
    assert [c.name for c in spark.catalog.listColumns("widen.t") if c.isPartition] == ["p"]
    assert sorted((r.id, r.p, r.z) for r in out.collect()) == [(1, "a", None), (1 << 40, "b", True)]
    with pytest.raises(TypeError):
        evolve_table(spark.createDataFrame([("x", 1)], "id STRING, fresh INT"), "widen.t")
    assert "fresh" not in spark.table("widen.t").columns
    spark.sql("DROP DATABASE widen CASCADE")
