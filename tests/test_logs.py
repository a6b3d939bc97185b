"""R1-R6: parsing the three layouts and the jobs over parsed lines."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stevedore.operators import error_tail, error_verdict, filter_severity, keep_newest_days, write_daily
from stevedore.sources import parse_logs, read_log_lines

LINES = [
    ("a", "[2024-03-01 10:00:00] [INFO] service started"),
    ("a", "2024-03-01 10:00:01.250 WARN  [main] HiveServer2 - slow start: 12 s"),
    ("a", "2024-03-01 10:00:02.500 ERROR Driver:484 - Connection failed - retrying"),
    ("a", "java.lang.RuntimeException: boom"),
    ("a", "\tat org.example.Thing.run(Thing.java:10)"),
    ("b", "[2024-03-02 09:00:00] [DEBUG] probe"),
    ("b", "[2024-03-02 09:00:05] [UNKNOWN] something odd"),
    ("b", "2024-03-02 09:00:06.001 INFO  [pool-1 thread-2] Conf - key=[x] ok"),
    ("c", "[2024-03-03 00:00:00] [INFO] all good\r"),
    ("c", ""),
]


@pytest.fixture()
def logs(spark):
    return parse_logs(spark.createDataFrame(LINES, "source STRING, value STRING"))


def by_raw(df):
    return {r.raw: r for r in df.collect()}


def test_parse_three_layouts(logs):
    got = by_raw(logs)
    r = got["[2024-03-01 10:00:00] [INFO] service started"]
    assert (r.ts, r.level, r.thread, r.logger, r.line_no, r.message) == (
        dt.datetime(2024, 3, 1, 10), "INFO", None, None, None, "service started"
    )
    r = got["2024-03-01 10:00:01.250 WARN  [main] HiveServer2 - slow start: 12 s"]
    assert (r.ts, r.level, r.thread, r.logger, r.line_no, r.message) == (
        dt.datetime(2024, 3, 1, 10, 0, 1, 250000), "WARN", "main", "HiveServer2", None, "slow start: 12 s"
    )
    r = got["2024-03-01 10:00:02.500 ERROR Driver:484 - Connection failed - retrying"]
    assert (r.level, r.logger, r.line_no, r.message) == ("ERROR", "Driver", 484, "Connection failed - retrying")
    r = got["2024-03-02 09:00:06.001 INFO  [pool-1 thread-2] Conf - key=[x] ok"]
    assert (r.thread, r.logger, r.message) == ("pool-1 thread-2", "Conf", "key=[x] ok")
    r = got["[2024-03-03 00:00:00] [INFO] all good\r"]
    assert r.level == "INFO" and r.ts == dt.datetime(2024, 3, 3)


def test_unparsed_lines_are_kept_with_null_fields(logs):
    got = by_raw(logs)
    for raw in ["java.lang.RuntimeException: boom", "\tat org.example.Thing.run(Thing.java:10)", ""]:
        r = got[raw]
        assert (r.ts, r.level, r.message) == (None, None, None)
    assert logs.count() == len(LINES)


def test_filter_severity_splits_unranked(logs):
    kept, unranked = filter_severity(logs, "warn")
    assert sorted(r.level for r in kept.collect()) == ["ERROR", "WARN"]
    assert sorted(str(r.level) for r in unranked.collect()) == ["None"] * 3 + ["UNKNOWN"]
    kept_info, _ = filter_severity(logs)
    assert kept_info.count() == 5
    with pytest.raises(ValueError):
        filter_severity(logs, "LOUD")


def test_fatal_is_above_error(spark):
    levels = ["TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL", "ODD", None]
    logs = spark.createDataFrame([(x,) for x in levels], "level STRING")
    for i, level in enumerate(levels[:6]):
        kept, unranked = filter_severity(logs, level)
        assert [r.level for r in kept.collect()] == levels[i:6] and [r.level for r in unranked.collect()] == ["ODD", None]


def test_error_tail_newest_first_untimed_last(logs):
    out = error_tail(logs, n=2).filter("source = 'a'").orderBy("recency").collect()
    assert [r.raw for r in out] == [
        "2024-03-01 10:00:02.500 ERROR Driver:484 - Connection failed - retrying",
        "java.lang.RuntimeException: boom",
    ]


def test_error_verdict_includes_clean_sources(logs):
    got = {r.source: (r.n_lines, r.n_errors, r.has_errors) for r in error_verdict(logs).collect()}
    assert got == {"a": (5, 2, True), "b": (3, 0, False), "c": (2, 0, False)}


def test_write_daily_reruns_replace_days(spark, logs, scratch):
    write_daily(logs, scratch)
    write_daily(logs.filter("source = 'b'"), scratch)  # re-run for 2024-03-02 only
    back = spark.read.parquet(scratch)
    counts = {str(r.day): r["count"] for r in back.groupBy("day").count().collect()}
    assert counts == {"2024-03-01": 3, "2024-03-02": 3, "2024-03-03": 1, "None": 3}


def test_keep_newest_days(logs):
    got = keep_newest_days(logs, n=2)
    assert sorted({str(r.day) for r in got.collect()}) == ["2024-03-02", "2024-03-03", "None"]
    assert keep_newest_days(logs, n=30).count() == len(LINES)


def test_read_log_lines_names_the_file(spark, scratch):
    path = scratch.removeprefix("file:")
    import os

    os.makedirs(f"{path}/host1", exist_ok=True)
    with open(f"{path}/host1/hive.log", "w") as f:
        f.write("[2024-03-01 10:00:00] [INFO] one\n[2024-03-01 10:00:01] [ERROR] two failed\n")
    lines = read_log_lines(spark, scratch)
    parsed = parse_logs(lines)
    rows = parsed.select(F.col("source").endswith("host1/hive.log").alias("ok"), "level").collect()
    assert all(r.ok for r in rows) and sorted(r.level for r in rows) == ["ERROR", "INFO"]


def _logs(spark, scratch, files: dict[str, list[str]], split: int | None = None):
    import os

    root = scratch.removeprefix("file:") + "/logs"
    for name, lines in files.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "w") as f:
            f.write("".join(line + "\n" for line in lines))
    if split is None:
        return parse_logs(read_log_lines(spark, root))
    from stevedore.operators._paths import own_session

    small = own_session(spark, {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "0"})
    return parse_logs(read_log_lines(small, root))


def test_stack_traces_belong_to_their_record_across_splits(spark, scratch, monkeypatch):
    """Small splits: a record and its trace lie in different ones."""
    from stevedore.sources import attach_records

    lines, owner = ["a header line before any record"], [None]
    for i in range(400):
        lines.append(f"[2024-03-{1 + i // 20:02d} 10:00:{i % 60:02d}] [{'ERROR' if i % 3 else 'INFO'}] record {i} failed")
        owner.append(i)
        for j in range(i % 7):
            lines.append(f"\tat org.example.Thing{i}.run(Thing.java:{j})")
            owner.append(i)
    logs = _logs(spark, scratch, {"h/a.log": lines, "h/b.log": ["no record at all"]}, split=700)
    assert logs.select("block").distinct().count() > 10
    for way in ("in place", "many splits", "moved"):
        if way == "many splits":
            monkeypatch.setattr("stevedore.sources.logs._BROADCAST_SPLITS", 0)
        attached = attach_records(logs.repartition(5), moved=True) if way == "moved" else attach_records(logs, first="begun")
        got = attached.orderBy("source", "block", "seq").collect()
        assert [r.raw for r in got] == [*lines, "no record at all"]
        for r, i in zip(got, [*owner, None], strict=True):
            expected = None if i is None else dt.datetime(2024, 3, 1 + i // 20, 10, 0, i % 60)
            assert r.record_ts == expected and r.record_level == (None if i is None else "ERROR" if i % 3 else "INFO")
        if way != "moved":
            assert [r.begun for r in got if r.begun] == [dt.datetime(2024, 3, 1, 10)]  # the header line's
    with pytest.raises(PySparkException, match="moved=True"):
        attach_records(logs.repartition(5)).collect()
    tail = error_tail(logs, n=3).filter("source LIKE '%a.log'").orderBy("recency").collect()
    assert [r.raw for r in tail] == [x for x in lines if "failed" in x][:-4:-1]


def test_daily_writes_keep_every_trace(spark, scratch):
    day = lambda d: [f"[2024-03-0{d} 10:00:00] [ERROR] x", f"\ttrace {d}"]
    logs = _logs(spark, scratch, {"a.log": ["head", *day(1)], "b.log": day(2), "c.log": ["never dated"], "d.log": ["nor this"]})
    one = logs.filter("source LIKE '%/a.log' OR source LIKE '%/c.log'")
    two = logs.filter("source LIKE '%/b.log' OR source LIKE '%/d.log'")
    path = f"{scratch}/daily"
    for part in (one, two, one, two):  # re-runs change nothing
        write_daily(part, path)
    got = sorted((str(r.day), r.raw) for r in spark.read.parquet(path).collect())
    assert got == sorted(
        [("2024-03-01", "head"), ("None", "never dated"), ("None", "nor this")]
        + [(f"2024-03-0{d}", line) for d in (1, 2) for line in day(d)]
    )
    kept = keep_newest_days(spark.read.parquet(path), n=1)
    assert sorted(r.raw for r in kept.collect()) == sorted([*day(2), "never dated", "nor this"])


def test_control_characters_survive_the_parse(spark):
    messages = ["a\u0001b", "\u0003", "\u0003b\u0001\u0003a", "\u0002", "x\u0001"]
    lines = spark.createDataFrame([("s", f"[2024-03-01 10:00:00] [INFO] {m}") for m in messages], "source STRING, value STRING")
    got = parse_logs(lines).collect()
    assert [(r.message, r.level) for r in got] == [(m, "INFO") for m in messages]


def test_thread_names_hold_brackets(spark):
    names = ["exec[1]", "a] b", "[", "]", "", "pool[2] thread[3]", "x - y"]
    lines = spark.createDataFrame([("s", f"2024-03-01 10:00:00.000 INFO  [{n}] Foo - msg [x] Bar - z") for n in names], "source STRING, value STRING")
    got = parse_logs(lines).collect()
    assert [(r.thread or "", r.logger, r.message) for r in got] == [(n, "Foo", "msg [x] Bar - z") for n in names]
