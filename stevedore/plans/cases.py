"""One case per job: ``(spark, sf_dir) -> DataFrame`` over the whole test tables.

Cases that write put their files under the session's scratch root
(``spark.checkpoint.dir``), in a new folder per call, so repeated runs never see
each other's rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stevedore.operators import (
    append_rows,
    compact,
    compact_in_place,
    error_tail,
    error_verdict,
    evolve_append,
    evolve_table,
    filter_severity,
    fold_batches,
    keep_newest_days,
    merge_into_path,
    merge_upsert,
    optimized_write,
    overwrite_partitions,
    overwrite_table_partitions,
    publish_external,
    publish_table,
    read_evolved,
    reconcile,
    reconcile_ranges,
    reconcile_summary,
    replace_table,
    retain_history,
    retain_in_place,
    snapshot_as_of,
    write_daily,
)
from stevedore.operators.logs import with_day
from stevedore.operators.tables import table_layout
from stevedore.plans.fixtures import (
    AS_OF,
    MERGE_TARGET_END,
    RECONCILE_ACTUAL_FROM,
    RECONCILE_EXPECTED_TO,
    ROWS_PER_TASK,
    SPLIT_DATE,
    dealt,
    event_log_lines,
    ntz,
    rolled_files,
    table,
)
from stevedore.session import scratch_path
from stevedore.sources.logs import PLACE_COLUMNS, attach_records, parse_logs, read_log_lines
from stevedore.sources.settings import compare_settings, extract_settings
from stevedore.streaming.follow import compact_ingested, follow_logs, ingest_daily, run_to_path
from stevedore.streaming.records import follow_records

Case = Callable[[SparkSession, str], DataFrame]


def _run_database(spark: SparkSession) -> str:
    """A new database for this call, located under the scratch root."""
    name = f"stevedore_{uuid.uuid4().hex[:12]}"
    location = scratch_path(spark, name)
    spark.sql(f"CREATE DATABASE {name} LOCATION '{location}'")
    return name


# --- E: the statements the reference runs -------------------------------------------


def publish_managed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _run_database(spark)
    return publish_table(table(spark, sf_dir, "orders"), f"{db}.orders")


def publish_external_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _run_database(spark)
    path = scratch_path(spark, "external_orders")
    orders = table(spark, sf_dir, "orders")
    publish_external(orders, f"{db}.orders_ext", path)
    spark.sql(f"DROP TABLE {db}.orders_ext")
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


def append_rows_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _run_database(spark)
    orders = table(spark, sf_dir, "orders")
    spark.sql(
        f"CREATE TABLE {db}.orders_by_name (o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, "
        "o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING) USING parquet"
    )
    older = orders.filter(F.col("o_orderdate") < ntz(SPLIT_DATE))
    newer = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE))
    append_rows(older, f"{db}.orders_by_name")
    return append_rows(newer.select(*reversed(newer.columns)), f"{db}.orders_by_name")


# --- C: table behaviour ---------------------------------------------------------------


def merge_upsert_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    target = orders.filter(F.col("o_orderdate") < ntz(MERGE_TARGET_END))
    source = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE)).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    return merge_upsert(target, source, ["o_orderkey"], delete_when=F.col("o_orderstatus") == "F")


def merge_colocated_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upsert against a target table stored in buckets of its key: only the source moves."""
    db = _run_database(spark)
    orders = table(spark, sf_dir, "orders")
    target = publish_table(
        orders.filter(F.col("o_orderdate") < ntz(MERGE_TARGET_END)), f"{db}.orders", bucket_by=(16, ["o_orderkey"])
    )
    source = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE)).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    return merge_upsert(target, source, ["o_orderkey"], delete_when=F.col("o_orderstatus") == "F", colocated=True)


def merge_table_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert into a catalog table and write the result back over it."""
    db = _run_database(spark)
    orders = table(spark, sf_dir, "orders")
    name = f"{db}.orders"
    publish_table(orders.filter(F.col("o_orderdate") < ntz(MERGE_TARGET_END)), name)
    source = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE)).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    merged = merge_upsert(spark.table(name), source, ["o_orderkey"], delete_when=F.col("o_orderstatus") == "F")
    return replace_table(merged, name)


def merge_into_path_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_month", _month("o_orderdate"))
    path = scratch_path(spark, "orders_by_month")
    overwrite_partitions(orders.filter(F.col("o_orderdate") < ntz(MERGE_TARGET_END)), path, ["o_month"])
    source = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE)).withColumn(
        "o_totalprice", F.col("o_totalprice") + 1
    )
    gone = (F.col("o_orderstatus") == "F") | (F.col("o_month") == "02")
    # A first batch deletes all of February, in its partition and by partition value alone.
    february = orders.filter((F.col("o_month") == "02") & (F.col("o_orderdate") < ntz(MERGE_TARGET_END)))
    merge_into_path(spark, path, february, ["o_orderkey"], ["o_month"], delete_when=F.lit(True))
    merge_into_path(spark, path, source, ["o_orderkey"], ["o_month"], delete_when=gone)
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


def evolve_append_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    base = orders.filter(F.col("o_orderdate") < ntz(SPLIT_DATE)).drop("o_orderstatus")
    incoming = (
        orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE))
        .drop("o_totalprice")
        .withColumn("o_custkey", F.col("o_custkey").cast("int"))
    )
    return evolve_append(base, incoming)


def evolve_table_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows with the year as SMALLINT, then rows with a new column and the year as INT: the stored table widens."""
    db = _run_database(spark)
    orders = table(spark, sf_dir, "orders").withColumn("o_year", F.year("o_orderdate"))
    base = orders.filter(F.col("o_orderdate") < ntz(SPLIT_DATE)).drop("o_orderstatus")
    publish_table(base.withColumn("o_year", F.col("o_year").cast("smallint")), f"{db}.orders")
    incoming = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE)).drop("o_totalprice")
    return evolve_table(incoming.withColumnRenamed("o_custkey", "O_CUSTKEY"), f"{db}.orders")


def snapshot_as_of_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return snapshot_as_of(events, ["user_id"], ["ts", "event_id"], AS_OF, deleted="event_type = 'error'")


def retain_history_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return retain_history(events, ["user_id"], ["ts", "event_id"], hours=168)


def retain_in_place_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, trimmed twice: the second run folds the first one's baseline with two more days."""
    events = table(spark, sf_dir, "events")
    path = scratch_path(spark, "daily_events")
    events.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.partitionBy("day").parquet(path)
    for hours in (168 + 48, 168):
        retain_in_place(spark, path, ["user_id"], ["ts", "event_id"], hours=hours)
    return read_evolved(spark, path, ["day"]).select(*events.columns)


def optimized_write_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "optimized_orders")
    optimized_write(orders, path, ["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


def _month(column: str):
    """'01' to '12', NULL in December: text that must not be read as a number, and a NULL partition."""
    return F.nullif(F.date_format(column, "MM"), F.lit("12"))


def compact_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    small = scratch_path(spark, "lineitem_small")
    out = scratch_path(spark, "lineitem_compact")
    # The input as it arrives: many small files per partition value.
    dealt(lineitem, 40, lineitem.count()).write.partitionBy("l_returnflag").parquet(small)
    compact(spark, small, out, partition_by=["l_returnflag"])
    return spark.read.schema(lineitem.schema).parquet(out).select(*lineitem.columns)


def compact_in_place_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem").withColumn("l_month", _month("l_shipdate"))
    path = scratch_path(spark, "lineitem_table")
    rows = lineitem.count()
    # R and A arrive in many small files; N in few.
    by_month = lambda flag, *n: dealt(lineitem.filter(flag), *n).write.mode("append").partitionBy("l_month").parquet(path)
    by_month(F.col("l_returnflag") != "N", 8, rows)
    by_month(F.col("l_returnflag") == "N", 1, rows, 2 * ROWS_PER_TASK)
    compact_in_place(spark, path, ["l_month"])
    return spark.read.schema(lineitem.schema).parquet(path).select(*lineitem.columns)


#: Rows before this day were written by an older version of the job: fewer columns, narrower types.
OLD_FILES_END = "1996-01-01 00:00:00"


def compact_evolved_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files without the line status and with 32-bit keys, beside new ones, in the same partitions."""
    lineitem = table(spark, sf_dir, "lineitem").withColumn("l_month", _month("l_shipdate"))
    path = scratch_path(spark, "lineitem_evolved")
    rows = lineitem.count()
    old = lineitem.filter(F.col("l_shipdate") < ntz(OLD_FILES_END)).drop("l_linestatus").withColumn("l_orderkey", F.col("l_orderkey").cast("int"))
    dealt(old, 4, rows).write.partitionBy("l_month").parquet(path)
    new = lineitem.filter(F.col("l_shipdate") >= ntz(OLD_FILES_END))
    dealt(new, 4, rows).write.mode("append").partitionBy("l_month").parquet(path)
    compact_in_place(spark, path, ["l_month"])
    return read_evolved(spark, path, ["l_month"]).select(*lineitem.columns)


def merge_evolved_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files without priorities and with 32-bit keys; the batch also brings a new column."""
    orders = table(spark, sf_dir, "orders").withColumn("o_month", _month("o_orderdate"))
    path = scratch_path(spark, "orders_evolved")
    old = orders.filter(F.col("o_orderdate") < ntz(OLD_FILES_END)).drop("o_orderpriority")
    overwrite_partitions(old.withColumn("o_orderkey", F.col("o_orderkey").cast("int")), path, ["o_month"])
    new = orders.filter((F.col("o_orderdate") >= ntz(OLD_FILES_END)) & (F.col("o_orderdate") < ntz(MERGE_TARGET_END)))
    overwrite_partitions(new, path, ["o_month"], mode="append")
    source = orders.filter(F.col("o_orderdate") >= ntz(SPLIT_DATE)).withColumn("o_restated", F.col("o_totalprice") + 1)
    merge_into_path(spark, path, source, ["o_orderkey"], ["o_month"], delete_when=F.col("o_orderstatus") == "F", evolve=["o_restated"])
    return read_evolved(spark, path, ["o_month"]).select(*orders.columns, "o_restated")


def overwrite_partitions_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "orders_by_status")
    overwrite_partitions(orders, path, ["o_orderstatus"])
    restated = orders.filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < ntz(MERGE_TARGET_END))
    ).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    overwrite_partitions(restated, path, ["o_orderstatus"])
    return spark.read.schema(orders.schema).parquet(path).select(*orders.columns)


def overwrite_table_partitions_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _run_database(spark)
    orders = table(spark, sf_dir, "orders")
    name = f"{db}.orders_by_status"
    publish_table(orders, name, partition_by=["o_orderstatus"])
    restated = orders.filter(
        (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < ntz(MERGE_TARGET_END))
    ).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return overwrite_table_partitions(restated, name).select(*orders.columns)


def replace_table_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace a partitioned table by a plan that reads it; it stays partitioned (``layout`` says so)."""
    db = _run_database(spark)
    orders = table(spark, sf_dir, "orders")
    name = f"{db}.orders_by_status"
    publish_table(orders, name, partition_by=["o_orderstatus"])
    raised = spark.table(name).withColumn("o_totalprice", F.col("o_totalprice") + 1)
    back = replace_table(raised, name)
    return back.select(*orders.columns, F.lit(",".join(table_layout(spark, name)[0])).alias("layout"))


def fold_batches_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("batch", F.weekday("ts"))
    return fold_batches(events, ["user_id"], "batch", ["ts", "event_id"])


# --- R: file work as Spark jobs ---------------------------------------------------


def _event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_logs(event_log_lines(table(spark, sf_dir, "events")))


def _unplaced(logs: DataFrame) -> DataFrame:
    return logs.drop(*PLACE_COLUMNS)


def parse_logs_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unplaced(_event_logs(spark, sf_dir))


def parse_log_files_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files read back: each line has the time of the record it belongs to, stack traces too."""
    lines = event_log_lines(table(spark, sf_dir, "events"))
    path = scratch_path(spark, "daily_log_files")
    # One folder of rolled log files per day; ``source`` becomes the folder's day.
    by_day = lines.withColumn("day", F.to_date("ts_event")).repartition("day").sortWithinPartitions("day", "seq")
    by_day.select("value", "day").write.partitionBy("day").text(path)
    parsed = _unplaced(attach_records(parse_logs(read_log_lines(spark, path))))
    return parsed.withColumn("source", F.regexp_extract(F.col("source"), r"/day=([^/]+)/[^/]*$", 1))


def filter_severity_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _unranked = filter_severity(_event_logs(spark, sf_dir), "WARN")
    return _unplaced(kept)


def filter_severity_unranked_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    _kept, unranked = filter_severity(_event_logs(spark, sf_dir), "WARN")
    return _unplaced(unranked)


def error_tail_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unplaced(error_tail(_event_logs(spark, sf_dir), n=10))


def error_verdict_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A verdict needs the text only: count on the raw lines, no parse.
    lines = event_log_lines(table(spark, sf_dir, "events"))
    return error_verdict(lines.select("source", F.col("value").alias("raw")))


def write_daily_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes, days before and after the middle of the month: the second leaves the first's lines alone."""
    logs = with_day(_event_logs(spark, sf_dir), moved=True)
    path = scratch_path(spark, "daily_logs")
    middle = F.lit(AS_OF).cast("timestamp_ntz").cast("date")
    write_daily(logs.filter(F.col("day") < middle), path)
    write_daily(logs.filter(~(F.col("day") < middle) | F.col("day").isNull()), path)
    back = spark.read.schema(logs.schema).parquet(path)
    # Reported as the day's midnight (TIMESTAMP), the type the test tables use for dates.
    return back.groupBy(F.col("day").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def write_daily_files_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolled log files read in their splits and written by day: lines per day, and those that have no time of their own."""
    lines = event_log_lines(table(spark, sf_dir, "events"))
    incoming, path = scratch_path(spark, "rolled_logs"), scratch_path(spark, "daily_logs")
    by_day = lines.withColumn("day", F.to_date("ts_event")).repartition("day").sortWithinPartitions("day", "seq")
    by_day.select("value", "day").write.partitionBy("day").text(incoming)
    write_daily(parse_logs(read_log_lines(spark, incoming)), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("day").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts").isNull()).alias("n_traces"))


def keep_newest_days_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the day-partitioned table that ``write_daily`` leaves: a partition filter."""
    logs = with_day(_event_logs(spark, sf_dir), moved=True)
    path = scratch_path(spark, "daily_logs")
    write_daily(logs, path)
    return _unplaced(keep_newest_days(spark.read.schema(logs.schema).parquet(path), n=7).drop("day"))


def follow_logs_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_log_lines(table(spark, sf_dir, "events"))
    incoming = scratch_path(spark, "rolled_logs")
    # Rolled files, one folder per day, as a log roller leaves them.
    lines.select("value", F.to_date("ts_event").alias("day")).write.partitionBy("day").text(incoming)
    out, checkpoint = scratch_path(spark, "log_counts"), scratch_path(spark, "log_counts_ckpt")
    query = run_to_path(follow_logs(spark, incoming), out, checkpoint, output_mode="complete")
    query.awaitTermination()
    return spark.read.parquet(out)


def follow_records_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three logs in rolled files, cut between records and their traces; the later files come to a restarted query."""
    events = table(spark, sf_dir, "events")
    lines = event_log_lines(events).withColumn("log", F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("long"), F.lit(3)))
    # ``seq`` is twice the event's number, one more for its trace: a file ends below the last record's first line.
    count, low, high = events.agg(F.count("event_id"), F.coalesce(F.min("event_id"), F.lit(0)) * 2, F.coalesce(F.max("event_id"), F.lit(0)) * 2 + 1).first()
    width = rolled_files(count, high - low + 1)
    lines = lines.withColumn("roll", F.floor((F.col("seq") - low + 1) / width))
    half = (high - low + 1) // width // 2
    incoming = scratch_path(spark, "rolled_records")
    out, checkpoint = scratch_path(spark, "record_counts"), scratch_path(spark, "record_counts_ckpt")
    by_file = lines.repartition("log", "roll").sortWithinPartitions("log", "roll", "seq")
    # A record of a day to come closes all windows but its own, which stays open.
    beat = spark.range(1).select(F.lit("[2200-01-01 00:00:00] [INFO] end").alias("value"), F.lit(3).alias("log"), F.lit(0).alias("roll"))
    for part in (by_file.filter(F.col("roll") <= half), by_file.filter(F.col("roll") > half), beat):
        part.select("value", "log", "roll").write.mode("append").partitionBy("log", "roll").text(incoming)
        stream = follow_records(
            spark,
            incoming,
            series=lambda path: F.regexp_extract(path, r"/log=(\d+)/", 1),
            place=lambda path: F.lpad(F.regexp_extract(path, r"/roll=(\d+)/", 1), 12, "0"),
        )
        run_to_path(stream, out, checkpoint).awaitTermination()
    counts = spark.read.parquet(out)
    return counts.groupBy("window_start", "window_end", "level").agg(F.sum("n").alias("n"))


def ingest_daily_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of files, with a compaction of the output between them."""
    lines = event_log_lines(table(spark, sf_dir, "events"))
    incoming = scratch_path(spark, "rolled_logs")
    out, checkpoint = scratch_path(spark, "ingested_logs"), scratch_path(spark, "ingested_logs_ckpt")
    by_day = lines.withColumn("day", F.to_date("ts_event")).repartition("day").sortWithinPartitions("day", "seq")
    middle = F.lit(AS_OF).cast("timestamp_ntz").cast("date")
    for part in (F.col("day") < middle, F.col("day") >= middle):
        by_day.filter(part).select("value", "day").write.mode("append").partitionBy("day").text(incoming)
        ingest_daily(spark, incoming, out, checkpoint).awaitTermination()
        compact_ingested(spark, out)
    back = spark.read.parquet(out)
    return back.groupBy(F.col("day").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"))


def extract_settings_xml_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "settings_xml")
    key = F.col("o_orderkey").cast("string")
    props = F.array(
        F.struct(F.concat(F.lit("order."), key, F.lit(".status")).alias("name"), F.col("o_orderstatus").alias("value")),
        F.struct(
            F.concat(F.lit("order."), key, F.lit(".password")).alias("name"),
            F.col("o_totalprice").cast("string").alias("value"),
        ),
    )
    (
        orders.select("o_orderpriority", F.inline(props))
        .write.format("xml")
        .option("rootTag", "configuration")
        .option("rowTag", "property")
        .partitionBy("o_orderpriority")
        .save(path)
    )
    return extract_settings(spark, path, "xml", keep=("o_orderpriority",)).drop("file")


def extract_settings_kv_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "settings_kv")
    key = F.col("c_custkey").cast("string")
    lines = F.array(
        F.concat(F.lit("# customer "), key),
        F.concat(F.lit("CUSTOMER_"), key, F.lit("_NAME="), F.col("c_name")),
        F.concat(F.lit("export CUSTOMER_"), key, F.lit("_TOKEN=\""), F.col("c_acctbal").cast("string"), F.lit("\"")),
        F.lit(""),
    )
    customer.select("c_mktsegment", F.explode(lines).alias("value")).write.partitionBy("c_mktsegment").text(path)
    return extract_settings(spark, path, "kv", keep=("c_mktsegment",)).drop("file")


def extract_settings_conf_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key value`` files in a folder for each host, two levels deep."""
    customer = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "settings_conf")
    key = F.col("c_custkey").cast("string")
    host = F.concat(F.lit("host-"), F.col("c_nationkey").cast("string"))
    lines = F.array(F.concat(F.lit("customer."), key, F.lit(".name  "), F.col("c_name")), F.concat(F.lit("customer."), key, F.lit(".api_key "), key))
    text = customer.select(host.alias("host"), F.explode(lines).alias("value"), F.lit("conf").alias("part"))
    text.write.partitionBy("host", "part").text(path)
    return extract_settings(spark, path, "conf", group="folder", keep=("host",)).drop("file")


def settings_drift_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intended settings (XML) against rendered ones (KEY=VALUE), in a folder for each priority, read back from
    files: differences in plain values and in passwords, which aren't shown."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    intended, rendered = scratch_path(spark, "intended_xml"), scratch_path(spark, "rendered_kv")
    named = lambda status, password: F.inline(
        F.array(
            F.struct(F.concat(F.lit("order."), key, F.lit(".status")).alias("name"), status.alias("value")),
            F.struct(F.concat(F.lit("order."), key, F.lit(".password")).alias("name"), password.alias("value")),
        )
    )
    secret = F.concat(F.lit("pw-"), F.col("o_custkey").cast("string"))
    (
        orders.select("o_orderpriority", named(F.col("o_orderstatus"), secret))
        .write.format("xml")
        .option("rootTag", "configuration")
        .option("rowTag", "property")
        .partitionBy("o_orderpriority")
        .save(intended)
    )
    # Rendering drift: orders before the reconcile window are missing, one priority renders its status in lower
    # case, and another has a new password.
    drifted = F.when(F.col("o_orderpriority") == "2-HIGH", F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    changed = F.when(F.col("o_orderpriority") == "5-LOW", F.concat(secret, F.lit("x"))).otherwise(secret)
    (
        orders.filter(F.col("o_orderdate") >= ntz(RECONCILE_ACTUAL_FROM))
        .select("o_orderpriority", named(drifted, changed))
        .select("o_orderpriority", F.concat_ws("=", "name", "value").alias("value"))
        .write.partitionBy("o_orderpriority")
        .text(rendered)
    )
    return compare_settings(spark, intended, "xml", rendered, "kv", keep=("o_orderpriority",))


def _reconcile_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders")
    expected = orders.filter(F.col("o_orderdate") < ntz(RECONCILE_EXPECTED_TO))
    actual = (
        orders.filter(F.col("o_orderdate") >= ntz(RECONCILE_ACTUAL_FROM))
        .withColumn(
            "o_totalprice", F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_totalprice"))
        )
        .withColumn(
            "o_orderstatus",
            F.when(F.col("o_orderpriority") == "1-URGENT", F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus")),
        )
    )
    return expected, actual


def reconcile_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(*_reconcile_sides(spark, sf_dir), ["o_orderkey"])


def reconcile_ranges_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_ranges(*_reconcile_sides(spark, sf_dir), ["o_orderkey"])


def reconcile_summary_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile_summary(reconcile_case(spark, sf_dir))


CASES: dict[str, Case] = {
    "publish_managed": publish_managed,
    "publish_external": publish_external_case,
    "append_rows": append_rows_case,
    "merge_upsert": merge_upsert_case,
    "merge_into_path": merge_into_path_case,
    "merge_colocated": merge_colocated_case,
    "merge_table": merge_table_case,
    "evolve_append": evolve_append_case,
    "evolve_table": evolve_table_case,
    "snapshot_as_of": snapshot_as_of_case,
    "retain_history": retain_history_case,
    "retain_in_place": retain_in_place_case,
    "optimized_write": optimized_write_case,
    "compact": compact_case,
    "compact_in_place": compact_in_place_case,
    "compact_evolved": compact_evolved_case,
    "merge_evolved": merge_evolved_case,
    "overwrite_partitions": overwrite_partitions_case,
    "overwrite_table_partitions": overwrite_table_partitions_case,
    "replace_table": replace_table_case,
    "fold_batches": fold_batches_case,
    "parse_logs": parse_logs_case,
    "parse_log_files": parse_log_files_case,
    "filter_severity": filter_severity_case,
    "filter_severity_unranked": filter_severity_unranked_case,
    "error_tail": error_tail_case,
    "error_verdict": error_verdict_case,
    "write_daily": write_daily_case,
    "write_daily_files": write_daily_files_case,
    "keep_newest_days": keep_newest_days_case,
    "follow_logs": follow_logs_case,
    "follow_records": follow_records_case,
    "ingest_daily": ingest_daily_case,
    "extract_settings_xml": extract_settings_xml_case,
    "extract_settings_kv": extract_settings_kv_case,
    "extract_settings_conf": extract_settings_conf_case,
    "reconcile": reconcile_case,
    "reconcile_ranges": reconcile_ranges_case,
    "settings_drift": settings_drift_case,
    "reconcile_summary": reconcile_summary_case,
}
