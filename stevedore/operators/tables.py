"""Catalog tables and file layouts: publish, append by name, partition overwrite,
optimized write and compaction (all Parquet)."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stevedore.functions.types import check_store
from stevedore.operators._paths import in_session, reject_sink_log, text_schema
from stevedore.operators._schemas import Layout, layout, list_files, read_evolved, read_layout, unescaped


def _table_writer(df: DataFrame, mode: str, partition_by: Sequence[str], bucket_by):
    if bucket_by:
        # One task for each bucket, so one file for each bucket (and partition value).
        df = df.repartition(int(bucket_by[0]), *bucket_by[1])
    elif partition_by:
        # Each task then writes few partitions (not one file per task and partition).
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format("parquet").mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        n, cols = bucket_by
        writer = writer.bucketBy(int(n), *cols).sortBy(*cols)
    return writer


def publish_table(
    df: DataFrame,
    name: str,
    *,
    mode: str = "append",
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> DataFrame:
    """Write ``df`` to the managed table ``name`` (created on first write) and return the table.

    ``bucket_by=(n, cols)`` stores the table hashed into ``n`` buckets on ``cols``:
    joins and aggregations on ``cols`` between tables bucketed alike read it
    co-partitioned, with no shuffle.
    """
    _table_writer(df, mode, partition_by, bucket_by).saveAsTable(name)
    return df.sparkSession.table(name)


def publish_external(
    df: DataFrame,
    name: str,
    path: str,
    *,
    mode: str = "append",
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> DataFrame:
    """As ``publish_table``, with the data at ``path``; dropping the table keeps the files."""
    _table_writer(df, mode, partition_by, bucket_by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def table_layout(spark: SparkSession, name: str) -> tuple[list[str], tuple[int, list[str]] | None, bool]:
    """Partition columns, bucketing and whether the table is external, as the catalog has them."""
    partition_by = [c.name for c in spark.catalog.listColumns(name) if c.isPartition]
    described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    buckets = int(described.get("Num Buckets") or 0)
    columns = [c.strip().strip("`") for c in described.get("Bucket Columns", "").strip("[]").split(",") if c.strip()]
    return partition_by, (buckets, columns) if buckets else None, described.get("Type") == "EXTERNAL"


def _definition(spark: SparkSession, name: str) -> tuple[dict[str, str], str | None, dict[str, str]]:
    """Properties, comment and column comments of a table."""
    properties = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    comments = {c.name: c.description for c in spark.catalog.listColumns(name) if c.description}
    return properties, spark.catalog.getTable(name).description, comments


def _define(spark: SparkSession, name: str, properties: dict[str, str], comment: str | None, columns: dict[str, str]) -> None:
    """Give a table what ``_definition`` said of another, as far as it lacks it."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    now, said, described = _definition(spark, name)
    if added := {k: v for k, v in properties.items() if k not in now and k != "transient_lastDdlTime"}:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ({', '.join(f'{quoted(k)} = {quoted(v)}' for k, v in added.items())})")
    if comment and comment != said:
        spark.sql(f"COMMENT ON TABLE {name} IS {quoted(comment)}")
    for column in {c.name for c in spark.catalog.listColumns(name)} & columns.keys():
        if described.get(column) != columns[column]:
            spark.sql(f"ALTER TABLE {name} ALTER COLUMN `{column}` COMMENT {quoted(columns[column])}")


def replace_table(
    df: DataFrame,
    name: str,
    *,
    partition_by: Sequence[str] | None = None,
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> DataFrame:
    """Overwrite the table ``name`` with ``df``, also when ``df`` is computed from it.

    The table keeps its partitioning and bucketing unless others are given, its properties, its comment and those of its
    columns.  A plain managed table
    is written under another name first, which then takes the place of the old one (drop
    and rename, catalog operations): a write that fails leaves the old table as it was.  The catalog
    ties the partitions of a partitioned table, and an external one, to their folders, so the
    rows of those are checkpointed first (a plan that fails leaves the table as it was) and then copied: over
    the same table if its schema and layout stay, else by dropping and creating it.
    """
    from stevedore.session import scratch_root

    spark = df.sparkSession
    known = spark.catalog.tableExists(name)
    found_partitions, found_buckets, external = table_layout(spark, name) if known else ([], None, False)
    definition = _definition(spark, name) if known else ({}, None, {})
    wanted = list(found_partitions if partition_by is None else partition_by)
    buckets = bucket_by or found_buckets
    if not wanted and not external:
        database, _, short = name.rpartition(".")
        fresh = f"{database}.{short}_{uuid.uuid4().hex[:12]}" if database else f"{short}_{uuid.uuid4().hex[:12]}"
        _table_writer(df, "errorifexists", (), buckets).saveAsTable(fresh)
        _define(spark, fresh, *definition)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.sql(f"ALTER TABLE {fresh} RENAME TO {name}")
        spark.catalog.refreshTable(name)
        return spark.table(name)
    location = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").first() if external else None
    scratch_root(spark)  # makes sure a checkpoint folder is set
    frozen = df.checkpoint(eager=True)
    old = {f.name: f.dataType for f in spark.table(name).schema.fields} if known else None
    if old == {f.name: f.dataType for f in df.schema.fields} and (wanted, buckets) == (found_partitions, found_buckets) and not buckets:
        names = spark.table(name).columns
        frozen.select(*names).hint("rebalance", *wanted).write.insertInto(name, overwrite=True)
    else:
        writer = _table_writer(frozen, "overwrite", wanted, buckets)
        (writer.option("path", location.data_type) if location else writer).saveAsTable(name)
        _define(spark, name, *definition)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_rows(df: DataFrame, table: str) -> DataFrame:
    """Append ``df`` to an existing table, matching columns **by name** (upper or lower case alike).

    Types are checked on the schemas before anything runs: a column that would have to be
    narrowed (BIGINT into INT, DOUBLE into INT, text into a number) raises TypeError.
    """
    spark = df.sparkSession
    schema = spark.table(table).schema
    names = schema.names
    have = {c.lower(): c for c in df.columns}
    missing = [c for c in names if c.lower() not in have]
    extra = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    if missing or extra:
        raise ValueError(f"append_rows: columns missing {missing}, not in table {extra}")
    check_store(df.schema, schema, "append_rows")
    # insertInto matches by position, so put the columns in the table's order first.
    df.select(*[F.col(f"`{have[n.lower()]}`").cast(schema[n].dataType).alias(n) for n in names]).write.insertInto(table)
    return spark.table(table)


@contextlib.contextmanager
def session_conf(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Set session confs for the duration of one write, then restore them."""
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def overwrite_partitions(
    df: DataFrame, path: str, partition_by: Sequence[str], *, mode: str = "overwrite", rebalance: bool = True
) -> None:
    """Write ``df`` under ``path`` partitioned by ``partition_by``.

    ``mode="overwrite"`` replaces only the partitions present in ``df`` (dynamic
    partition overwrite); ``mode="append"`` adds files.  Rows are rebalanced on the
    partition columns first, so each task writes few partitions and AQE splits a
    partition value that holds a large share of the rows over several tasks.
    ``rebalance=False`` copies files already laid out (staged output) as they are.
    """
    if not partition_by:
        raise ValueError("overwrite_partitions needs partition columns")
    reject_sink_log(df.sparkSession, path, "overwrite_partitions")
    if rebalance:
        df = df.hint("rebalance", *partition_by)
    (
        df.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def overwrite_table_partitions(df: DataFrame, table: str) -> DataFrame:
    """Replace, in a partitioned catalog table, only the partitions present in ``df``.

    Columns match by name, types as in ``append_rows``.  New partitions enter the catalog with
    the write.  The overwrite mode is set in a session of the write's own.
    """
    spark = df.sparkSession
    schema = spark.table(table).schema
    partition_by, _, _ = table_layout(spark, table)
    if not partition_by:
        raise ValueError(f"overwrite_table_partitions: {table} has no partition columns")
    have = {c.lower(): c for c in df.columns}
    if set(have) != {n.lower() for n in schema.names}:
        raise ValueError(f"overwrite_table_partitions: columns {df.columns} are not those of {table}: {schema.names}")
    check_store(df.schema, schema, "overwrite_table_partitions")
    ordered = df.select(*[F.col(f"`{have[n.lower()]}`").cast(schema[n].dataType).alias(n) for n in schema.names])
    settings = {"spark.sql.sources.partitionOverwriteMode": "dynamic"}
    in_session(ordered.hint("rebalance", *partition_by), settings).write.insertInto(table, overwrite=True)
    spark.catalog.refreshTable(table)
    return spark.table(table)


def _sized(target: str | int) -> dict[str, str]:
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target),
    }


def optimized_write(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    *,
    target: str = "128m",
    mode: str = "overwrite",
) -> None:
    """Write few, large files: shuffle by partition value, sized by AQE.

    ``REBALANCE`` on the partition columns plus ``advisoryPartitionSizeInBytes`` lets
    AQE merge small shuffle partitions and split large ones to about ``target`` of
    shuffle data each.  Shuffle bytes are not Parquet bytes, so files come out near,
    not at, the target.  The settings hold in a session of this write only.
    """
    writer = in_session(df.hint("rebalance", *partition_by), _sized(target)).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def _norm(path: str) -> str:
    return path.rstrip("/").removeprefix("file:")


def _needed(target_bytes: int):
    return F.greatest(F.lit(1), F.ceil(F.col("bytes") / F.lit(float(target_bytes)))).cast("long")


#: Folders whose scans make up one job: a plan of this many scans is still quickly made.
FOLDERS_PER_JOB = 256


def packing(target_bytes: int) -> dict[str, str]:
    """Whole files are packed into scan tasks of ``target_bytes``, and a task writes what it reads, in that order."""
    return {
        "spark.sql.files.maxPartitionBytes": f"{target_bytes}b",
        "spark.sql.files.openCostInBytes": "0",
        "spark.sql.files.minPartitionNum": "1",
        "spark.sql.maxConcurrentOutputFileWriters": "16",  # no sort by partition value before writing
        "spark.sql.unionOutputPartitioning": "false",  # or one-task scans would all run in one task
    }


def union(parts: list[DataFrame]) -> DataFrame:
    while len(parts) > 1:
        parts = [a.unionAll(b[0]) if b else a for a, *b in (parts[i : i + 2] for i in range(0, len(parts), 2))]
    return parts[0]


def _packed(how: Layout, root: str, folders: list[tuple[str, int]]) -> DataFrame:
    """The rows of these folders, each folder's in its own number of tasks; nothing is shuffled."""
    by_folder: dict[str, list[str]] = {}
    for names, _ in how.files or []:
        for name in names:
            by_folder.setdefault(name.rpartition("/")[0], []).append(name)
    scans = []
    for at, tasks in folders:
        rows = read_layout(how, root, by_folder[at] if how.files else [at])
        scans.append(rows.coalesce(tasks))
    return union(scans)


def _rewrite(spark: SparkSession, files: DataFrame, root: str, pcols: list[str], target_bytes: int, folders: list[tuple[str, int]], schema, write) -> None:
    if deeper := [f for f, _ in folders if pcols and not all(n.startswith(f"{c}=") for c, n in zip(pcols, f.rsplit("/", len(pcols))[1:], strict=False))]:
        raise ValueError(f"{root} has other partitions than {pcols}: {deeper[0]}")
    how = layout(spark, root, pcols, files)
    if schema:
        how = Layout(how.session, text_schema(schema, pcols), None)
    for key, value in packing(target_bytes).items():
        how.session.conf.set(key, value)  # the session of ``layout``, nobody else's
    for at in range(0, len(folders), FOLDERS_PER_JOB):
        write(_packed(how, root, folders[at : at + FOLDERS_PER_JOB]).write, at == 0)


def _folder_sizes(files: DataFrame, target_bytes: int) -> DataFrame:
    sizes = files.groupBy("folder").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
    return sizes.select("folder", "files", _needed(target_bytes).alias("needed"))


def compact(
    spark: SparkSession,
    path_in: str,
    path_out: str,
    *,
    partition_by: Sequence[str] = (),
    target_bytes: int = 128 << 20,
    mode: str = "errorifexists",
    schema: str | None = None,
) -> int:
    """Rewrite the Parquet data at ``path_in`` into files of about ``target_bytes`` at ``path_out``.

    Rows are unchanged (as a multiset, and in their order within a file), and so are partition values: they are read and
    written as the text of their folder names.  Files may differ in schema: the output has every column, under
    the schema that holds them all (``_schemas``; ``schema`` overrides it).

    Nothing is shuffled.  A folder's whole files are packed into scan tasks by their sizes in the listing, into at
    most as many tasks as its bytes need files, and each task writes one file.  Returns the number of files of
    ``target_bytes`` that the input's bytes need; at most as many are written.  One row for each folder comes to the driver.

    ``path_out`` must differ from ``path_in``: the job reads while it writes.
    Swapping the compacted copy in is the caller's step.
    """
    if _norm(path_in) == _norm(path_out):
        raise ValueError("compact: path_out must differ from path_in")
    pcols, root = list(partition_by), path_in.rstrip("/")
    reject_sink_log(spark, path_in, "compact")
    files = list_files(spark, [root])
    if not pcols:
        files = files.withColumn("folder", F.lit(root))
    folders = [(r.folder, r.needed) for r in _folder_sizes(files, target_bytes).orderBy("folder").collect()]
    if not folders:
        return 0

    def write(writer, first: bool) -> None:
        writer.mode(mode if first else "append").partitionBy(*pcols).parquet(path_out)

    _rewrite(spark, files, root, pcols, target_bytes, folders, schema, write)
    return sum(needed for _, needed in folders)


def compact_in_place(
    spark: SparkSession,
    path: str,
    partition_by: Sequence[str],
    *,
    target_bytes: int = 128 << 20,
    schema: str | None = None,
) -> int:
    """Compact, in place, only the partitions of ``path`` that hold more files than needed.

    A partition is rewritten when its file count exceeds ``ceil(bytes / target_bytes)``, by the
    file listing; the others are not read or touched.  As ``compact`` does, without a shuffle and without losing a column of files that
    differ.  The new files are written once, by dynamic partition overwrite: what a job read is replaced only when
    all of its tasks have finished.  Returns the number of partitions rewritten.
    """
    pcols, root = list(partition_by), path.rstrip("/")
    if not pcols:
        raise ValueError("compact_in_place needs partition columns; use compact for a whole folder")
    reject_sink_log(spark, path, "compact_in_place")
    listed = list_files(spark, [root])
    # One row for each partition to rewrite comes to the driver: its folder's name, as in any listing.
    found = _folder_sizes(listed, target_bytes).filter("files > needed").orderBy("folder").collect()
    folders = [(r.folder, r.needed) for r in found]
    if not folders:
        return 0

    def write(writer, first: bool) -> None:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*pcols).parquet(path)

    files = list_files(spark, [unescaped(f) for f, _ in folders])
    _rewrite(spark, files, root, pcols, target_bytes, folders, schema, write)
    return len(folders)
