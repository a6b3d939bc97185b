"""Folders of partitioned Parquet tables: partition names as text, file listing, own sessions.

A partition's value is the text in its folder name.  Read with Spark's type inference, ``p=01`` becomes
1 and is written back as another folder, so the path jobs here read partition columns as strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

AS_TEXT = {"spark.sql.sources.partitionColumnTypeInference.enabled": "false"}


def own_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A session on the same cluster with this one's settings, then ``settings``: jobs that run in
    it can't change what other jobs of ``spark`` see."""
    session = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    return session


def in_session(df: DataFrame, settings: dict[str, str]) -> DataFrame:
    """The same plan, to be run under ``settings`` in a session of its own."""
    name = f"stevedore_{uuid.uuid4().hex}"
    df.createGlobalTempView(name)
    try:
        return own_session(df.sparkSession, settings).table(f"global_temp.{name}")
    finally:
        df.sparkSession.catalog.dropGlobalTempView(name)


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, system = _path(spark, path)
    return system.exists(hadoop)


def holds_data(spark: SparkSession, path: str) -> bool:
    """Whether a file that readers see lies right in the folder."""
    hadoop, system = _path(spark, path)
    return system.exists(hadoop) and any(f.isFile() and f.getPath().getName()[0] not in "._" for f in system.listStatus(hadoop))


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path`` (none where there is no such path)."""
    hadoop, system = _path(spark, path)
    return [f.getPath().getName() for f in system.listStatus(hadoop) if f.isDirectory()] if system.exists(hadoop) else []


def delete(spark: SparkSession, path: str) -> None:
    hadoop, system = _path(spark, path)
    system.delete(hadoop, True)


def reject_sink_log(spark: SparkSession, path: str, what: str) -> None:
    """Readers of a folder that a file sink wrote follow the sink's log, which names its files: files
    replaced behind it are lost to them."""
    if exists(spark, f"{path.rstrip('/')}/_spark_metadata"):
        raise ValueError(f"{what}: {path} is the output of a streaming file sink; its log would name files that are gone")


def folder(spark: SparkSession, partition_by: Sequence[str], values: Sequence[str | None]) -> str:
    """The folder of a partition below its table, escaped as Spark does (NULL and '' share one)."""
    util = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    return "/".join(util.getPartitionPathString(c, v) for c, v in zip(partition_by, values, strict=True))


def partition_text(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``df`` with its partition columns as the text of their folder names ('' as NULL)."""
    return df.withColumns({c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in partition_by})


def text_schema(schema: str | T.StructType, partition_by: Sequence[str]) -> T.StructType:
    """The schema with its partition columns as strings."""
    given = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return T.StructType([T.StructField(f.name, T.StringType()) if f.name in partition_by else f for f in given.fields])


def read_text_partitions(
    spark: SparkSession,
    path: str,
    partition_by: Sequence[str],
    folders: Sequence[str] | None = None,
    schema: str | T.StructType | None = None,
) -> DataFrame:
    """The table at ``path`` (or only these folders of it) with its partition columns as strings.

    ``folders`` are opened one by one: the rest of the table isn't even listed.
    """
    reader = own_session(spark, AS_TEXT).read.option("basePath", path)
    if schema:
        reader = reader.schema(text_schema(schema, partition_by))
    df = reader.parquet(*([path] if folders is None else [f"{path.rstrip('/')}/{f}" for f in folders]))
    if missing := [c for c in partition_by if c not in df.columns]:
        raise ValueError(f"partition columns {missing} not in {df.columns}")
    return df
