"""Tables whose files don't all have one schema: a survey of the footers, and reading under the schema that holds them all.

Spark reads a folder under the schema of one file, so columns that only other files have vanish, and Parquet's own merging
refuses INT with BIGINT. Here the footers are read by tasks (a footer each, no data pages), files are grouped by their own
schema, and each group is read under it and cast to the evolved schema (``functions.types``).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.functions.types import conform, evolved_schema
from stevedore.operators._paths import AS_TEXT, own_session, read_text_partitions, text_schema


class Group(NamedTuple):
    """Files of one schema, the oldest first, and that schema as Spark noted it in them (None: not written by Spark)."""

    mark: str | None
    files: list[str]
    noted: str | None


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, folder, length, modified) of the Parquet files below ``paths``, from a listing: no file is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.load(list(paths)).select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "length", F.col("modificationTime").alias("modified")
    )


def _open(path: str):
    """A file of any store that Arrow can open, by the path as Spark gives it (not escaped)."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return pa.OSFile("/" + rest.lstrip("/"), "rb")
    from pyarrow import fs

    root = re.match(r"[^:]+://[^/]*", path)[0]
    system, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", root))
    return system.open_input_file(base.rstrip("/") + path[len(root) :])


def _footer(path: str) -> tuple[str | None, str | None]:
    """What two files have in common if they have one schema (None where the store can't be reached from here), and the schema
    as Spark noted it."""
    import pyarrow.parquet as pq

    try:
        with _open(path) as f:
            footer = pq.read_metadata(f)
    except (OSError, ImportError, NotImplementedError, pa.ArrowException):
        return None, None
    types = str(footer.schema).partition("\n")[2]
    noted = (footer.metadata or {}).get(b"org.apache.spark.sql.parquet.row.metadata")
    return hashlib.sha256(types.encode() + b"\0" + (noted or b"")).hexdigest(), noted.decode() if noted else None


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_footer(p) for p in batch.column("path").to_pylist()]
        columns = [pa.array([f[i] for f in found], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "mark", "noted"])


def survey(files: DataFrame) -> list[Group]:
    """The schemas among ``files`` (of ``list_files``), that of the oldest file first, with the names of their files.

    One job: the tasks of the listing's scan (as many as the files' bytes make) read the footers.
    """
    texts = [T.StructField(c, T.StringType()) for c in ("mark", "noted")]
    read = files.mapInArrow(_footers, T.StructType([*files.schema.fields, *texts]))
    by_mark = read.groupBy("mark").agg(F.first("noted").alias("noted"), F.collect_list(F.struct("modified", "path")).alias("files"))
    rows = [(sorted((f.modified, f.path) for f in r.files), r) for r in by_mark.collect()]
    return [Group(r.mark, [path for _, path in names], r.noted) for names, r in sorted(rows, key=lambda x: x[0][0])]


def unescaped(path: str) -> str:
    """As ``read`` wants it: a path with a glob's characters is taken literally."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_files(session: SparkSession, root: str, files: Sequence[str], schema: T.StructType | None = None, *, merge: bool = False) -> DataFrame:
    reader = session.read.option("basePath", root).option("mergeSchema", str(merge).lower())
    return (reader.schema(schema) if schema else reader).parquet(*[unescaped(f) for f in files])


def _ordered(schema: T.StructType, last: Sequence[str]) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in last] + [schema[c] for c in last])


class Layout(NamedTuple):
    """How a table's files are to be read: all under one schema (``files`` is None), or group by group."""

    session: SparkSession
    schema: T.StructType
    #: Files and own schema of each group.
    files: list[tuple[list[str], T.StructType]] | None


def layout(spark: SparkSession, path: str, partition_by: Sequence[str], files: DataFrame) -> Layout:
    """The evolved schema of ``files`` below ``path``, with the partition columns as text.

    File names come to the driver, as in any listing, and one schema for each kind of file. Where the store can't be reached from
    the tasks, Spark's own merge of footers is used: it adds columns, and raises where types differ.
    """
    session = own_session(spark, AS_TEXT)
    found = survey(files)
    if any(g.mark is None for g in found):
        merged = read_files(session, path, [f for g in found for f in g.files], merge=True).schema
        return Layout(session, _ordered(text_schema(merged, partition_by), partition_by), None)
    own = [_schema_of(session, path, g, partition_by) for g in found]
    schema = _ordered(reduce(evolved_schema, own), partition_by)
    return Layout(session, schema, [(g.files, s) for g, s in zip(found, own, strict=True)] if len(found) > 1 else None)


def _schema_of(session: SparkSession, path: str, group: Group, partition_by: Sequence[str]) -> T.StructType:
    texts = [T.StructField(c, T.StringType()) for c in partition_by]
    if group.noted:
        stored = T.StructType.fromJson(json.loads(group.noted))
        own = T.StructType([f for f in stored.fields if f.name not in partition_by] + texts)
    else:
        own = text_schema(read_files(session, path, group.files[:1]).schema, partition_by)
    if missing := [c for c in partition_by if f"/{c}=" not in group.files[0]]:
        raise ValueError(f"partition columns {missing} not in {group.files[0]}")
    return own


def read_layout(how: Layout, path: str, chosen: Sequence[str]) -> DataFrame:
    """The rows of the ``chosen`` files (of those that ``how`` is about) under its schema."""
    if how.files is None:
        return read_files(how.session, path, chosen, how.schema)
    wanted = set(chosen)
    parts = [([f for f in files if f in wanted], own) for files, own in how.files]
    return reduce(DataFrame.unionByName, [conform(read_files(how.session, path, files, own), how.schema) for files, own in parts if files])


def read_evolved(spark: SparkSession, path: str, partition_by: Sequence[str] = (), *, folders: Sequence[str] | None = None) -> DataFrame:
    """The Parquet table at ``path`` (or these folders of it) under one schema for all its files.

    A column that some files lack is NULL in their rows, a column stored as INT here and BIGINT there is
    BIGINT; types that don't widen to one another raise TypeError naming the column. Partition columns are the text of
    folder names. Plain tables (all files alike) are read as Spark does, after the survey of their footers.
    """
    root = path.rstrip("/")
    files = list_files(spark, [root] if folders is None else [f"{root}/{unescaped(f)}" for f in folders])
    how = layout(spark, root, list(partition_by), files)
    if how.files is None:
        return read_text_partitions(spark, root, partition_by, folders, how.schema)
    return read_layout(how, root, [f for names, _ in how.files for f in names])
