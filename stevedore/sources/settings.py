"""Settings files -> ``(file, name, value)`` rows, secrets masked.

Three kinds:

* ``xml``:  ``<configuration><property><name/><value/><description/></property>...``; descriptions may
  span lines, and a property may give its name and value as attributes.  A file is read whole, by one task (settings
  files are small), and cut into properties, each of which Spark's XML parser reads;
* ``kv``:   ``KEY=VALUE`` lines, split at the first ``=``; ``#`` comments and blank
  lines skipped; an optional ``export`` prefix and one pair of quotes are removed.
* ``conf``: ``key value`` lines (spark-defaults style), split at the first run of
  white space; ``#`` comments and blank lines skipped.

A non-comment line with no separator is kept, with a NULL value, never dropped.  A damaged XML property
costs no other one; ``malformed_settings`` names the files that hold any.
"""

from __future__ import annotations

import re
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stevedore.functions.secrets import SECRET_NAME_PATTERN, mask_secret

KINDS = ("xml", "kv", "conf")

_COMMENT = r"(?s)<!--.*?-->"
_TAG = r"""<property(?:\s+(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*)?"""
#: A whole element, closed by itself or by its end tag.
_PROPERTY = rf"(?s)^{_TAG}(?:/>|>.*?</property\s*>)"
#: Names and values are child elements or attributes (``_`` before the name).
_FIELDS = "_name string, _value string, name string, value string, _broken string"


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", _COMMENT, "").alias("value"))


def _xml_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, block): each property's tag and what follows it up to the next one's, in order."""
    parts = F.split("value", r"(?=<property[\s/>])", -1)
    blocks = _whole_files(spark, path).select("file", F.posexplode(parts).alias("place", "block"))
    return blocks.filter(F.col("block").rlike(r"^<property[\s/>]"))


def _read_properties(blocks: DataFrame) -> DataFrame:
    """``blocks`` with ``name`` and ``value`` as Spark's XML parser reads the element (attributes, entities, CDATA); the name is NULL
    where it can't, or there is none."""
    element = F.nullif(F.regexp_extract("block", _PROPERTY, 0), F.lit(""))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "true", "nullValue": "\0"}
    read = blocks.withColumn("_p", F.from_xml(element, _FIELDS, options))
    name = F.trim(F.coalesce("_p.name", "_p._name"))
    whole = F.col("_p").isNotNull() & F.col("_p._broken").isNull() & (name != "")
    value = F.coalesce("_p.value", "_p._value", F.when(F.col("block").rlike(r"<value[\s/>]"), F.lit("")))
    return read.withColumns({"name": F.when(whole, name), "value": F.when(whole, F.trim(value))}).drop("_p")


def malformed_settings(spark: SparkSession, path: str) -> DataFrame:
    """``(file, n_properties, n_read, lost)`` of the XML files under ``path`` with properties that can't be read; ``lost`` names each
    of these by its place among the file's properties and, where there is one, what looks like its name."""
    read = _read_properties(_xml_blocks(spark, path))
    looks = F.nullif(F.trim(F.regexp_extract("block", rf"(?s)^{_TAG}>.*?<name[^>]*>\s*([^<]*)", 1)), F.lit(""))
    lost = F.when(F.col("name").isNull(), F.struct(F.col("place"), looks.alias("name")))
    counted = read.groupBy("file").agg(
        F.count(F.lit(1)).alias("n_properties"), F.count("name").alias("n_read"), F.array_sort(F.collect_list(lost)).alias("lost")
    )
    return counted.filter("n_properties <> n_read")


def _folder_column(file: Column, name: str) -> Column:
    """The value of a ``name=value`` folder of the file, as Spark's partition discovery gives it."""
    raw = F.regexp_extract(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), rf"/{re.escape(name)}=([^/]*)/", 1)
    value = F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.nullif(F.nullif(value, F.lit("")), F.lit("__HIVE_DEFAULT_PARTITION__"))


def _below(spark: SparkSession, path: str, file: Column) -> Column:
    """The name of the first folder below ``path`` that the file is in; NULL for files right in ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    root = re.sub(r"^([a-z0-9]+):/+", r"\1:/", system.makeQualified(hadoop).toString()).rstrip("/")
    plain = F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), r"^([a-z0-9]+):/+", "$1:/")
    rest = F.substring(plain, len(root) + 2, 1 << 30)
    return F.when(rest.contains("/"), F.substring_index(rest, "/", 1))


def extract_settings(
    spark: SparkSession,
    path: str,
    kind: str,
    *,
    secret_pattern: str = SECRET_NAME_PATTERN,
    keep: tuple[str, ...] = (),
    group: str | None = None,
    digest: str | None = None,
) -> DataFrame:
    """Settings of every file under ``path``, in folders at any depth.

    ``keep`` names extra columns to carry through, taken from ``key=value`` folders under ``path``;
    ``group`` names a column for the first folder below ``path`` (``conf/<host>/...``: the host).
    ``digest``, a salt, adds ``digest``: a salted hash of the value before masking, so that secrets can be
    compared (``compare_settings``) and not read.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    if kind == "xml":
        rows = _read_properties(_xml_blocks(spark, path)).select("file", "name", "value")
        rows = rows.filter(F.col("name").isNotNull())  # a property that can't be read is reported, not returned
    else:
        text = spark.read.option("recursiveFileLookup", "true").text(path)
        text = text.select(F.col("_metadata.file_path").alias("file"), F.col("value"))
        line = F.trim(F.col("value"))
        text = text.filter((line != "") & ~line.startswith("#"))
        if kind == "kv":
            body = F.regexp_replace(line, r"^export\s+", "")
            pieces = F.split(body, "=", 2)
            raw_value = F.trim(F.try_element_at(pieces, F.lit(2)))
            unquoted = F.regexp_replace(raw_value, r"""^(["'])(.*)\1$""", "$2")
            rows = text.select("file", F.trim(F.try_element_at(pieces, F.lit(1))).alias("name"), unquoted.alias("value"))
        else:
            pieces = F.split(line, r"\s+", 2)
            rows = text.select(
                "file", F.try_element_at(pieces, F.lit(1)).alias("name"), F.trim(F.try_element_at(pieces, F.lit(2))).alias("value")
            )
    if digest is not None:
        rows = rows.withColumn("digest", F.sha2(F.concat(F.lit(digest), F.lit("\0"), F.col("value")), 256))
    rows = rows.withColumn("value", mask_secret(F.col("name"), F.col("value"), secret_pattern))
    extra = [_folder_column(F.col("file"), c).alias(c) for c in keep]
    if group:
        extra.append(_below(spark, path, F.col("file")).alias(group))
    return rows.select("*", *extra)


def compare_settings(
    spark: SparkSession,
    expected: str,
    expected_kind: str,
    actual: str,
    actual_kind: str,
    *,
    keep: tuple[str, ...] = (),
    group: str | None = None,
) -> DataFrame:
    """Differences between two folders of settings files, by ``(*keep, group, name)``: ``status``, and both
    values as they may be shown.  Values are compared by salted digests made before masking, so a
    changed secret is a difference and its value isn't seen.  The salt is new for each call and kept nowhere.
    A setting given twice for one key on either side raises.
    """
    from stevedore.operators.reconcile import reconcile

    salt = secrets.token_hex(16)
    side = lambda path, kind: extract_settings(spark, path, kind, keep=keep, group=group, digest=salt)
    keys = [*keep, *([group] if group else []), "name"]
    e, a = side(expected, expected_kind), side(actual, actual_kind)
    found = reconcile(e, a, keys, columns=["digest"], show={"value": ("expected", "actual")})
    return found.drop("changed_columns")
