"""Change paths: upsert (merge), append with schema evolution, folding of concurrent batches."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.functions.types import check_store, conform, evolved_schema
from stevedore.operators._keys import SPREAD, any_key_null, check_keys, spread_column
from stevedore.operators._paths import delete, exists, folder, holds_data, partition_text, read_text_partitions, reject_sink_log
from stevedore.operators._schemas import Layout, layout, list_files, read_files, read_layout, unescaped


def _as_column(cond: Column | str | None) -> Column | None:
    if cond is None or isinstance(cond, Column):
        return cond
    return F.expr(cond)


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    *,
    delete_when: Column | str | None = None,
    colocated: bool = False,
) -> DataFrame:
    """Apply ``source`` to ``target`` by ``keys``; returns the new contents of the target.

    * matched key, ``delete_when`` true on the source row: the row is removed;
    * matched key otherwise: the source row replaces the target row (each of them,
      if the target holds the key more than once);
    * target rows without a match stay; source rows without a match are inserted
      (a delete-flagged one is dropped, there is nothing to delete);
    * NULL keys never match: such a source row inserts, such a target row stays;
    * two source rows with the same complete key raise an error (inside the job).

    Plan: the target LEFT OUTER JOINs the source, and the source rows whose keys it doesn't hold are
    added (anti join with the matched keys, at most as many as the source has).  A source under
    the broadcast threshold moves no target row; a larger one shuffles both sides on the keys, and AQE
    splits a key that a large share of the target holds.  NULL-key rows bypass the match.  Columns
    must fit the target's types (TypeError).  Without ``delete_when`` the source may have no column
    that the target lacks (ValueError); with it, other columns only serve the condition.

    ``colocated=True`` is for a target stored bucketed on exactly ``keys`` (see
    ``publish_table(bucket_by=...)``): the join is then on the keys alone, so the
    target is read in its bucket layout and only the source is shuffled.  NULL-key
    rows bypass the join (a filtered read each side; Parquet skips row groups
    without NULLs), and the duplicate check is a separate pass over the source keys.
    """
    keys = list(keys)
    check_keys(target, keys, "merge_upsert target")
    check_keys(source, keys, "merge_upsert source")
    cols = target.columns
    missing = [c for c in cols if c not in source.columns]
    if missing:
        raise ValueError(f"merge_upsert: source lacks target columns {missing}")
    extra = [c for c in source.columns if c not in cols]
    if extra and delete_when is None:
        raise ValueError(f"merge_upsert: the target lacks source columns {extra}")
    check_store(source.select(*cols).schema, target.schema, "merge_upsert")
    types = {f.name: f.dataType for f in target.schema.fields}
    delete_col = _as_column(delete_when)

    src = source.select(
        *[F.col(c).cast(types[c]).alias(c) for c in cols],
        (F.coalesce(delete_col, F.lit(False)) if delete_col is not None else F.lit(False)).alias("__del"),
    )
    if colocated:
        return _merge_colocated(target, src, keys, cols)
    null_key = any_key_null(keys)
    complete = src.filter(~null_key)
    s = complete.select(
        *[F.col(c).alias(f"__s_{c}") for c in cols], F.col("__del").alias("__s_del"), F.lit(0).cast("long").alias(f"__s_{SPREAD}")
    )
    # The spread column scatters the target's NULL-key rows, which no source row meets.
    t = target.withColumn(SPREAD, spread_column(target, keys, side=1)).select(
        *[F.col(c).alias(f"__t_{c}") for c in cols], F.col(SPREAD).alias(f"__t_{SPREAD}")
    )
    cond = [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in [*keys, SPREAD]]
    met = F.col("__s_del").isNotNull()
    kept = t.join(s, cond, "left_outer").filter(~(met & F.col("__s_del"))).select(
        *[F.when(met, F.col(f"__s_{c}")).otherwise(F.col(f"__t_{c}")).alias(c) for c in cols]
    )
    matched = (
        target.select(*[F.col(k).alias(f"__m_{k}") for k in keys])
        .join(complete.select(*[F.col(k).alias(f"__k_{k}") for k in keys]), [F.col(f"__m_{k}") == F.col(f"__k_{k}") for k in keys], "left_semi")
        .distinct()
    )
    added = complete.join(matched, [F.col(k) == F.col(f"__m_{k}") for k in keys], "left_anti")
    inserted = added.unionByName(src.filter(null_key)).filter(~F.col("__del")).select(*cols)
    # No row comes from here: a key that occurs twice in the source raises, for others the condition is false.
    counts = complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    twice = F.when(F.col("__n") > 1, F.raise_error(F.lit("merge_upsert: duplicate key in source")))
    none = counts.filter(twice.isNotNull()).select(*[(F.col(c) if c in keys else F.lit(None)).cast(types[c]).alias(c) for c in cols])
    return kept.unionByName(inserted).unionByName(none)


def _merge_rows(t: DataFrame, s: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Full outer join of renamed sides on ``keys``, merge rules applied."""
    joined = t.join(s, [F.col(f"__t_{k}") == F.col(f"__s_{k}") for k in keys], "full_outer")
    from_source = F.col("__s_present").isNotNull()
    return joined.filter(~(from_source & F.col("__s_del"))).select(
        *[F.when(from_source, F.col(f"__s_{c}")).otherwise(F.col(f"__t_{c}")).alias(c) for c in cols]
    )


def _merge_colocated(target: DataFrame, src: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    null_key = any_key_null(keys)
    complete_src = src.filter(~null_key)
    duplicated = complete_src.groupBy(*keys).count().filter(F.col("count") > 1).limit(1).count()
    if duplicated:
        raise ValueError("merge_upsert: duplicate key in source")
    s = complete_src.select(
        *[F.col(c).alias(f"__s_{c}") for c in cols], F.col("__del").alias("__s_del"), F.lit(True).alias("__s_present")
    )
    t = target.filter(~null_key).select(*[F.col(c).alias(f"__t_{c}") for c in cols])
    merged = _merge_rows(t, s, keys, cols)
    kept_targets = target.filter(null_key).select(*cols)
    inserted = src.filter(null_key & ~F.col("__del")).select(*cols)
    return merged.unionByName(kept_targets).unionByName(inserted)


def evolve_append(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """``base`` followed by ``incoming`` under the evolved schema.

    New columns are added (NULL in base rows), columns absent from ``incoming`` are NULL
    in its rows, numeric columns widen (INT with BIGINT -> BIGINT).  A string against
    a number raises on the schema check, before any job runs.
    """
    schema = evolved_schema(base.schema, incoming.schema)
    return conform(base, schema).unionByName(conform(incoming, schema))


def evolve_table(incoming: DataFrame, table: str) -> DataFrame:
    """Append ``incoming`` to the catalog ``table``, adding its new columns.

    Incompatible columns raise TypeError on the schemas, before the table is touched.  Where all
    incoming types fit the table's, new columns are added to the catalog and the rows appended.  Where
    a column must widen (INT with BIGINT), the table is rewritten with the wider type, as
    ``replace_table`` does: the old table stays until the new one is complete.
    """
    from stevedore.operators.tables import replace_table

    spark = incoming.sparkSession
    current = spark.table(table).schema
    schema = evolved_schema(current, incoming.schema)
    widened = [f.name for f in current.fields if schema[f.name].dataType != f.dataType]
    if widened:
        return replace_table(evolve_append(spark.table(table), incoming), table)
    new = [f for f in schema.fields if f.name not in set(current.fieldNames())]
    if new:
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({cols})")
    stored = spark.table(table).schema
    conform(incoming, T.StructType([schema[n] for n in stored.names])).write.insertInto(table)
    return spark.table(table)


def fold_batches(
    batches: DataFrame,
    keys: Sequence[str],
    batch_col: str,
    order_cols: Sequence[str],
) -> DataFrame:
    """Fold pending writers' batches into one merge source, however many there are.

    Per key, the winning row is the one of the highest ``batch_col`` (later writer wins),
    ties broken by ``order_cols``; ``n_batches`` counts the batches that touched the key,
    so ``n_batches > 1`` marks a contested key.  Rows with a NULL key are not folded.

    Plan: two aggregations, by (key, batch) and then by key, each partial on every map task first.
    The first leaves one row for each key and batch, so a key that holds a large share of all rows is
    small by the time its rows meet.  Both are sort-based, since their rows are of variable length.
    """
    keys = list(keys)
    check_keys(batches, keys, "fold_batches")
    cols = batches.columns
    row = F.struct(*[F.col(c) for c in cols])
    rank = F.struct(F.col(batch_col), *[F.col(c) for c in order_cols])
    by_batch = (
        batches.withColumn(SPREAD, spread_column(batches, keys))
        .groupBy(*keys, SPREAD, F.col(batch_col).alias("__batch"))
        .agg(F.max_by(row, rank).alias("__row"), F.max(rank).alias("__rank"))
    )
    return (
        by_batch.groupBy(*keys, SPREAD)
        .agg(F.max_by("__row", "__rank").alias("__win"), F.count("__batch").alias("n_batches"))
        .select(*[F.col(f"__win.{c}").alias(c) for c in cols], "n_batches")
    )


#: Types whose smallest and largest key can be a filter on the target's scan.
_RANGED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.DecimalType)


def _touched_files(how, root: str, files: Sequence[str], src: DataFrame, keys: Sequence[str], same: dict[str, Column], spans: dict) -> set[str]:
    """The files that hold a key of ``src``: their key columns only are read, and of these the row groups whose keys
    can lie between the smallest and the largest of the batch."""
    wanted = set(files)
    groups = [(list(files), how.schema)] if how.files is None else [([f for f in own if f in wanted], schema) for own, schema in how.files]
    at = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("__file")
    sides = []
    for names, schema in groups:
        if names:
            rows = read_files(how.session, root, names, schema)
            for k, (low, high) in spans.items():
                if low is not None and schema[k].dataType == how.schema[k].dataType:
                    rows = rows.filter(F.col(k).between(F.lit(low), F.lit(high)))
            sides.append(rows.withColumns(same).select(*[F.col(k).cast(how.schema[k].dataType).alias(k) for k in keys], *same, at))
    found = reduce(DataFrame.unionByName, sides).join(src.withColumns(same).select(*keys, *same), [*keys, *same], "left_semi")
    return {r[0] for r in found.select("__file").distinct().collect()}


def merge_into_path(
    spark,
    path: str,
    source: DataFrame,
    keys: Sequence[str],
    partition_by: Sequence[str],
    *,
    delete_when: Column | str | None = None,
    evolve: Sequence[str] | None = None,
) -> int:
    """Upsert ``source`` into the partitioned Parquet table at ``path``, rewriting only the files that hold
    a key of it.  Returns the number of partitions that the source touches.

    Rows match on ``keys`` *and* the partition columns (a key is looked up within its
    partition), with ``merge_upsert``'s rules otherwise; a NULL partition value is a partition like
    any other, while NULL ``keys`` match nothing.  Partition values are the text in folder names
    (``01`` stays ``01``), and source values are compared as text.

    Files may differ in schema: rows are merged under the schema that holds all files of the touched
    partitions (``_schemas``), so no column is lost.  ``evolve`` names source columns that the table gets if it lacks them (NULL
    in its old rows), and lets the columns that both have widen to the source's types; without it a source that doesn't fit raises.

    1. the source is staged once, so that all passes see the same rows; the touched partition values,
       one row each, name the folders, and only those are listed;
    2. the key columns of their files, filtered to the batch's range of keys, meet the source's keys: the files with a match,
       by name, are those to rewrite;
    3. their rows are merged and written beside them once; then the old files go, and folders that the merge emptied.

    The new files appear when the write commits, before the old ones are removed one by one: a reader in between sees rows of
    both, and so does everyone if the driver is lost just then (there is no table format to switch versions at once). A job that
    fails before leaves the table as it was; lost executors only repeat tasks.
    """
    from stevedore.session import scratch_path

    pcols, keys = list(partition_by), list(keys)
    if not pcols:
        raise ValueError("merge_into_path needs partition columns; use merge_upsert for a whole table")
    check_keys(source, keys + pcols, "merge_into_path source")
    reject_sink_log(spark, path, "merge_into_path")
    root = path.rstrip("/")
    staged_source = scratch_path(spark, "merge_source")
    text = partition_text(source, pcols)
    text.write.parquet(staged_source)
    staged = spark.read.schema(text.schema).parquet(staged_source)
    ranged = [k for k in keys if isinstance(text.schema[k].dataType, _RANGED)]
    spread = [f(k).alias(f"__{n}_{k}") for k in ranged for n, f in (("low", F.min), ("high", F.max))]
    touched_rows = staged.groupBy(*pcols).agg(F.lit(1).alias("__one"), *spread).collect()
    if not touched_rows:
        return 0
    touched = {folder(spark, pcols, [r[c] for c in pcols]) for r in touched_rows}
    spans = {}
    for k in ranged:
        lows, highs = ([r[f"__{n}_{k}"] for r in touched_rows if r[f"__{n}_{k}"] is not None] for n in ("low", "high"))
        spans[k] = (min(lows, default=None), max(highs, default=None))
    present = sorted(f for f in touched if exists(spark, f"{root}/{f}"))
    listed = list_files(spark, [f"{root}/{unescaped(f)}" for f in present]) if present else None
    files = [r.path for r in listed.select("path").collect()] if present else []
    if files:
        how = layout(spark, root, pcols, listed)
    else:  # every touched partition is new
        known = read_text_partitions(spark, path, pcols)
        how = Layout(known.sparkSession, known.schema, None)
    schema = how.schema
    check_keys(how.session.createDataFrame([], schema), keys + pcols, "merge_into_path target")
    if evolve is not None:
        kept = [f for f in text.schema.fields if f.name in schema.names or f.name in set(evolve)]
        schema = evolved_schema(schema, T.StructType(kept))
        schema = T.StructType([f for f in schema.fields if f.name not in pcols] + [schema[c] for c in pcols])
    src = how.session.read.schema(text.schema).parquet(staged_source)
    # NULL partition values meet as one text; Spark writes NULL and '' to the same folder.
    same = {f"__part{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(pcols)}
    marks = _touched_files(how, root, files, src, keys, same, spans) if files else set()
    plain = lambda p: re.sub(r"^([a-z0-9]+):/+", r"\1:/", p)
    marks = {plain(m) for m in marks}
    old = [f for f in files if plain(f) in marks]
    if len(old) != len(marks):
        raise RuntimeError(f"merge_into_path: {len(marks) - len(old)} files with matches are not in the listing of {path}")
    target = conform(read_layout(how, root, old), schema) if old else how.session.createDataFrame([], schema)
    merged = merge_upsert(target.withColumns(same), src.withColumns(same), keys + list(same), delete_when=delete_when).drop(*same)
    merged.hint("rebalance", *pcols).write.mode("append").partitionBy(*pcols).parquet(path)
    for f in old:
        delete(spark, f)
    for f in present:
        if not holds_data(spark, f"{root}/{f}"):
            delete(spark, f"{root}/{f}")
    return len(touched)
