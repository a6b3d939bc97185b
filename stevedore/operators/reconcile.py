"""Reconcile two keyed tables: which keys are missing, extra or changed, and in which columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stevedore.functions.types import wider_type
from stevedore.operators._keys import SPREAD, any_key_null, check_keys, spread_column
from stevedore.session import scratch_path


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    show: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """One row per differing key: ``(*keys, status, changed_columns)``.

    ``status`` is ``missing`` (expected only), ``extra`` (actual only) or ``changed``;
    ``changed_columns`` lists, comma-separated in column order, the compared columns
    whose values differ null-safely (NULL equals NULL).  Equal keys produce no row.
    Every difference is reported, not only the first.  A column that only one side has compares
    as NULL on the other, so an added column is a difference where it holds a value.  NULL keys never match; a
    duplicated complete key on either side raises.  ``show`` carries columns that aren't compared:
    name -> names of the expected and the actual value in the result.

    Plan: one full outer join on the keys; each side is shuffled once.
    """
    keys = list(keys)
    check_keys(expected, keys, "reconcile expected")
    check_keys(actual, keys, "reconcile actual")
    shown = dict(show or {})
    if columns is None:
        columns = [c for c in dict.fromkeys([*expected.columns, *actual.columns]) if c not in keys and c not in shown]
    columns = list(columns)
    absent = [c for c in [*columns, *shown] if c not in expected.columns and c not in actual.columns]
    if absent:
        raise ValueError(f"reconcile: columns {absent} are on neither side")

    def side(df: DataFrame, tag: str, n: int) -> DataFrame:
        df = df.select(*keys, *[F.col(c) if c in df.columns else F.lit(None).alias(c) for c in [*columns, *shown]])
        df = df.withColumn(SPREAD, spread_column(df, keys, side=n))
        # Keys must be unique on each side, or the join would pair every duplicate with
        # every other.  The count is a window on the join keys, so the join reuses its
        # shuffle; a duplicate raises inside the job.
        df = df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys, SPREAD)))
        dup = (F.col("__n") > 1) & ~any_key_null(keys)
        df = df.filter(F.when(dup, F.raise_error(F.lit(f"reconcile: duplicate key on the {'expected' if n == 1 else 'actual'} side"))).isNull())
        return df.select(
            *[F.col(c).alias(f"{tag}{c}") for c in [*keys, *columns, *shown, SPREAD]], F.lit(True).alias(f"{tag}present")
        )

    e, a = side(expected, "__e_", 1), side(actual, "__a_", 2)
    cond = [F.col(f"__e_{k}") == F.col(f"__a_{k}") for k in [*keys, SPREAD]]
    joined = e.join(a, cond, "full_outer")
    in_e, in_a = F.col("__e_present").isNotNull(), F.col("__a_present").isNotNull()
    diffs = [F.when(~F.col(f"__e_{c}").eqNullSafe(F.col(f"__a_{c}")), F.lit(c)) for c in columns]
    changed = F.concat_ws(",", *diffs) if diffs else F.lit("")
    status = (
        F.when(~in_a, F.lit("missing")).when(~in_e, F.lit("extra")).when(changed != "", F.lit("changed"))
    )
    return (
        joined.select(
            *[F.coalesce(F.col(f"__e_{k}"), F.col(f"__a_{k}")).alias(k) for k in keys],
            status.alias("status"),
            F.when(in_e & in_a, changed).alias("changed_columns"),
            *[F.col(f"__{side}_{c}").alias(name) for c, names in shown.items() for side, name in zip("ea", names, strict=True)],
        )
        .filter(F.col("status").isNotNull())
    )


#: Ranges of the first level, and within each of them on the second.
RANGES = 1 << 12


def _digests(df: DataFrame, by: list[str]) -> DataFrame:
    """Number and digest of the rows of each range.  Halves of 32 bits are summed, so no sum overflows, and rows that
    occur twice don't cancel out."""
    high, low = F.shiftright("__row", 32), F.col("__row").bitwiseAND(F.lit(0xFFFFFFFF))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(high).alias("high"), F.sum(low).alias("low"))


def _unequal(e: DataFrame, a: DataFrame, by: list[str]) -> DataFrame:
    """The ranges whose digests differ, written to scratch: few rows, of known size."""
    e, a = _digests(e, by), _digests(a, by)
    a = a.select(*[F.col(c).alias(f"__{c}") for c in a.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("n", "high", "low")]
    both = e.join(a, [F.col(c) == F.col(f"__{c}") for c in by], "full_outer").filter(~(same[0] & same[1] & same[2]))
    found = both.select(*[F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) for c in by])
    path = scratch_path(found.sparkSession, "unequal-ranges")
    found.write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def differing_ranges(
    expected: DataFrame, actual: DataFrame, keys: Sequence[str], columns: Sequence[str], *, ranges: int = RANGES
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that may differ: those in key ranges whose digests differ, and those with a NULL key.

    Ranges are of a hash of the keys.  Each side first gives one digest for each of ``ranges`` ranges (partial
    aggregates: no row moves), then, within those that differ, one for each of ``ranges`` narrower ones.
    """
    keys, columns = list(keys), list(columns)
    for c in [*keys, *columns]:
        if c in expected.columns and c in actual.columns and wider_type(expected.schema[c].dataType, actual.schema[c].dataType) is None:
            raise TypeError(f"reconcile: {c} is {expected.schema[c].dataType.simpleString()} and {actual.schema[c].dataType.simpleString()}")

    def marked(df: DataFrame, other: DataFrame) -> DataFrame:
        def like(c: str) -> Column:
            if c not in df.columns:
                return F.lit(None).cast(other.schema[c].dataType)
            own = df.schema[c].dataType
            return F.col(c).cast(wider_type(own, other.schema[c].dataType) if c in other.columns else own)

        def hashed(c: str) -> list[Column]:
            # A hash passes over NULLs, so their places are hashed too; within arrays and structs by their text.
            kind = (df if c in df.columns else other).schema[c].dataType
            nested = isinstance(kind, (T.ArrayType, T.StructType))
            value = F.to_json(F.struct(like(c).alias("c")), {"ignoreNullFields": "false"}) if nested else like(c)
            return [value, like(c).isNull()]

        key = F.xxhash64(*[like(k) for k in keys])
        row = F.xxhash64(*[x for c in [*keys, *columns] for x in hashed(c)])
        return df.withColumns(
            {"__wide": F.pmod(key, F.lit(ranges)), "__narrow": F.pmod(F.shiftright(key, 32), F.lit(ranges)), "__row": row}
        )

    e, a = marked(expected, actual), marked(actual, expected)
    whole = ~any_key_null(keys)
    wide = F.broadcast(_unequal(e.filter(whole), a.filter(whole), ["__wide"]))  # at most ``ranges`` numbers
    near = [df.filter(whole).join(wide, "__wide", "left_semi") for df in (e, a)]
    narrow = _unequal(*near, ["__wide", "__narrow"])
    out = []
    for df, rows, cols in ((e, near[0], expected.columns), (a, near[1], actual.columns)):
        chosen = rows.join(narrow, ["__wide", "__narrow"], "left_semi").select(*cols)
        out.append(chosen.unionByName(df.filter(~whole).select(*cols)))
    return out[0], out[1]


def reconcile_ranges(
    expected: DataFrame,
    actual: DataFrame,
    keys: Sequence[str],
    *,
    columns: Sequence[str] | None = None,
    ranges: int = RANGES,
) -> DataFrame:
    """``reconcile`` for large tables that are nearly equal: digests of key ranges are compared first, and only the
    rows of ranges that differ are shuffled and joined, so what moves grows with the differences.

    Results are ``reconcile``'s, but for three things.  Both sides are read three times, so they must be tables that stay
    the same meanwhile.  Keys that occur twice raise only in ranges that differ (elsewhere both sides hold the same
    rows equally often).  A range with a difference has equal digests with a probability of about 2^-64.
    Common columns whose types don't widen to one another raise TypeError.
    """
    keys = list(keys)
    check_keys(expected, keys, "reconcile expected")
    check_keys(actual, keys, "reconcile actual")
    if columns is None:
        columns = [c for c in dict.fromkeys([*expected.columns, *actual.columns]) if c not in keys]
    if absent := [c for c in columns if c not in expected.columns and c not in actual.columns]:
        raise ValueError(f"reconcile: columns {absent} are on neither side")
    e, a = differing_ranges(expected, actual, keys, columns, ranges=ranges)
    return reconcile(e, a, keys, columns=columns)


def reconcile_summary(diff: DataFrame) -> DataFrame:
    """``(status, n)`` counts of a ``reconcile`` result."""
    return diff.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
