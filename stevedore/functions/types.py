"""How column types widen, and what may be stored where without loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Numeric widening ladder: a column may move up, never down.
_NUMERIC_ORDER = [T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
_FLOAT_RANK = _NUMERIC_ORDER.index(T.FloatType)
# The digits an integer type needs as a decimal.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 20}


def _numeric_rank(dt: T.DataType) -> int | None:
    for i, cls in enumerate(_NUMERIC_ORDER):
        if isinstance(dt, cls):
            return i
    return None


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type both ``a`` and ``b`` widen to as in Spark's union, or None when they are incompatible (also
    where a decimal of 38 digits hasn't room for both)."""
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    ra, rb = _numeric_rank(a), _numeric_rank(b)
    if ra is not None and rb is not None:
        # As Spark's ANSI coercion: an integer with FLOAT goes to DOUBLE (FLOAT would
        # lose digits of a large integer).
        if isinstance(a, T.FloatType) != isinstance(b, T.FloatType) and max(ra, rb) == _FLOAT_RANK:
            return T.DoubleType()
        return a if ra >= rb else b
    da, db = _as_decimal(a), _as_decimal(b)
    if da and db:
        scale = max(da.scale, db.scale)
        digits = max(da.precision - da.scale, db.precision - db.scale)
        return T.DecimalType(digits + scale, scale) if digits + scale <= 38 else None
    if isinstance(a, T.DecimalType) and rb is not None or isinstance(b, T.DecimalType) and ra is not None:
        return T.DoubleType()
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, T.DateType) and isinstance(b, temporal):
        return b
    if isinstance(b, T.DateType) and isinstance(a, temporal):
        return a
    return None


def _as_decimal(dt: T.DataType) -> T.DecimalType | None:
    if isinstance(dt, T.DecimalType):
        return dt
    return T.DecimalType(digits, 0) if (digits := _DIGITS.get(type(dt))) else None


def storable(value: T.DataType, column: T.DataType) -> bool:
    """Whether every value of one type fits a column of the other (nested types: equal but for nullability)."""
    if value.simpleString() == column.simpleString():
        return True
    if isinstance(column, T.DoubleType) and isinstance(value, T.DecimalType):
        return False
    return wider_type(value, column) == column


def check_store(values: T.StructType, columns: T.StructType, what: str) -> None:
    """Raise TypeError naming every column of ``values`` that its column would narrow."""
    have = {f.name.lower(): f for f in values.fields}
    bad = [
        f"{f.name}: {have[f.name.lower()].dataType.simpleString()} into {f.dataType.simpleString()}"
        for f in columns.fields
        if f.name.lower() in have and not storable(have[f.name.lower()].dataType, f.dataType)
    ]
    if bad:
        raise TypeError(f"{what}: values don't fit their columns: " + "; ".join(bad))


def evolved_schema(base: T.StructType, incoming: T.StructType) -> T.StructType:
    """Base columns (widened where needed), then columns new in ``incoming``.  Names match in upper or
    lower case alike, as Spark's do, and keep the base's spelling.

    Raises ``TypeError`` naming every incompatible column.  Checked on schemas only,
    before any row is read.
    """
    inc = {f.name.lower(): f for f in incoming.fields}
    fields, bad = [], []
    for f in base.fields:
        other = inc.get(f.name.lower())
        wt = f.dataType if other is None else wider_type(f.dataType, other.dataType)
        if wt is None:
            bad.append(f"{f.name}: {f.dataType.simpleString()} vs {other.dataType.simpleString()}")
            continue
        fields.append(T.StructField(f.name, wt, True))
    names = {f.name.lower() for f in base.fields}
    fields += [T.StructField(f.name, f.dataType, True) for f in incoming.fields if f.name.lower() not in names]
    if bad:
        raise TypeError("evolve_append: incompatible column types: " + "; ".join(bad))
    return T.StructType(fields)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with exactly ``schema``'s columns: cast by name, absent ones NULL."""
    have = {f.name.lower(): f for f in df.schema.fields}
    if [(f.name, f.dataType) for f in df.schema.fields] == [(f.name, f.dataType) for f in schema.fields]:
        return df
    quoted = lambda name: "`" + name.replace("`", "``") + "`"

    def column(f: T.StructField):
        own = have.get(f.name.lower())
        if own is not None and own.dataType == f.dataType:
            return f"{quoted(own.name)} AS {quoted(f.name)}"
        value = F.lit(None) if own is None else F.col(quoted(own.name))
        return value.cast(f.dataType).alias(f.name)

    columns = [column(f) for f in schema.fields]
    return df.select(*[F.expr(c) if isinstance(c, str) else c for c in columns])
