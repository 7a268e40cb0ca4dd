"""Schemas: folding, edits, casts, and proposals of narrower types. All casts are expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that count as true. Fixed values.
TRUE_VALUES = ("true", "wahr", "1", "1.0", "yes", "ja", "ok", "o.k", "okay")
#: Types from narrow to wide for the plain fold, with their widths in bits (0: not of fixed width).
RANKS = [("void", 0), ("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64), ("float", 32), ("double", 64), ("string", 0)]
TIME_UNITS = ("s", "ms", "us")


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def check_unit(unit: str) -> str:
    if unit not in TIME_UNITS:
        raise ValueError(f"time unit {unit!r}: Spark keeps microseconds; choose one of {', '.join(TIME_UNITS)}")
    return unit


def str2bool(c: Column, true_values: Sequence[str] = TRUE_VALUES) -> Column:
    """Null stays null; any text that is not in the list is false."""
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(F.lower(c).isin(*true_values))


def int2timestamp(c: Column, unit: str = "us", tz: str | None = None) -> Column:
    """Whole numbers as time since the epoch in ``unit``; zone-less unless ``tz`` is given."""
    made = {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[check_unit(unit)](c.cast("long"))
    return made if tz else F.to_timestamp_ntz(F.date_format(made, "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def truncate_unit(c: Column, unit: str) -> Column:
    """A timestamp cut to the precision of ``unit``."""
    part = {"s": "second", "ms": "millisecond", "us": "microsecond"}[check_unit(unit)]
    return F.date_trunc(part, c)


def cast_column(c: Column, old: T.DataType, new: T.DataType, ts_unit: str = "us", tz: str | None = None) -> Column:
    """The cast from ``old`` to ``new``; it fails where a value does not fit."""
    if old == new:
        return c
    if isinstance(new, T.BooleanType) and isinstance(old, T.StringType):
        return str2bool(c)
    if isinstance(new, (T.TimestampType, T.TimestampNTZType)) and isinstance(old, T.IntegralType):
        return int2timestamp(c, ts_unit, tz if isinstance(new, T.TimestampType) else None).cast(new)
    return c.cast(new)


def replace_schema(df: DataFrame, schema: T.StructType, ts_unit: str = "us", tz: str | None = None) -> DataFrame:
    """``df`` in the schema's columns, order and types: missing ones null, others dropped."""
    if df.schema == schema:
        return df
    have = {f.name: f.dataType for f in df.schema}
    return df.select(*[(cast_column(col(f.name), have[f.name], f.dataType, ts_unit, tz) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def convert_timestamps(df: DataFrame, unit: str | None = None, tz: str | None = None, remove_tz: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """Timestamps cut to ``unit``, with a zone if ``tz``, without if ``remove_tz`` (which wins)."""
    out = {}
    for f in df.schema:
        if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)) or fields is not None and f.name not in fields:
            continue
        to = T.TimestampNTZType() if remove_tz else T.TimestampType() if tz else f.dataType
        c = col(f.name)
        out[f.name] = (truncate_unit(c, unit) if unit and unit != "us" else c).cast(to)
    return df.withColumns(out) if out else df


def _rank(t: T.DataType) -> tuple[int, int]:
    name = t.simpleString()
    return next(((i, w) for i, (n, w) in enumerate(RANKS) if n == name), (-1, 0))


def fold_types(a: T.DataType, b: T.DataType) -> T.DataType:
    """The plain fold of two types: the wider if it also ranks higher, else double; see SURVEY 1.3.

    A current type outside the ranked list wins, except that of two timestamps the later does.
    """
    if a == b:
        return a
    (i, wide_a), (j, wide_b) = _rank(a), _rank(b)
    if i < 0:
        both = (T.TimestampType, T.TimestampNTZType)
        return b if isinstance(a, both) and isinstance(b, both) else a
    if wide_a and wide_b:
        low, high = ((i, wide_a, a), (j, wide_b, b)) if i < j else ((j, wide_b, b), (i, wide_a, a))
        if high[1] > low[1] or high[1] == low[1] and j > i:
            return high[2]
        return T.DoubleType()
    return b if max(j, 0) > i else a


def unify_schemas(schemas: Sequence[T.StructType]) -> T.StructType:
    """Left fold, fields in order of first sight, all nullable, no metadata."""
    found: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s:
            found[f.name] = fold_types(found[f.name], f.dataType) if f.name in found else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in found.items()])


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """What repairs widen to: the least type that holds both exactly; whole and real meet in double,
    anything and text in text; otherwise the first."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    whole = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if type(a) in whole and type(b) in whole:
        return max(a, b, key=lambda t: whole.index(type(t)))
    number = (T.IntegralType, T.FloatType, T.DoubleType)
    if isinstance(a, number) and isinstance(b, number):
        return T.DoubleType()
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if isinstance(a, T.TimestampType) and isinstance(b, T.TimestampNTZType) or isinstance(a, T.TimestampNTZType) and isinstance(b, T.TimestampType):
        return T.TimestampType()
    if isinstance(a, T.DateType) and isinstance(b, (T.TimestampType, T.TimestampNTZType)):
        return b
    return a


def unify_permissive(schemas: Sequence[T.StructType]) -> T.StructType:
    found: dict[str, T.DataType] = {}
    for s in schemas:
        for f in s:
            found[f.name] = common_type(found[f.name], f.dataType) if f.name in found else f.dataType
    return T.StructType([T.StructField(n, t, True) for n, t in found.items()])


def union_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, with the columns of all frames in their common types."""
    target = unify_permissive([f.schema for f in frames])
    out = None
    for f in frames:
        f = replace_schema(f, target)
        out = f if out is None else out.unionByName(f)
    return out


def sort_schema(schema: T.StructType, names: Sequence[str] | None = None) -> T.StructType:
    by = {f.name: f for f in schema}
    return T.StructType([by[n] for n in (names or sorted(by))])


def append_field(schema: T.StructType, field: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, field])


def drop_field(schema: T.StructType, name: str) -> T.StructType:
    return T.StructType([f for f in schema if f.name != name])


def replace_field(schema: T.StructType, field: T.StructField) -> T.StructType | None:
    """None if there is no field of the name."""
    if field.name not in schema.names:
        return None
    return T.StructType([field if f.name == field.name else f for f in schema])


def modify_field(schema: T.StructType, name: str, data_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, data_type, f.nullable) if f.name == name else f for f in schema])


_WHOLE = [("tinyint", -(2**7), 2**7 - 1), ("smallint", -(2**15), 2**15 - 1), ("int", -(2**31), 2**31 - 1), ("bigint", -(2**63), 2**63 - 1)]


def propose_types(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), shrink: bool = False, sample_rows: int | None = None, sample_method: str = "first") -> dict[str, str]:
    """Better types for text and, with ``shrink``, number columns, as {column: type} of those that change.

    One aggregation: how many values a cast keeps, and least and greatest. ``sample_rows`` limits what
    is looked at, the first or random ones (the caller then verifies on all rows).
    """
    if sample_method not in ("first", "random"):
        raise ValueError(f"sample_method {sample_method!r}")
    look = df
    if sample_rows is not None and sample_method == "random":
        # a little more than asked for, so that the limit rarely finds too few
        look = df.sample(fraction=min(1.0, 1.2 * sample_rows / max(df.count(), 1)), seed=17)
    look = look if sample_rows is None else look.limit(sample_rows)
    aggs, kinds = [], {}
    for i, f in enumerate(df.schema):
        if f.name in exclude or include is not None and f.name not in include:
            continue
        c = col(f.name)
        if isinstance(f.dataType, T.StringType):
            t = F.trim(c)
            whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t).try_cast("bigint")
            real = F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t).try_cast("double")
            aggs += [F.count(c).alias(f"n{i}"), F.count(whole).alias(f"w{i}"), F.count(real).alias(f"r{i}"), F.min(whole).alias(f"a{i}"), F.max(whole).alias(f"z{i}")]
            kinds[i] = "text"
        elif shrink and isinstance(f.dataType, T.IntegralType):
            aggs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"z{i}")]
            kinds[i] = "whole"
        elif shrink and isinstance(f.dataType, T.DoubleType):
            aggs += [F.count(c).alias(f"n{i}"), F.count_if(c.cast("float").cast("double") == c).alias(f"r{i}")]
            kinds[i] = "real"
    if not aggs:
        return {}
    row = look.agg(*aggs).first().asDict()

    def narrow(lo: int, hi: int) -> str:
        return next(t for t, a, z in _WHOLE if a <= lo and hi <= z) if shrink else "bigint"

    out = {}
    for i, kind in kinds.items():
        f = df.schema[i]
        n = row[f"n{i}"]
        if not n:
            continue
        new = None
        if kind == "text":
            if row[f"w{i}"] == n:
                new = narrow(row[f"a{i}"], row[f"z{i}"])
            elif row[f"r{i}"] == n:
                new = "float" if shrink else "double"
        elif kind == "whole":
            new = narrow(row[f"a{i}"], row[f"z{i}"])
        elif row[f"r{i}"] == n:
            new = "float"
        if new and new != f.dataType.simpleString():
            out[f.name] = new
    return out


def opt_dtype(df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), shrink: bool = False, sample_rows: int | None = None, sample_method: str = "first") -> DataFrame:
    """``df`` with the proposed types applied."""
    found = propose_types(df, include, exclude, shrink, sample_rows, sample_method)
    return df.withColumns({c: F.trim(col(c)).cast(t) if isinstance(df.schema[c].dataType, T.StringType) else col(c).cast(t) for c, t in found.items()}) if found else df
