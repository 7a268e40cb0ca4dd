"""Frame to frame helpers: date parts, truncation, unnesting, splitting, differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.slices import default_slices, slice_of
from parquarry.functions.types import col

DATE_PARTS = {
    "year": F.year,
    "month": F.month,
    "week": F.weekofyear,
    "yearday": F.dayofyear,
    "monthday": F.dayofmonth,
    "weekday": lambda c: F.weekday(c) + 1,  # Monday is 1
    "day": F.dayofmonth,
    "hour": F.hour,
    "minute": F.minute,
}
#: strftime to Spark's patterns.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh"}


def timestamp_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def with_datepart_columns(df: DataFrame, parts: Sequence[str], timestamp_column: str | None = None) -> DataFrame:
    """Date parts as longs; the first temporal column is used if none is named."""
    if unknown := [p for p in parts if p not in DATE_PARTS]:
        raise ValueError(f"no date part {unknown[0]!r}")
    if timestamp_column is None:
        found = timestamp_columns(df.schema)
        if not found:
            raise ValueError("no temporal column to take date parts of")
        timestamp_column = found[0]
    return df.withColumns({p: DATE_PARTS[p](col(timestamp_column)).cast("long") for p in parts})


def with_truncated_columns(df: DataFrame, unit: str, timestamp_column: str, suffix: str = "_trunc") -> DataFrame:
    """The timestamp cut to the beginning of its ``unit`` (month, week, day, ...), of its own type."""
    return df.withColumn(timestamp_column + suffix, F.date_trunc(unit, col(timestamp_column)).cast(df.schema[timestamp_column].dataType))


def with_strftime_columns(df: DataFrame, pattern: str, timestamp_column: str, name: str | None = None) -> DataFrame:
    out, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in STRFTIME:
            out, i = out + STRFTIME[two], i + 2
        elif two[0] == "%":
            raise ValueError(f"no equivalent of {two!r}")
        else:
            out, i = out + (f"'{two[0]}'" if two[0].isalpha() else two[0]), i + 1
    return df.withColumn(name or f"{timestamp_column}_text", F.date_format(col(timestamp_column), out))


def with_row_count(df: DataFrame, order: Sequence[Column | str], over: Sequence[str] = (), name: str = "row_nr", offset: int = 1) -> DataFrame:
    """A running number over ``order`` within the groups ``over``.

    Without groups, rows are numbered by range partition and the partitions' counts prefixed, so no
    single task orders them all.
    """
    if over:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*over).orderBy(*order)) - 1 + offset).cast("long"))
    from parquarry.session import scratch

    spark = df.sparkSession
    path = scratch(spark, "row-count")  # written once: ranges must not be sampled anew for the counts
    df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    sizes = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return rows.join(F.broadcast(sizes), "_part").withColumn(name, (F.col("_before") + within + offset).cast("long")).drop("_part", "_at", "_before")


def explode_all(df: DataFrame) -> DataFrame:
    """Every array column exploded, one after another; empty and null arrays keep their row."""
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            df = df.withColumn(f.name, F.explode_outer(col(f.name)))
    return df


def unnest_all(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every struct column replaced by its fields, until none is left."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        out = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                out += [col(f.name)[g.name].alias(f"{f.name}{separator}{g.name}") for g in f.dataType]
            else:
                out.append(col(f.name))
        df = df.select(*out)
    return df


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without columns that hold nulls only; one aggregation. A frame without rows keeps all."""
    counts = df.agg(F.count(F.lit(1)).alias("all"), *[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[col(c) for i, c in enumerate(df.columns) if counts[f"c{i}"] or not counts["all"]])


def partition_by(df: DataFrame, columns: Sequence[str] = ()) -> list[tuple[dict, DataFrame]]:
    """(values, rows without those columns) for each combination; lazily filtered frames.

    Meant for columns of few values: the list is as long as there are combinations.
    """
    if not columns:
        return [({}, df)]
    out = []
    for r in df.select(*columns).distinct().orderBy(*columns).collect():
        same = reduce(lambda a, b: a & b, (col(c).eqNullSafe(F.lit(r[c])) for c in columns))
        out.append((r.asDict(), df.where(same).drop(*columns)))
    return out


def delta(left: DataFrame, right: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``left`` that ``right`` lacks, by ``subset`` or all columns; nulls are equal."""
    keys = list(subset or left.columns)
    r = right.select(*[col(k).alias(f"_r{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(lambda a, b: a & b, (col(k).eqNullSafe(F.col(f"_r{i}")) for i, k in enumerate(keys)))
    return left.join(r, same, "left_anti")


def rank_average(df: DataFrame, by: str, over: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean.

    Without ``over`` values are counted first, and their counts added up slice by slice of the values (text:
    in one slice of distinct values); no task orders all rows.
    """
    if over:
        w = Window.partitionBy(*over).orderBy(col(by))
        ties = F.count(F.lit(1)).over(Window.partitionBy(*over, col(by)))
        return df.withColumn(name, F.rank().over(w) + (ties - 1) / F.lit(2.0))
    each = df.groupBy(col(by).alias("_rank_value")).agg(F.count(F.lit(1)).alias("_n"))
    each = each.withColumn("_slice", slice_of(each, "_rank_value", default_slices(df.sparkSession)))
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = each.groupBy("_slice").agg(F.sum("_n").alias("_sum"))  # a row a slice
    sums = sums.select("_slice", F.coalesce(F.sum("_sum").over(up_to(Window.orderBy("_slice"))), F.lit(0)).alias("_below"))
    within = F.coalesce(F.sum("_n").over(up_to(Window.partitionBy("_slice").orderBy("_rank_value"))), F.lit(0))
    ranks = each.withColumn("_within", within).join(sums, "_slice").select("_rank_value", (F.col("_below") + F.col("_within") + 1 + (F.col("_n") - 1) / F.lit(2.0)).alias("_rank_made"))
    kept = [col(c) for c in df.columns if c != name]
    return df.join(ranks, col(by).eqNullSafe(F.col("_rank_value"))).select(*kept, F.col("_rank_made").alias(name))


def is_duplicated(df: DataFrame) -> int:
    """Rows that occur more than once."""
    return df.groupBy(*df.columns).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
