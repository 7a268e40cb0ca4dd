"""Slices of an order, for windows over groups that one task should not hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.types import col

#: Slices at most: every row is compared with as many bounds.
MOST = 256


def _key(df: DataFrame, name: str) -> Column | None:
    """A number that never falls where the column rises; None for types that have none."""
    kind, c = df.schema[name].dataType, col(name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_date(F.to_date(c)).cast("long") * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    return c.cast("double") if isinstance(kind, T.NumericType) else None


def default_slices(spark: SparkSession) -> int:
    return max(1, min(MOST, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def slice_of(df: DataFrame, name: str, slices: int) -> Column:
    """Which of about even ``slices`` of the column's order a row is in, nulls in the first.

    The bounds are quantiles, found here by one aggregation and then fixed, so that every use of the column
    agrees. All are 0 for a type other than numbers and times.
    """
    key = _key(df, name)
    if slices < 2 or key is None:
        return F.lit(0)
    at = [i / slices for i in range(1, slices)]
    bounds = df.agg(F.percentile_approx(key, at, 10_000).alias("b")).first()["b"]
    if not bounds:
        return F.lit(0)
    bounds = sorted(set(bounds), key=lambda x: (x != x, x))
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.coalesce(b <= key, F.lit(False))))
