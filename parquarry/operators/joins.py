"""Joins that Spark's SQL has no syntax for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parquarry.functions.slices import default_slices, slice_of
from parquarry.functions.types import col


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: Sequence[str] = (), prefix: str = "right_", slices: int | None = None) -> DataFrame:
    """Each left row with the latest right row of its ``by`` group at or before it (nulls: none).

    Both sides are stacked and sorted once by group and time; a left row takes the last right row
    seen. No pairs are made, so dense times cost nothing more. A group's times are cut into ``slices``, each a
    task's, and a slice begins with the last right row of those before it: by default as many as shuffles have
    partitions (256 at most) without ``by``, else one; give more where one group is too much for a task.
    """
    values = [c for c in right.columns if c not in by]
    keep = F.struct(*[col(c) for c in left.columns]).alias("l")
    a = left.select(*[col(b) for b in by], col(left_on).alias("_t"), F.lit(1).alias("_side"), keep, F.lit(None).cast(right.select(F.struct(*[col(c) for c in values]).alias("r")).schema["r"].dataType).alias("r"))
    b = right.where(col(right_on).isNotNull()).select(*[col(b) for b in by], col(right_on).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(keep).schema["l"].dataType).alias("l"), F.struct(*[col(c) for c in values]).alias("r"))
    rows = a.unionByName(b)
    if slices is None:
        slices = 1 if by else default_slices(left.sparkSession)
    rows = rows.withColumn("_slice", slice_of(rows.select("_t"), "_t", slices))
    w = Window.partitionBy(*[col(c) for c in by], "_slice").orderBy(F.col("_t").asc_nulls_first(), "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("m", F.last("r", ignorenulls=True).over(w)).where("_side = 1")
    if slices > 1:
        # one row a group and slice that has right rows; each goes to the slices up to the next such one
        last = rows.where("_side = 0").groupBy(*[col(c) for c in by], "_slice").agg(F.max_by("r", "_t").alias("_last"))
        every = rows.select(*[col(c) for c in by], "_slice").distinct().withColumnsRenamed({c: f"_by_{i}" for i, c in enumerate(by)} | {"_slice": "_at"})
        same = [col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)]
        before = Window.partitionBy(*[f"_by_{i}" for i in range(len(by))]).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        on = F.col("_at") == F.col("_slice")
        for x in same:
            on = x & on
        carry = every.join(last, on, "left").drop(*by, "_slice").withColumn("_carry", F.last("_last", ignorenulls=True).over(before)).drop("_last")
        out = out.join(carry, on, "left").withColumn("m", F.coalesce("m", "_carry"))
    hit = F.when(F.col("_t").isNotNull(), F.col("m"))
    return out.select("l.*", *[hit[c].alias(f"{prefix}{c}") for c in values])
