"""Preparation of what is written: sort, unique, cast, date parts, in this order."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.reshape import DATE_PARTS, timestamp_columns, with_datepart_columns
from parquarry.functions.types import col, convert_timestamps, replace_schema
from parquarry.plans import sqltext


def to_frames(spark: SparkSession, data: Any) -> list[DataFrame]:
    """A list of frames from a frame, Table, pandas, Arrow table, batch or reader, rows, or a list of such."""
    from parquarry.operators.table import Table

    if isinstance(data, Table):
        return [data()]
    if isinstance(data, DataFrame):
        return [data]
    if isinstance(data, pd.DataFrame):
        return [spark.createDataFrame(data)]
    if isinstance(data, pa.RecordBatch):
        return [spark.createDataFrame(pa.Table.from_batches([data]))]
    if isinstance(data, pa.RecordBatchReader):
        return [spark.createDataFrame(data.read_all())]
    if isinstance(data, pa.Table):
        return [spark.createDataFrame(data)]
    if hasattr(data, "to_arrow_table"):
        return [spark.createDataFrame(data.to_arrow_table())]
    if isinstance(data, Iterable):
        items = list(data)
        if items and isinstance(items[0], (dict, T.Row)):
            return [spark.createDataFrame(items)]
        return [f for x in items for f in to_frames(spark, x)]
    raise TypeError(f"can't read a {type(data).__name__}")


def unique(df: DataFrame, columns: bool | str | Sequence[str], order: Sequence | None = None) -> DataFrame:
    """Distinct rows, or the first row of each combination of ``columns`` in ``order`` (of arrival if none)."""
    void = {f.name: F.lit(None).cast("bigint") for f in df.schema if isinstance(f.dataType, T.NullType)}
    df = df.withColumns(void) if void else df
    if columns is True:
        return df.dropDuplicates()
    keys = [columns] if isinstance(columns, str) else list(columns)
    at = df.withColumn("_arrival", F.monotonically_increasing_id())
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*(order or []), "_arrival")
    return at.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_arrival")


def prepare(df: DataFrame, *, sort_by: Any = None, unique_on: bool | str | Sequence[str] | None = None, schema: T.StructType | None = None, alter_schema: bool = False, ts_unit: str | None = None, tz: str | None = None, remove_tz: bool = False, partition_by: Sequence[str] = (), timestamp_column: str | None = None) -> DataFrame:
    """A frame ready to write; nothing runs.

    With ``alter_schema`` the schema is ignored; else the frame gets the schema's columns that it has,
    in the schema's order and types, and loses the others. Partition columns named like a date part
    that the frame lacks are derived from the timestamp column.
    """
    order = sqltext.sort_columns(sort_by, df.columns)
    if order:
        df = df.orderBy(*order)
    if unique_on:
        df = unique(df, unique_on, order)
        df = df.orderBy(*order) if order else df  # distinct shuffles
    df = convert_timestamps(df, ts_unit, tz, remove_tz)
    derive = [p for p in partition_by if p in DATE_PARTS and p not in df.columns]
    if derive:
        # before the schema drops the timestamp; they are the writer's own columns
        found = timestamp_column or next(iter(timestamp_columns(df.schema)), None)
        df = with_datepart_columns(df, derive, found)
    if schema is not None and not alter_schema:
        have = set(df.columns)
        target = T.StructType([f for f in schema if f.name in have] + [df.schema[c] for c in derive if c not in schema.names])
        df = replace_schema(df, target, ts_unit or "us", tz)
    return df
