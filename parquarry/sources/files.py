"""Single files and paths outside any dataset: filtered reads, one file with its path's values, one file out."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.misc import get_partitions_from_path
from parquarry.functions.types import col, replace_schema
from parquarry.operators import publish
from parquarry.operators.prepare import to_frames
from parquarry.plans import sqltext
from parquarry.sources.storage import Storage

#: Names of engines that callers may give; there is one.
BACKENDS = (None, "auto", "spark", "pyarrow", "duckdb")


def read_parquet(spark: SparkSession, path: str, filters: str | Column | Any = None, columns: str | Sequence[str] | None = None, backend: str | None = None) -> DataFrame:
    """A file or folder, filtered (SQL text, a column or an Arrow expression), with some of its columns."""
    if backend not in BACKENDS:
        raise ValueError(f"backend {backend!r}")
    df = spark.read.parquet(path)
    df = df if filters is None else sqltext.where(df, filters)
    return df if columns is None else df.select(*[col(c) for c in ([columns] if isinstance(columns, str) else columns)])


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, partitioning: str | Sequence[str] | None = None) -> DataFrame:
    """One file's rows. Values that its path holds (``hive``, or names for its folders) are text columns,
    in place of columns of their name; then cast to ``schema`` if given."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    found = get_partitions_from_path(path, partitioning) if partitioning else []
    df = df.withColumns({k: F.lit(v).cast("string") for k, v in found}) if found else df
    return replace_schema(df, schema) if schema is not None else df


def write_table(spark: SparkSession, data: Any, path: str, compression: str = "zstd", row_group_size: int | None = None) -> str:
    """One frame as one file of this name: written by one task, beside its place, and moved in. Its name."""
    if row_group_size is not None:
        warnings.warn("row_group_size has no effect", DeprecationWarning, stacklevel=2)
    frames = to_frames(spark, data)
    if len(frames) != 1:
        raise ValueError("one file takes one frame")
    folder, _, name = path.rstrip("/").rpartition("/")
    storage = Storage(spark, folder or ".")
    staged = publish.stage(storage, frames[0].coalesce(1), compression=compression)
    try:
        found = Storage(spark, storage.full(staged)).files(".parquet")
        if storage.exists(name):
            storage.delete(name)
        storage.rename(f"{staged}/{found[0]}", name)
    finally:
        storage.delete(staged)
    return storage.full(name)
