"""Keyed merge into a Parquet dataset: insert, update, upsert, with null-safe keys."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.types import col, replace_schema, union_diagonal
from parquarry.operators import publish
from parquarry.operators.prepare import prepare, to_frames
from parquarry.plans import sqltext, stats

if TYPE_CHECKING:
    from parquarry.operators.dataset import ParquetDataset

STRATEGIES = ("insert", "update", "upsert")


@dataclass
class MergeResult:
    strategy: str
    source_count: int = 0
    target_count_before: int = 0
    target_count_after: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    files: list[str] = field(default_factory=list)
    rewritten_files: list[str] = field(default_factory=list)
    inserted_files: list[str] = field(default_factory=list)
    preserved_files: list[str] = field(default_factory=list)


class PartialMergeError(RuntimeError):
    """The merge is done (``result``) but the dataset could not be loaded again."""

    def __init__(self, message: str, result: MergeResult):
        super().__init__(message)
        self.result = result


def _same(keys: Sequence[str], other: str = "_k_") -> Column:
    return reduce(lambda a, b: a & b, (col(k).eqNullSafe(F.col(f"{other}{i}")) for i, k in enumerate(keys)))


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[col(k).alias(f"_k_{i}") for i, k in enumerate(keys)])


def last_of_each(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key, in the order of ``_frame`` and ``_row``, which go."""
    w = Window.partitionBy(*[col(k) for k in keys]).orderBy(F.col("_frame").desc(), F.col("_row").desc())
    return rows.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth", "_frame", "_row")


def _numbered(frames: list[DataFrame]) -> DataFrame:
    return union_diagonal([f.withColumns({"_frame": F.lit(i), "_row": F.monotonically_increasing_id()}) for i, f in enumerate(frames)])


#: Key types whose range prunes files.
_RANGED = (T.IntegralType, T.DecimalType, T.DateType, T.TimestampNTZType)


def _touched(table: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Statistics of files that may hold a key of ``source``: those whose ranges meet the source's least
    and greatest value of every key, or that may hold nulls where the source has some."""
    ranged = [k for k in keys if isinstance(source.schema[k].dataType, _RANGED)]
    if not ranged:
        return table
    found = source.agg(*[f(col(k)).cast("string").alias(f"{n}{i}") for i, k in enumerate(ranged) for n, f in (("a", F.min), ("z", F.max))], *[F.count_if(col(k).isNull()).alias(f"n{i}") for i, k in enumerate(ranged)]).first()
    may = F.lit(True)
    for i, k in enumerate(ranged):
        kind = "number" if isinstance(source.schema[k].dataType, (T.IntegralType, T.DecimalType)) else "timestamp"
        meets = F.lit(False)
        if found[f"a{i}"] is not None:
            meets = stats.keeps(sqltext.Atom(k, ">=", kind, None, found[f"a{i}"])) & stats.keeps(sqltext.Atom(k, "<=", kind, None, found[f"z{i}"]))
        if found[f"n{i}"]:
            meets |= F.coalesce(F.col("columns")[k]["null_count"] > 0, F.lit(True))
        # a partition column has no statistics, nor has a column that some files lack
        may &= F.coalesce(meets | ~F.map_contains_key("columns", F.lit(k)), F.lit(True))
    return table.where(may)


def merge(ds: ParquetDataset, data: Any, strategy: str, key_columns: Sequence[str] | str | None = None, *, partition_by: Sequence[str] | str | None = None, backend: str | None = None, compression: str = "zstd", max_rows_per_file: int = 10_000_000, sort_by: Any = None, unique: Any = None, ts_unit: str | None = None, tz: str | None = None, remove_tz: bool = False, alter_schema: bool = False) -> MergeResult:
    """Rows of ``data`` against the dataset's by key: ``insert`` adds unknown keys, ``update`` replaces
    known ones, ``upsert`` does both.

    Only files whose statistics allow a key of the source are read for keys, once, and only those that
    hold a replaced one are rewritten. Keys are matched by joins that any number of rows may take; what
    comes to the driver is names of files and counts.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r}")
    if backend not in (None, "auto", "spark", "pyarrow", "duckdb"):
        raise ValueError(f"backend {backend!r}")
    keys = [key_columns] if isinstance(key_columns, str) else list(key_columns) if key_columns is not None else None
    if keys is not None and not keys:
        raise ValueError("no key columns")
    frames = to_frames(ds.spark, data)
    exists = ds.has_files
    target = ds._read() if exists else None
    table = ds.stats() if exists else None
    before = table.agg(F.sum("num_rows")).first()[0] if exists else 0
    result = MergeResult(strategy, target_count_before=before, target_count_after=before, files=ds.files)
    if not frames:
        if keys is None:
            raise ValueError("an empty list has no columns to take keys from")
        ds.last_merge_result = result
        return result
    parts = list([partition_by] if isinstance(partition_by, str) else partition_by or ds.partition_names)
    cast = target is not None and not alter_schema
    schema = target.schema if cast else None
    frames = [prepare(f, schema=schema, alter_schema=alter_schema, sort_by=sort_by, unique_on=unique, ts_unit=ts_unit, tz=tz, remove_tz=remove_tz, partition_by=parts, timestamp_column=ds.timestamp_column) for f in frames]
    if keys is None:
        keys = [c for c in frames[0].columns if all(c in f.columns for f in frames)]
    for f in frames:
        if missing := [k for k in keys if k not in f.columns]:
            raise ValueError(f"key column {missing[0]!r} is not in the source")
    if exists and (missing := [k for k in keys if k not in target.columns]):
        raise ValueError(f"key column {missing[0]!r} is not in the dataset")
    # a source may be another one each time it is computed, so it is computed once
    work = f"_merge-{uuid.uuid4().hex}"
    staged: list[str] = []
    old: list[str] = []
    inserted_stage = None
    try:
        counted = Observation()
        rows = _numbered(frames).observe(counted, F.count(F.lit(1)).alias("n"))
        source = last_of_each(rows, keys)
        source = replace_schema(source, target.schema) if cast else source
        source = _kept(ds, source, f"{work}/source")
        result.source_count = counted.get["n"]
        if exists:
            files = [r[0] for r in _touched(table, source, keys).select("file_path").distinct().collect()]
            wanted = source.select(*[col(k).alias(f"_k_{i}") for i, k in enumerate(keys)], F.struct(*[col(c) for c in source.columns]).alias("_new"))
            extra = [p for p in parts if p not in keys and p in target.columns and p in source.columns]
            moves = reduce(lambda a, b: a | b, (~col(p).cast("string").eqNullSafe(F.col("_new")[p].cast("string")) for p in extra), F.lit(False))
            if files:
                # the one scan of the target's keys: known keys of the source, and the files that hold them
                located = ds._read(files, file_col="_file").select("_file", *[col(c) for c in dict.fromkeys([*keys, *extra])])
                hit = located.join(wanted, _same(keys)).select("_file", moves.alias("_moves"), *[F.col(f"_k_{i}") for i in range(len(keys))]).distinct()
                hit = _kept(ds, hit, f"{work}/hit")
                known = hit.drop("_file", "_moves").distinct()
            else:
                hit = known = None
            if strategy != "insert" and known is not None:
                if extra and not hit.where("_moves").isEmpty():
                    raise ValueError("the merge would move existing keys to other partitions")
                result.updated = known.count()
                if result.updated:
                    old = sorted(ds.storage.relative(_decoded(r[0])) for r in hit.select("_file").distinct().collect())
                    rows = ds._read(old)
                    rows = replace_schema(rows, target.schema) if cast else union_diagonal([rows, source.limit(0)])
                    both = rows.join(wanted, _same(keys), "left")
                    new = both.select(*[(F.when(F.col("_new").isNotNull(), F.col("_new")[c].cast(rows.schema[c].dataType)).otherwise(col(c)) if c in source.columns else col(c)).alias(c) for c in rows.columns])
                    staged.append(publish.stage(ds.storage, new, parts, compression, max_rows_per_file))
            fresh = source.join(known, _same(keys), "left_anti") if known is not None else source
        else:
            fresh = source
        if strategy != "update":
            result.inserted = fresh.count()
            if result.inserted:
                inserted_stage = publish.stage(ds.storage, fresh, parts, compression, max_rows_per_file)
                staged.append(inserted_stage)
    except Exception:
        for s in staged:
            ds.storage.delete(s)
        raise
    finally:
        ds.storage.delete(work)
    before = ds.files
    if old:
        result.rewritten_files = publish.publish(ds.storage, staged[0], old)
    if inserted_stage:
        result.inserted_files = publish.publish(ds.storage, inserted_stage)
    if parts and ds.partitioning is None:
        ds.partitioning = "hive"
    result.target_count_after = result.target_count_before + result.inserted
    result.preserved_files = [f for f in before if f not in set(old)]
    result.files = ds.files
    ds.last_merge_result = result
    try:
        ds.load()
    except Exception as e:
        raise PartialMergeError(f"merged, but not loaded again: {e}", result) from e
    return result


def _kept(ds: ParquetDataset, df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, beside the dataset's files, where its readers don't see it."""
    df.write.parquet(ds.storage.full(name))
    return ds.spark.read.schema(df.schema).parquet(ds.storage.full(name))


def _decoded(path: str) -> str:
    """A path as _metadata has it, percent-encoded once more than the file system's."""
    from urllib.parse import unquote

    return unquote(path)
