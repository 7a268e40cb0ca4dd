"""Datasets: a folder of files with a view of its name; the Parquet one is also managed."""

from __future__ import annotations

import json
import warnings
from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.misc import get_partitions_from_path
from parquarry.functions.reshape import timestamp_columns
from parquarry.functions.types import col, convert_timestamps, replace_schema, unify_permissive, union_diagonal
from parquarry.operators import maintain, merging, publish
from parquarry.operators.prepare import prepare, to_frames
from parquarry.operators.table import Table
from parquarry.plans import sqltext, stats
from parquarry.sources.jsonfiles import read_json
from parquarry.sources.storage import Storage

MODES = ("append", "overwrite", "delta")


class Dataset:
    """Files of one format under ``path``. ``load`` makes ``t`` and the view ``name``."""

    format = "parquet"

    def __init__(self, spark: SparkSession, path: str, name: str | None = None, format: str | None = None, partitioning: str | Sequence[str] | None = None, schema: T.StructType | None = None, timestamp_column: str | None = None, options: dict[str, str] | None = None):
        self.spark, self.storage = spark, Storage(spark, path)
        self.path = self.storage.root
        self.name = name or self.path.rsplit("/", 1)[-1].split(".")[0].replace("-", "_")
        self.format = format or self.format
        self.options = options or {}
        self.timestamp_column, self._schema, self._table = timestamp_column, schema, None
        if partitioning is None and any("=" in f.split("/")[0] for f in self.files):
            partitioning = "hive"
        self.partitioning = None if partitioning == "ignore" else partitioning

    # -- files
    @property
    def files(self) -> list[str]:
        return self.storage.files("." + self.format)

    @property
    def has_files(self) -> bool:
        return bool(self.files)

    def delete_files(self, files: str | Sequence[str]) -> None:
        for f in [files] if isinstance(files, str) else files:
            self.storage.delete(self.storage.relative(f) if "://" in f or f.startswith("/") else f)
        self.spark.catalog.refreshByPath(self.path)

    def vacuum(self) -> None:
        """Deletes every data file; the folder stays. Not the vacuum of other table formats."""
        self.delete_files(self.files)

    # -- reading
    def _read(self, files: Sequence[str] | None = None, file_col: str | None = None) -> DataFrame:
        """Rows of ``files`` (all by default), with each row's file as stored by Spark in ``file_col`` if named."""
        return self._read_one(files, file_col)

    def _read_one(self, files: Sequence[str] | None = None, file_col: str | None = None) -> DataFrame:
        """Files of one schema in one scan."""
        r = self.spark.read.format(self.format).options(**self.options)
        if self._schema is not None:
            r = r.schema(self._schema)
        if self.partitioning is None:
            r = r.option("recursiveFileLookup", "true")
        paths = [self.path] if files is None else [self.storage.full(f) for f in files]
        df = r.option("basePath", self.path).load(paths)
        df = df.withColumn(file_col, F.col("_metadata.file_path")) if file_col else df
        if isinstance(self.partitioning, (list, tuple)):
            rel = F.substring_index(F.input_file_name(), self.path.split("://")[-1].lstrip("/") + "/", -1)
            df = df.withColumns({n: F.split(rel, "/")[i] for i, n in enumerate(self.partitioning)})
        # a date in a path is text to readers of other engines, so it stays text here
        days = [f.name for f in df.schema if isinstance(f.dataType, T.DateType)]
        dates = [c for c in days if c in self.partition_names] if days else []
        return df.withColumns({c: col(c).cast("string") for c in dates}) if dates else df

    def load(self) -> Dataset:
        if self.has_files:
            self._table = Table(self._read())
            if self.timestamp_column is None:
                self.timestamp_column = next(iter(timestamp_columns(self._table.schema)), None)
            self._table().createOrReplaceTempView(self.name)
        else:
            self._table = None
        return self

    @property
    def is_loaded(self) -> bool:
        return self._table is not None

    @property
    def t(self) -> Table | None:
        return self._table

    table = t

    @property
    def schema(self) -> T.StructType | None:
        return self._table.schema if self._table else self._schema

    @property
    def columns(self) -> list[str] | None:
        return self._table.columns if self._table else None

    def count_rows(self) -> int:
        return self._table.count_rows() if self._table else 0

    num_rows = property(count_rows)

    @property
    def num_columns(self) -> int:
        return self._table.num_columns if self._table else 0

    def filter(self, expr: str | Column, use: str = "auto") -> Table:
        if not self._table:
            if use != "path":  # "path" reads the files without loading
                raise RuntimeError("not loaded")
            return Table(self._read()).filter(expr, use)
        return self._table.filter(expr, use)

    # -- partitions
    @property
    def partition_names(self) -> list[str]:
        if isinstance(self.partitioning, (list, tuple)):
            return list(self.partitioning)
        files = self.files if self.partitioning == "hive" else []
        return [k for k, _ in get_partitions_from_path(files[0], "hive")] if files else []

    @property
    def partition_values(self) -> dict[str, list]:
        p = self.partitions
        return {c: sorted({r[c] for r in p}, key=lambda x: (x is None, x)) for c in self.partition_names} if p is not None else {}

    @property
    def partitions(self) -> list | None:
        """Distinct rows of the partition columns, sorted; from the paths, not the data."""
        names = self.partition_names
        if not names:
            return None
        return self._read().select(*names).distinct().orderBy(*names).collect()

    # -- session
    def registered_tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables()]

    def interrupt(self) -> None:
        self.spark.sparkContext.cancelAllJobs()

    def reset(self) -> Dataset:
        return self.load()

    # -- writing
    def _target_schema(self) -> T.StructType | None:
        if self._schema is not None:
            return self._schema
        return self._read().schema if self.has_files else None

    def _stage_all(self, frames: list[DataFrame], *, partition_by, compression, max_rows_per_file, basename, old=(), **prep) -> list[str]:
        target = self._target_schema()
        parts = list(partition_by or self.partition_names)
        staged = []
        try:
            for df in frames:
                if df.isEmpty():
                    continue  # before anything that might fail on its columns
                df = prepare(df, schema=target, partition_by=parts, timestamp_column=self.timestamp_column, **prep)
                staged.append(publish.stage(self.storage, df, parts, compression, max_rows_per_file))
        except Exception:
            for s in staged:
                self.storage.delete(s)
            raise
        new: list[str] = []
        for i, s in enumerate(staged):
            new += publish.publish(self.storage, s, old if i == len(staged) - 1 else (), f"{basename}-{i}" if basename and len(staged) > 1 else basename)
        if parts and self.partitioning is None:
            self.partitioning = "hive"
        return new

    def write_to_dataset(self, data: Any, mode: str = "append", partition_by: Sequence[str] | str | None = None, compression: str = "zstd", max_rows_per_file: int = 10_000_000, row_group_size: int | None = None, basename: str | None = None, sort_by: Any = None, unique: Any = None, ts_unit: str | None = None, tz: str | None = None, remove_tz: bool = False, alter_schema: bool = False) -> list[str]:
        """Each frame of ``data`` prepared and written; the new files. Overwriting writes first and then
        removes the files that were there before."""
        if mode not in MODES[:2]:
            raise ValueError(f"mode {mode!r}")
        old = self.files if mode == "overwrite" else []
        parts = [partition_by] if isinstance(partition_by, str) else partition_by
        return self._stage_all(to_frames(self.spark, data), partition_by=parts, compression=compression, max_rows_per_file=max_rows_per_file, basename=basename, old=old, sort_by=sort_by, unique_on=unique, ts_unit=ts_unit, tz=tz, remove_tz=remove_tz, alter_schema=alter_schema)


class CSVDataset(Dataset):
    format = "csv"

    def __init__(self, *a: Any, **k: Any):
        k["options"] = {"header": "true", "inferSchema": "true"} | (k.get("options") or {})
        super().__init__(*a, **k)


class JSONDataset(Dataset):
    """Files at the top level, each a JSON array or lines of objects."""

    format = "json"

    def load(self) -> JSONDataset:
        files = [f for f in self.files if "/" not in f]
        if not files:
            raise FileNotFoundError(f"No JSON files in {self.path}")
        df = read_json(self.spark, [self.storage.full(f) for f in files], **self.options)
        self._table = Table(df)
        df.createOrReplaceTempView(self.name)
        return self


class ParquetDataset(Dataset):
    """A managed dataset: footer statistics in a sidecar, pruning scans, keyed merge, maintenance."""

    def __init__(self, spark: SparkSession, path: str, *a: Any, **k: Any):
        self._known: dict[tuple[str, int, int], str] = {}
        super().__init__(spark, path, *a, **k)
        self.last_merge_result: merging.MergeResult | None = None
        self.reset_scan()
        if self.has_files:
            self.load()

    # -- schema and sidecar
    def raw_file_schemas(self) -> dict[str, pa.Schema]:
        """Schemas as stored, by file; from footers."""
        return maintain.file_schemas(self.storage, self.files)

    def file_schemas(self) -> dict[str, T.StructType]:
        return {f: stats.spark_schema(s) for f, s in self.raw_file_schemas().items()}

    def _schemas(self) -> list[str]:
        """The distinct schemas (json) of all files, in the order of their first files.

        A few files' footers are read here once; those of many are in the sidecar, or read by executors.
        """
        few = self.storage.few(".parquet")
        if few is None:
            rows = stats.current(self.storage).groupBy("spark_schema").agg(F.min("file_path").alias("f")).orderBy("f").collect()
            self._known = {}
            return [stats.parse_schema(r["spark_schema"]).json() for r in rows]
        found = maintain.file_schemas(self.storage, [k[0] for k in few if k not in self._known])
        self._known = {k: self._known[k] if k in self._known else stats.spark_schema(found[k[0]]).json() for k in few}
        return list(dict.fromkeys(self._known.values()))

    def _by_schema(self, files: Sequence[str] | None) -> dict[str, list[str]]:
        """Files (all by default) by their schema, for a dataset of several; after ``_schemas``."""
        by: dict[str, list[str]] = {}
        pairs = [(f, s) for (f, *_), s in self._known.items()] if self._known else stats.current(self.storage).select("file_path", "spark_schema").distinct().orderBy("file_path").toLocalIterator()
        wanted = None if files is None else set(files)
        for f, s in pairs:
            if wanted is None or f in wanted:
                by.setdefault(s, []).append(f)
        return by

    def _read(self, files: Sequence[str] | None = None, file_col: str | None = None) -> DataFrame:
        """One plan where all files of the dataset have one schema; else the files of each schema, cast to the
        common one of all, whichever files are read."""
        known = self._schemas()
        if len(known) <= 1:
            return self._read_one(files, file_col)
        common = unify_permissive([T.StructType.fromJson(json.loads(s)) for s in known])
        frames = [self._read_one(fs, file_col) for fs in self._by_schema(files).values()]
        full = T.StructType([*common.fields, *[f for f in frames[0].schema if f.name not in common.names]])
        return union_diagonal([replace_schema(f, full) for f in frames])

    def stats(self) -> DataFrame:
        """The sidecar, brought in line with the files."""
        return stats.refresh(self.storage)

    def load(self, update_metadata: bool = False, reload_metadata: bool = False, schema: T.StructType | None = None, ts_unit: str | None = None, tz: str | None = None) -> ParquetDataset:
        """Opens the dataset and its view. ``ts_unit`` and ``tz`` convert timestamps as they are read."""
        if reload_metadata:
            self.delete_metadata_files()
        if schema is not None:
            self._schema = schema
        super().load()
        if self._table and (ts_unit or tz):
            self._table = Table(convert_timestamps(self._table(), ts_unit, tz))
            self._table().createOrReplaceTempView(self.name)
        if update_metadata and self._table:
            self.stats()
        return self

    def update(self, reload: bool = False, schema: T.StructType | None = None, **how: Any) -> ParquetDataset:
        """Sidecar in line with the files, files in line with their common schema."""
        if reload:
            self.delete_metadata_files()
        if not self.has_files:
            self.delete_metadata_files()
            return self
        self.repair_schema(schema, **how)
        self.stats()
        return self.load()

    replace_schema = lambda self, schema: self.update(schema=schema)

    def delete_metadata_files(self) -> None:
        self.storage.delete(stats.SIDECAR)

    def scan_metadata(self, filter_expr: str | None = None) -> DataFrame:
        """The rows of the statistics (a row a row group) that may hold rows the filter accepts."""
        table = self.stats()
        return table if filter_expr is None else stats.matching(table, filter_expr).where("may").drop("may")

    def get_file_paths(self) -> list[str]:
        return self.files_in_metadata

    def remove_from_metadata(self, files: Sequence[str] | str) -> None:
        """Takes the rows of some files out of the sidecar; while the files exist the next use reads them anew."""
        table = stats.load(self.storage)
        if table is not None:
            stats.save(self.storage, stats.without(table, [files] if isinstance(files, str) else list(files)))

    def explain(self, filter_expr: str | None = None, mode: str = "formatted") -> str:
        """The plan that a pruned scan with the filter would run."""
        return (self.scan(filter_expr).filter(filter_expr) if filter_expr else Table(self._read())).explain(mode)

    def vacuum(self) -> None:
        super().vacuum()
        self.delete_metadata_files()
        self._table = None

    @property
    def files_in_metadata(self) -> list[str]:
        s = stats.load(self.storage)
        return sorted(r[0] for r in s.select("file_path").distinct().collect()) if s is not None else []

    def metadata_table(self) -> DataFrame:
        return stats.metadata_view(self.spark, self.stats())

    def collect_stats(self, partition_filter: str | None = None) -> dict:
        """Rows and bytes by file; only of partitions that ``partition_filter`` accepts, if given."""
        table = self.stats()
        if partition_filter is not None:
            names = self.partition_names
            table = sqltext.where(table.withColumns({n: F.col("partition")[n] for n in names}), partition_filter)
        rows = table.groupBy("file_path").agg(F.sum("num_rows").alias("num_rows"), F.sum("total_byte_size").alias("size")).orderBy("file_path").collect()
        return {"total_rows": sum(r["num_rows"] for r in rows), "files": [{"path": r["file_path"], "num_rows": r["num_rows"], "size_bytes": r["size"]} for r in rows]}

    def partition_groups(self) -> DataFrame:
        """Per partition: number of files and rows, from the statistics."""
        return self.stats().groupBy(F.map_entries("partition").alias("partition")).agg(F.countDistinct("file_path").alias("num_files"), F.sum("num_rows").alias("num_rows"))

    # -- pruning scan
    def reset_scan(self) -> None:
        self._scan_files, self.latest_filter_expr = None, None

    @property
    def is_scanned(self) -> bool:
        return self._scan_files is not None

    @property
    def scan_files(self) -> list[str]:
        return self._scan_files if self._scan_files is not None else self.files

    def scan(self, filter_expr: str | None = None) -> Table:
        """All rows of the files that may hold rows the filter accepts; apply the filter to get those."""
        self.latest_filter_expr = filter_expr
        self._scan_files = stats.prune(self.stats(), filter_expr) if filter_expr and self.has_files else self.files
        if not self._scan_files:
            return Table((self._table() if self._table else self._read()).limit(0))
        return Table(self._read(self._scan_files))

    # -- writing
    def write_to_dataset(self, data: Any, mode: str = "append", delta_subset: Sequence[str] | None = None, update_metadata: bool = False, **how: Any) -> list[str]:
        if mode not in MODES:
            raise ValueError(f"mode {mode!r}")
        if mode == "delta":
            warnings.warn("mode='delta' is merge(strategy='insert')", DeprecationWarning, stacklevel=2)
            frames = to_frames(self.spark, data)
            if delta_subset is None and self.has_files:
                target = self._read().columns
                delta_subset = [c for c in target if all(c in f.columns for f in frames)]
            keep = {k: v for k, v in how.items() if k in ("partition_by", "compression", "max_rows_per_file", "sort_by", "unique", "ts_unit", "tz", "remove_tz", "alter_schema")}
            return self.merge(frames, strategy="insert", key_columns=delta_subset, **keep).inserted_files
        new = super().write_to_dataset(data, mode, **how)
        if update_metadata:
            self.stats()
        return new

    def merge(self, data: Any, strategy: str, key_columns: Sequence[str] | str | None = None, **how: Any) -> merging.MergeResult:
        return merging.merge(self, data, strategy, key_columns, **how)

    # -- maintenance
    def compact_partitions(self, **how: Any):
        return maintain.compact(self, by_partition=True, **{"unique": True} | how)

    def compact_by_rows(self, **how: Any):
        return maintain.compact(self, by_partition=bool(self.partition_names), **{"unique": False} | how)

    def compact_by_timeperiod(self, interval, timestamp_column: str | None = None, **how: Any):
        return maintain.compact_by_time(self, interval, timestamp_column or self.timestamp_column, **how)

    def repartition(self, partitioning_columns: Sequence[str] | str, **how: Any):
        return maintain.repartition(self, partitioning_columns, **how)

    def optimize_dtypes(self, **how: Any):
        return maintain.optimize_dtypes(self, **how)

    def repair_schema(self, schema: T.StructType | None = None, **how: Any):
        return maintain.repair_schema(self, schema, **how)

    def common_schema(self) -> T.StructType:
        return unify_permissive([T.StructType.fromJson(json.loads(s)) for s in self._schemas()])
