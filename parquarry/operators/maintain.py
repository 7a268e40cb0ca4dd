"""Maintenance of Parquet datasets. Every rewrite is planned, staged, checked and then published."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from datetime import timedelta
from functools import reduce
from typing import TYPE_CHECKING, Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions.misc import parse_interval, run_parallel
from parquarry.functions.reshape import DATE_PARTS, timestamp_columns, with_datepart_columns
from parquarry.functions.types import col, propose_types, replace_schema
from parquarry.operators import publish
from parquarry.plans import sqltext, stats
from parquarry.sources.storage import Storage, partition_values

if TYPE_CHECKING:
    from parquarry.operators.dataset import ParquetDataset

MAX_ROWS = 10_000_000


def file_schemas(storage: Storage, files: Sequence[str]) -> dict[str, pa.Schema]:
    """Arrow schemas of some files, from their footers, on the driver: for few files."""
    import pyarrow.parquet as pq

    def one(f: str) -> pa.Schema:
        with stats.open_file(storage.full(f)) as h:
            return pq.read_schema(h)

    return dict(zip(files, run_parallel(one, files, n_jobs=16), strict=True))


def _rewrite(ds: ParquetDataset, df: DataFrame, old: Sequence[str], parts: Sequence[str], compression: str, max_rows: int | None, expect: int | None) -> list[str]:
    """``df`` in place of the files ``old``; the staged rows are counted first if a number is expected."""
    staged = None
    try:
        staged = publish.stage(ds.storage, df, parts, compression, max_rows)
        if expect is not None:
            got = sum(r[0] for r in ds.spark.read.option("basePath", ds.storage.full(staged)).parquet(ds.storage.full(staged)).groupBy().count().collect())
            if got != expect:
                raise RuntimeError(f"staged {got} rows of {expect}")
        return publish.publish(ds.storage, staged, old)
    except publish.PartialWriteError as e:
        raise RuntimeError(f"{e}; new files: {e.files}; remove by hand what is left of: {list(old)}") from e
    except Exception as e:
        if staged:
            ds.storage.delete(staged)
        raise RuntimeError(f"rewrite failed, the dataset is as it was: {e}") from e


def _refresh(ds: ParquetDataset) -> None:
    ds.reset_scan()
    ds.stats()
    ds.load()


def _checked(how: dict[str, Any], known: Sequence[str]) -> None:
    if how.pop("row_group_size", None) is not None:
        warnings.warn("row_group_size has no effect", DeprecationWarning, stacklevel=4)
    if unknown := [k for k in how if k not in known]:
        raise TypeError(f"unexpected argument {unknown[0]!r}")


def compact(ds: ParquetDataset, *, by_partition: bool, max_rows_per_file: int = MAX_ROWS, sort_by: Any = None, compression: str = "zstd", unique: bool | Sequence[str] = False, dry_run: bool = False, files: Sequence[str] | None = None, **how: Any) -> list[dict] | None:
    """Many small files into few, per partition; sorted within and across files with ``sort_by``.

    Candidates have several files of fewer than ``max_rows_per_file`` rows on average, or are all with
    ``sort_by``. One job rewrites all of them. The plan is returned with ``dry_run``, else None.
    """
    _checked(how, ())
    names = ds.partition_names
    physical = [c for c in ds._read().columns if c not in names] if ds.has_files else []
    if unique and sort_by and unique is not True:
        raise ValueError("unique columns and sort_by exclude one another")
    if unique and not physical:
        raise ValueError("only partition columns to be unique by")
    if sort_by:
        sqltext.sort_columns(sort_by, ds._read().columns)
        unique = False if unique is True else unique
    wanted = set(files) if files is not None else None
    rows: dict[tuple, list] = {}
    for r in ds.stats().groupBy("file_path").agg(F.sum("num_rows").alias("n")).orderBy("file_path").collect() if ds.has_files else []:
        if wanted is None or r["file_path"] in wanted:
            key = tuple(partition_values(r["file_path"]).items()) if by_partition else ()
            rows.setdefault(key, []).append((r["file_path"], r["n"]))
    todo = {k: v for k, v in rows.items() if sort_by or len(v) > 1 and sum(n for _, n in v) < max_rows_per_file * len(v)}
    plan = [{"partition": dict(k), "files": [f for f, _ in v], "rows": sum(n for _, n in v), "planned_groups": -(-sum(n for _, n in v) // max_rows_per_file)} for k, v in sorted(todo.items(), key=lambda x: str(x[0]))]
    if dry_run:
        return plan
    if not plan:
        return None
    old = [f for p in plan for f in p["files"]]
    df = ds._read(old)
    if unique:
        df = df.dropDuplicates([*names, *(physical if unique is True else [unique] if isinstance(unique, str) else unique)])
    n_files = sum(p["planned_groups"] for p in plan)
    if sort_by:
        order = [col(n).asc_nulls_last() for n in names] + sqltext.sort_columns(sort_by)
        df = df.repartitionByRange(max(1, n_files), *order).sortWithinPartitions(*order)
    elif names and by_partition:
        # a partition of many files goes to as many tasks; the salt spreads its rows over them
        most = max(p["planned_groups"] for p in plan)
        salt = [F.pmod(F.xxhash64(*[col(c) for c in physical]), F.lit(most))] if most > 1 else []
        df = df.repartition(max(1, n_files), *[col(n) for n in names], *salt)
    else:
        df = df.repartition(max(1, n_files))
    _rewrite(ds, df, old, names, compression, max_rows_per_file, None if unique else sum(p["rows"] for p in plan))
    _refresh(ds)
    return None


def compact_by_time(ds: ParquetDataset, interval: str | timedelta, timestamp_column: str | None, *, max_rows_per_file: int = MAX_ROWS, sort_by: Any = None, compression: str = "zstd", unique: bool = False, dry_run: bool = False, **how: Any):
    """Compacts the files of each half-open time window, windows counted from the dataset's first time.

    A file belongs to the window of its least timestamp, the last one included.
    """
    _checked(how, ())
    if sort_by:
        return compact(ds, by_partition=bool(ds.partition_names), max_rows_per_file=max_rows_per_file, sort_by=sort_by, compression=compression, dry_run=dry_run)
    step = parse_interval(interval)
    if timestamp_column is None:
        raise ValueError("no timestamp column")
    # timestamps of statistics as microseconds: text of a fixed form, in UTC
    stat = F.col("columns")[timestamp_column]["min"].try_cast("timestamp_ntz")
    start = ds.stats().agg(F.min(stat).alias("a")).first()["a"]
    if start is None:
        raise ValueError(f"no statistics of {timestamp_column!r}")
    at = F.unix_micros(stat.cast("timestamp")) - F.lit(int((start - type(start)(1970, 1, 1)).total_seconds() * 1_000_000))
    window = F.floor(at / F.lit(int(step.total_seconds() * 1_000_000)))
    groups: dict[int, list[str]] = {}
    for r in ds.stats().groupBy("file_path").agg(F.min(window).alias("w")).orderBy("file_path").collect():
        groups.setdefault(r["w"], []).append(r["file_path"])
    plans = []
    for w in sorted(groups, key=lambda x: (x is None, x)):
        plan = compact(ds, by_partition=bool(ds.partition_names), max_rows_per_file=max_rows_per_file, compression=compression, unique=unique, dry_run=dry_run, files=groups[w])
        plans += plan or []
    return plans if dry_run else None


def repartition(ds: ParquetDataset, columns: Sequence[str] | str, *, compression: str = "zstd", max_rows_per_file: int = MAX_ROWS, dry_run: bool = False, derived_partition_columns: Sequence[str] = (), timestamp_column: str | None = None, unique: bool = False, sort_by: Any = None, partition_timezone: str | None = None, target_mb_per_file: float | None = None, **how: Any):
    """All files into Hive folders of ``columns``; rows are kept as they are, repeated ones too.

    Date parts are those of ``partition_timezone`` if given (times are UTC). ``target_mb_per_file`` bounds
    rows a file by what rows take on average now. ``memory_budget_mb`` has no effect: Spark spills.
    """
    _checked(how, ("memory_budget_mb",))
    names = [columns] if isinstance(columns, str) else list(columns)
    if not names:
        raise ValueError("no columns to partition by")
    if sort_by:
        raise ValueError("repartition does not sort")
    df = ds._read()
    derive = [c for c in names if c not in df.columns and (c in DATE_PARTS or c in derived_partition_columns)]
    if missing := [c for c in names if c not in df.columns and c not in derive]:
        raise ValueError(f"no column {missing[0]!r}")
    if derive:
        at = timestamp_column or ds.timestamp_column or next(iter(timestamp_columns(df.schema)), None)
        if partition_timezone is None:
            df = with_datepart_columns(df, derive, at)
        else:
            kept = df.columns
            df = df.withColumn("_local", F.from_utc_timestamp(col(at), partition_timezone).cast("timestamp_ntz"))
            df = with_datepart_columns(df, derive, "_local").select(*[col(c) for c in [*kept, *derive]])
    if target_mb_per_file is not None:
        n, size = ds.stats().agg(F.sum("num_rows"), F.sum("total_byte_size")).first()
        max_rows_per_file = max(1, min(max_rows_per_file, int(target_mb_per_file * 1e6 * (n or 1) / (size or 1))))
    if unique:
        warnings.warn("unique=True: use compaction", DeprecationWarning, stacklevel=3)
        df = df.dropDuplicates()
    old = ds.files
    if dry_run:
        return [dict(zip([*names, "rows"], r, strict=True)) for r in df.groupBy(*names).count().orderBy(*names).collect()]
    # rebalance splits large partitions over tasks and gathers small ones
    df = df.hint("rebalance", *[col(c) for c in names])
    _rewrite(ds, df, old, names, compression, max_rows_per_file, None if unique else ds._read().count())
    ds.partitioning = "hive"
    _refresh(ds)
    return None


def _respelled(value: Column, new: str) -> Column:
    """A cast value as text in the form of ``_plain_number``."""
    return _plain_number(value.cast("string")) if new in ("float", "double") else value.cast("string")


def _plain_number(text: Column) -> Column:
    """The text of a number without what says nothing: "1.50" is "1.5", "2.0" is "2", "1.5E3" is "1500".
    Leading zeros and signs say something: "00501" is a code."""
    exact = text.try_cast("decimal(38,18)").cast("string")
    short = F.regexp_replace(F.regexp_replace(exact, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    # what isn't a plain decimal is compared as it stands
    return F.when(text.rlike(r"^-?(0|[1-9][0-9]*)(\.[0-9]{1,18})?([eE][+-]?[0-9]+)?$") & short.isNotNull(), short).otherwise(text)


def _cast(df: DataFrame, c: str, t: str) -> Column:
    return (F.trim(col(c)) if isinstance(df.schema[c].dataType, T.StringType) else col(c)).try_cast(t)


def _misfits(df: DataFrame, wanted: Sequence[tuple[str, str]], strict: bool) -> dict[tuple[str, str], int]:
    """How many values of a column a type can't hold, of the (column, type) pairs with any; one aggregation.
    With ``strict`` the new value must spell the old text, or be the old number; else it must be one at all."""
    lost = []
    for c, t in wanted:
        text = isinstance(df.schema[c].dataType, T.StringType)
        new, wrong = _cast(df, c, t), F.lit(False)
        if strict:
            wrong = _respelled(new, t) != _plain_number(F.trim(col(c))) if text else new.cast(df.schema[c].dataType) != col(c)
        lost.append(F.count_if(col(c).isNotNull() & (new.isNull() | wrong)))
    row = df.agg(*[v.alias(f"n{i}") for i, v in enumerate(lost)]).first() if lost else ()
    return {p: n for p, n in zip(wanted, row, strict=True) if n}


def _widened(df: DataFrame, found: dict[str, str], strict: bool) -> dict[str, str]:
    """Types that hold all rows in place of those in ``found``. A column that none narrower than its own does is left out."""
    made = propose_types(df, list(found), shrink=True) if found else {}
    text = [c for c, t in made.items() if t == "float" and isinstance(df.schema[c].dataType, T.StringType)]
    pairs = [*made.items(), *[(c, "double") for c in text]]
    bad = _misfits(df, pairs, strict)
    out: dict[str, str] = {}
    for c, t in pairs:
        if (c, t) not in bad:
            out.setdefault(c, t)
    return out


def _proposed(df: DataFrame, include: Sequence[str] | None, exclude: Sequence[str], first: int | None, strict: bool) -> tuple[dict[str, str], dict[tuple[str, str], int]]:
    """Types proposed from the ``first`` rows and widened to all, and the misfits of those that don't even hold the first."""
    # which rows are the first may change from read to read: they are kept for both looks
    look = df if first is None else df.select(*[col(c) for c in df.columns if c not in exclude]).limit(first).persist()
    try:
        found = propose_types(look, include, exclude, shrink=True)
        bad = _misfits(df, list(found.items()), strict)
        early = bad if first is None else _misfits(look, list(bad), strict)
    finally:
        if first is not None:
            look.unpersist()
    late = {c: t for c, t in bad if (c, t) not in early}
    wider = _widened(df, late, strict)
    return {c: wider.get(c, t) for c, t in found.items() if c not in late or c in wider}, {p: n for p, n in bad.items() if p in early}


def optimize_dtypes(ds: ParquetDataset, *, include: Sequence[str] | None = None, exclude: Sequence[str] = (), strict: bool = True, types: dict[str, str] | None = None, infer_schema_size: int | None = 10_000, compression: str = "zstd", dry_run: bool = False, **how: Any) -> dict[str, str] | None:
    """Narrower types, proposed from the first rows (or given) and checked on all rows before any file changes.

    A proposal that holds the first rows and not all is widened until it does, or dropped. ``strict``: a value that
    a given type, or of the first rows that the proposal, can't hold exactly stops the rewrite. Else such become null.
    """
    _checked(how, ("ts_unit", "tz", "max_rows_per_file"))
    df = ds._read()
    if types is not None:
        found = dict(types)
        bad = _misfits(df, list(found.items()), strict) if strict and not dry_run else {}
    else:
        found, bad = _proposed(df, include, [*exclude, *ds.partition_names], infer_schema_size, strict)
    if dry_run:
        return found
    if strict and bad:
        raise RuntimeError(f"values that don't fit: { {c: n for (c, _), n in bad.items()} }; no file was changed")
    if not found:
        return None
    out = df.withColumns({c: _cast(df, c, t) for c, t in found.items()})
    _rewrite(ds, out, ds.files, ds.partition_names, compression, None, df.count())
    ds._schema = None
    _refresh(ds)
    return None


def repair_schema(ds: ParquetDataset, schema: T.StructType | None = None, *, dry_run: bool = False, compression: str = "zstd", **how: Any) -> dict | None:
    """Files whose schema differs from the target (by default the common one of all files), rewritten.

    Files that differ only in what Spark doesn't tell apart (large and ordinary text, unsigned and the
    next signed type) count as different too: footers decide.
    """
    _checked(how, ("ts_unit", "tz", "format_version", "alter_schema"))
    if not ds.has_files:
        return {"files": [], "schema": schema} if dry_run else None
    target = schema or ds.common_schema()
    key = lambda s: sorted((f.name, f.dataType.simpleString()) for f in s)
    # a few distinct schemas; the names of the files that have an odd one
    table = ds.stats()
    kinds = table.select("spark_schema", F.array_sort(F.array_distinct(F.map_values("types"))).alias("kinds")).distinct().collect()
    plain = lambda kinds: not any(k.startswith(("large_", "uint")) for k in kinds)
    bad = [(r["spark_schema"], r["kinds"]) for r in kinds if key(stats.parse_schema(r["spark_schema"])) != key(target) or not plain(r["kinds"])]
    found: dict[str, list[str]] = {}
    if bad:
        wanted = ds.spark.createDataFrame(bad, "spark_schema string, kinds array<string>")
        rows = table.withColumn("kinds", F.array_sort(F.array_distinct(F.map_values("types")))).join(wanted, ["spark_schema", "kinds"], "left_semi").select("file_path", "spark_schema").distinct()
        for r in rows.collect():
            found.setdefault(r["spark_schema"], []).append(r["file_path"])
    odd = sorted(f for fs in found.values() for f in fs)
    if dry_run:
        return {"files": odd, "schema": target}
    if not odd:
        return None
    names = ds.partition_names
    parts = [ds._read_one(fs) for fs in found.values()]
    full = T.StructType([*target.fields, *[parts[0].schema[n] for n in names if n not in target.names]])
    df = reduce(lambda a, b: a.unionByName(b), [replace_schema(p, full) for p in parts])
    _rewrite(ds, df, odd, names, compression, None, sum(p.count() for p in parts))
    ds._schema = None
    _refresh(ds)
    return None
