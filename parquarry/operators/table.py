"""Table: a handle on a DataFrame with the filter, sort, scan and export surface of the library."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame

from parquarry.functions.types import col
from parquarry.plans import sqltext

USES = ("auto", "pyarrow", "duckdb", "spark", "path")


@dataclass(frozen=True)
class ScannerConfig:
    batch_size: int = 131072
    batch_readahead: int = 16
    fragment_readahead: int = 4


class Table:
    """Immutable; every method that changes rows gives a new Table. Lazy until exported."""

    def __init__(self, df: DataFrame):
        self._df = df

    def __call__(self, lazy: bool = True) -> DataFrame:
        return self._df

    def __repr__(self) -> str:
        return f"Table[{', '.join(f'{n}: {t}' for n, t in self._df.dtypes)}]"

    @property
    def df_(self) -> DataFrame:
        return self._df

    @property
    def schema(self):
        return self._df.schema

    @property
    def columns(self) -> list[str]:
        return self._df.columns

    @property
    def num_columns(self) -> int:
        return len(self._df.columns)

    def count_rows(self) -> int:
        return self._df.count()

    def filter(self, expr: str | Column, use: str = "auto") -> Table:
        """``use`` is accepted for callers that name an engine; there is one."""
        if use not in USES:
            raise ValueError(f"use={use!r}")
        if use == "duckdb" and not isinstance(expr, str):
            raise TypeError("use='duckdb' takes SQL text")
        return Table(sqltext.where(self._df, expr))

    def select(self, columns: str | Sequence[str]) -> Table:
        return Table(self._df.select(*[col(c) for c in ([columns] if isinstance(columns, str) else columns)]))

    project = select

    def sort(self, by: str | Sequence) -> Table:
        return Table(self._df.orderBy(*sqltext.sort_columns(by, self._df.columns)))

    def distinct(self) -> Table:
        return Table(self._df.distinct())

    def limit(self, n: int, offset: int = 0) -> Table:
        return Table((self._df.offset(offset) if offset else self._df).limit(n))

    def join(self, other: Table | DataFrame, on: str | Sequence[str] | Column, how: str = "inner") -> Table:
        """With another table, by names that both have, by SQL text over both sides, or by a condition. In
        SQL text the sides are ``l`` and ``r``."""
        right = other() if isinstance(other, Table) else other
        if isinstance(on, str) and on not in self._df.columns:
            return Table(self._df.alias("l").join(right.alias("r"), sqltext.to_condition(on), how))
        if not isinstance(on, Column):
            on = [on] if isinstance(on, str) else list(on)
            if missing := [c for c in on if c not in self._df.columns or c not in right.columns]:
                raise ValueError(f"no column {missing[0]!r} on both sides")
        return Table(self._df.join(right, on, how))

    def explain(self, mode: str = "formatted") -> str:
        """Spark's plan as text."""
        return self._df._jdf.queryExecution().explainString(self._df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))

    def head(self, n: int = 10):
        return self._df.limit(n).toPandas()

    def _scan(self, columns: str | Sequence[str] | None = None, filter: str | Column | None = None, sort_by: Any = None, distinct: bool = False, batch_size: int | None = None, batch_readahead: int | None = None, fragment_readahead: int | None = None, **_: Any) -> DataFrame:
        """Filter, then distinct of the columns if asked, then sort, then the columns alone."""
        c = ScannerConfig()
        size = c.batch_size if batch_size is None else batch_size
        for name, v in (("batch_readahead", batch_readahead), ("fragment_readahead", fragment_readahead)):
            if v is not None and v < 0:
                raise ValueError(f"{name} is negative")
        if size <= 0:
            raise ValueError("batch_size must be positive")
        df = self._df if filter is None else sqltext.where(self._df, filter)
        names = [columns] if isinstance(columns, str) else list(columns) if columns is not None else df.columns
        order = sqltext.sort_columns(sort_by, df.columns)
        if distinct:  # rows that are left apart by columns nobody asked for are one
            df = df.select(*[col(n) for n in names]).distinct()
            return df.orderBy(*sqltext.sort_columns(sort_by, df.columns)) if order else df
        df = df.orderBy(*order) if order else df
        return df.select(*[col(n) for n in names])

    def scanner(self, columns=None, filter=None, batch_size=None, sort_by=None, **how) -> Table:
        return Table(self._scan(columns, filter, sort_by, batch_size=batch_size, **how))

    def to_arrow_scanner(self, *a, **k) -> Table:
        warnings.warn("to_arrow_scanner is an old name of scanner", DeprecationWarning, stacklevel=2)
        return self.scanner(*a, **k)

    def to_scanner(self, *a, **k) -> Table:
        warnings.warn("to_scanner is an old name of scanner", DeprecationWarning, stacklevel=2)
        return self.scanner(*a, **k)

    def to_spark(self, **how) -> DataFrame:
        return self._scan(**how)

    def to_duckdb(self, lazy: bool = True, **how) -> DataFrame:
        """A DataFrame: the live one, or a snapshot in the shared folder."""
        df = self._scan(**how)
        if lazy:
            return df
        from parquarry.session import scratch

        path = scratch(df.sparkSession, "snapshot")
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def to_polars(self, *_: Any, **__: Any):
        raise NotImplementedError("no Polars here; use to_spark, to_pandas or to_arrow")

    def to_arrow_table(self, **how) -> pa.Table:
        return self._scan(**how).toArrow()

    to_arrow = to_table = to_batches = to_arrow_table

    def to_batch_reader(self, batch_size: int | None = None, **how) -> pa.RecordBatchReader:
        """Batches of at most ``batch_size`` rows, fetched a partition at a time."""
        from pyspark.sql.pandas.types import to_arrow_schema

        df = self._scan(batch_size=batch_size, **how)
        schema = to_arrow_schema(df.schema)

        def batches():
            rows: list = []
            for r in df.toLocalIterator(prefetchPartitions=True):
                rows.append(r.asDict(recursive=True))
                if len(rows) == size:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

        size = batch_size or ScannerConfig().batch_size
        return pa.RecordBatchReader.from_batches(schema, batches())

    def to_pandas(self, **how):
        return self._scan(**how).toPandas()

    to_df = to_pandas

    def to_arrow_dataset(self):
        import pyarrow.dataset as pads

        return pads.dataset(self._df.toArrow())

    arrow = property(lambda self: self.to_arrow_table())
    arrow_dataset = property(lambda self: self.to_arrow_dataset())
    df = property(lambda self: self.to_pandas())
    ddb = property(lambda self: self.to_duckdb())
    pl = property(lambda self: self.to_polars())

    def sql(self, query: str, name: str = "this") -> Table:
        """A query over the session's views, and over this table as ``name``."""
        self._df.createOrReplaceTempView(name)
        return Table(self._df.sparkSession.sql(sqltext.rewrite(query)))
