"""A YAML catalog: namespaces of tables by path and format, and SQL over all of them."""

from __future__ import annotations

import copy
import re
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parquarry.functions.types import opt_dtype, union_diagonal
from parquarry.operators.dataset import CSVDataset, Dataset, JSONDataset, ParquetDataset
from parquarry.operators.prepare import to_frames
from parquarry.plans import sqltext
from parquarry.sources.jsonfiles import read_json

KINDS = {"parquet": ParquetDataset, "csv": CSVDataset, "json": JSONDataset}


class Catalog:
    """``tables`` is a tree {namespace: {table: fields}}; fields need a path, the rest has defaults."""

    def __init__(self, spark: SparkSession, path: str, namespace: str | None = None):
        self.spark, self.path, self._only = spark, path, namespace
        self._datasets: dict[str, Dataset] = {}
        self.load_catalog()

    # -- the file
    def load_catalog(self) -> None:
        with open(self.path) as f:  # the catalog is the driver's own file
            self.params = yaml.safe_load(f) or {}
        self.params.setdefault("filesystem", {})
        tables = self.params.get("tables") or {}
        self.params["tables"] = {ns: t or {} for ns, t in tables.items() if self._only in (None, ns)}
        for conf in (self.params["filesystem"] or {}).values():
            for k, v in ((conf or {}).get("hadoop") or {}).items():
                self.spark.sparkContext._jsc.hadoopConfiguration().set(k, str(v))

    def _write(self, change) -> None:
        """The file read again, changed, and written back: others' changes stay."""
        with open(self.path) as f:
            whole = yaml.safe_load(f) or {}
        whole.setdefault("tables", {})
        change(whole["tables"])
        with open(self.path, "w") as f:
            yaml.safe_dump(whole, f, sort_keys=False)
        self.load_catalog()

    # -- what there is
    def list_namespaces(self) -> list[str]:
        return list(self.params["tables"])

    def namespace(self, name: str) -> dict:
        return self.params["tables"][name]

    def all_tables(self) -> list[str]:
        return [f"{ns}.{t}" for ns, ts in self.params["tables"].items() for t, v in ts.items() if isinstance(v, dict) and "path" in v]

    def all_filesystems(self) -> list[str]:
        return list(self.params["filesystem"] or {})

    def show_filesystem(self, name: str) -> str:
        from parquarry.functions.security import redact

        return redact(yaml.safe_dump(self.params["filesystem"][name]))

    def _name(self, table: str) -> str:
        if "." in table:
            return table
        found = [t for t in self.all_tables() if t.split(".", 1)[1] == table]
        if len(found) != 1:
            raise KeyError(f"{len(found)} tables named {table!r}")
        return found[0]

    def get(self, table: str) -> dict:
        ns, t = self._name(table).split(".", 1)
        return self.params["tables"][ns][t]

    def show(self, table: str) -> str:
        return yaml.safe_dump(self.get(table), sort_keys=False)

    def _path(self, fields: dict) -> str:
        bucket = ((self.params["filesystem"] or {}).get(fields.get("filesystem", ""), None) or {}).get("bucket")
        path = fields["path"]
        return f"{bucket.rstrip('/')}/{path}" if bucket and "://" not in path and not path.startswith("/") else path

    def files(self, table: str) -> list[str]:
        return self._dataset(self._name(table)).files

    def schema(self, table: str):
        return self.load(table).schema

    # -- loading
    def _dataset(self, name: str) -> Dataset:
        fields = self.get(name)
        kind = fields.get("format", "parquet")
        cls = KINDS.get(kind, Dataset)
        view = name.replace(".", "__")
        extra = {"partitioning": fields["partitioning"]} if fields.get("partitioning") else {}
        if cls is Dataset:
            extra["format"] = kind
        return cls(self.spark, self._path(fields), name=view, timestamp_column=fields.get("timestamp_column"), **extra)

    def load(self, table: str, as_dataset: bool = True, reload: bool = False, **how: Any) -> Dataset | DataFrame:
        """The dataset, kept under its name; or its rows read directly."""
        name = self._name(table)
        if not as_dataset:
            return self.read(name, **how)
        if reload or name not in self._datasets:
            ds = self._dataset(name)
            self._datasets[name] = ds.load()
        return self._datasets[name]

    get_table = load

    def read(self, table: str, include_file_path: bool = False, batch_size: int | None = None, concat: bool = True, opt_dtypes: bool = False) -> DataFrame:
        """All files' rows in the columns of all files; ``opt_dtypes`` gives text columns the types they spell."""
        if batch_size or not concat:
            raise ValueError("a direct read gives one frame")
        name = self._name(table)
        ds = self._dataset(name)
        if not ds.has_files:
            raise FileNotFoundError(f"No {ds.format.upper()} files in {ds.path}")
        if ds.format in ("csv", "json"):
            opts = {"header": "true", "inferSchema": "true"}
            uris = [ds.storage.full(f) for f in ds.files]
            frames = [self.spark.read.options(**opts).csv(u) if ds.format == "csv" else read_json(self.spark, [u]) for u in uris]
            frames = [f.withColumn("file_path", F.col("_metadata.file_path")) if include_file_path else f for f in frames]
            return union_diagonal(frames)
        df = ds._read(file_col="file_path" if include_file_path else None)
        return opt_dtype(df, exclude=["file_path"]) if opt_dtypes else df

    # -- SQL
    def sql(self, query: str) -> DataFrame:
        """A query that names tables of the catalog as namespace.table or table."""
        have = {t.name for t in self.spark.catalog.listTables()}
        known = {n.lower(): n for n in self.all_tables()}
        for found in sqltext.table_names(self.spark, query):
            name = known.get(found.lower())
            if name is None and "." not in found and found not in have:
                hits = [n for n in self.all_tables() if n.split(".", 1)[1].lower() == found.lower()]
                name = hits[0] if len(hits) == 1 else None
            if name is None:
                continue
            self.load(name)
            view = name.replace(".", "__")
            # quoted text stays as it is
            pattern = re.compile(r"'(?:[^']|'')*'|(?<![\w.`])" + r"\s*\.\s*".join(f"`?{re.escape(p)}`?" for p in found.split(".")) + r"(?![\w(])(?!\s*\.\s*\*?\w*\s*\()", re.I)
            bare = found.split(".")[-1]
            query = pattern.sub(lambda m, v=view: m.group() if m.group().startswith("'") else v, query) if "." in found else self._bare(query, bare, view)
        return self.spark.sql(sqltext.rewrite(query))

    query = sql

    def _bare(self, query: str, table: str, view: str) -> str:
        """A view under the table's own name does for names without a namespace."""
        self.spark.table(view).createOrReplaceTempView(table)
        return query

    def registered_tables(self) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables()]

    # -- changing
    def create_namespace(self, name: str) -> None:
        self._write(lambda tables: tables.setdefault(name, {}))

    def create_table(self, table: str, data: Any = None, namespace: str = "default", path: str | None = None, format: str = "parquet", overwrite: bool = False, write_args: dict | None = None, **fields: Any) -> None:
        exists = table in (self.params["tables"].get(namespace) or {})
        if exists and not overwrite:
            raise ValueError(f"{namespace}.{table} exists")
        if isinstance(data, Dataset):
            path, format = path or data.path, data.format
            if data.path == path:
                data = None
        if path is None:
            raise ValueError("a table needs a path")
        entry = {"path": path, "format": format, "write_args": write_args or {}, **fields}
        self._write(lambda tables: tables.update({namespace: {**(tables.get(namespace) or {}), table: entry}}))
        if data is not None:
            self.write_table(data, f"{namespace}.{table}", mode="overwrite")

    def write_table(self, data: Any, table: str, as_dataset: bool = True, update_catalog: bool = False, **write_args: Any) -> None:
        name = self._name(table)
        fields = self.get(name)
        args = {**(fields.get("write_args") or {}), **write_args}
        if isinstance(data, Dataset):
            data = data._read()
        if as_dataset and fields.get("format", "parquet") == "parquet":
            self._dataset(name).write_to_dataset(data, **args)
        else:
            mode = args.get("mode", "append")
            for i, f in enumerate(to_frames(self.spark, data)):
                w = f.write.mode(mode if i == 0 else "append").format(fields.get("format", "parquet"))
                (w.option("header", "true") if fields.get("format") == "csv" else w).save(self._path(fields))
        self._datasets.pop(name, None)
        if update_catalog:
            self.update(name, write_args=args)

    def update(self, table: str, write_args: dict | None = None, **fields: Any) -> None:
        ns, t = self._name(table).split(".", 1)

        def change(tables: dict) -> None:
            entry = copy.deepcopy(tables[ns][t])
            entry.update(fields)
            if write_args is not None:
                entry["write_args"] = {**(entry.get("write_args") or {}), **write_args}
            tables[ns][t] = entry

        self._write(change)

    def delete_table(self, table: str, vacuum: bool = False) -> None:
        name = self._name(table)
        if vacuum:
            self._dataset(name).vacuum()
        ns, t = name.split(".", 1)
        self.spark.catalog.dropTempView(name.replace(".", "__"))
        self._datasets.pop(name, None)
        self._write(lambda tables: tables[ns].pop(t))
