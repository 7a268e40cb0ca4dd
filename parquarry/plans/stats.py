"""Statistics of Parquet footers as a DataFrame, kept beside the data, and the pruning of files by them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection, Iterator, Sequence
from datetime import date, datetime
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.plans.sqltext import Atom, columns_in, parse_atom, split_and, top_level_or
from parquarry.sources.storage import Storage, partition_values

SIDECAR = "_stats"
COLUMN = "struct<min:string,max:string,null_count:bigint,distinct_count:bigint,num_values:bigint,physical_type:string,has_min_max:boolean>"
#: A row a row group. ``types`` are the file's stored types by column, ``spark_schema`` what Spark reads of
#: it (json) or, after "!", why it can't. A file is known by name, size and time of change.
SCHEMA = f"file_path string, file_size bigint, modified bigint, row_group int, num_columns int, num_rows bigint, total_byte_size bigint, compression string, partition map<string,string>, columns map<string,{COLUMN}>, types map<string,string>, spark_schema string"
#: Footers are read with this many files a task.
FILES_PER_TASK = 64


def spark_schema(schema: pa.Schema) -> T.StructType:
    """What Spark reads of a file with this stored schema."""
    from pyspark.sql.pandas.types import from_arrow_schema

    fields = []
    for f in schema:
        t = f.type
        if pa.types.is_time(t) or pa.types.is_timestamp(t) and t.unit == "ns":
            raise ValueError(f"column {f.name}: Spark can't read {t}; rewrite it as microseconds or text")
        if pa.types.is_unsigned_integer(t):
            t = {8: pa.int16(), 16: pa.int32(), 32: pa.int64(), 64: pa.decimal128(20, 0)}[t.bit_width]
        if pa.types.is_float16(t):
            t = pa.float32()
        if pa.types.is_dictionary(t):
            t = t.value_type
        fields.append(pa.field(f.name, t, True))
    return from_arrow_schema(pa.schema(fields), prefer_timestamp_ntz=True)


def open_file(uri: str):
    """A file by the name that Hadoop gives it."""
    import pyarrow.fs as pafs

    scheme, _, path = uri.partition(":")
    if scheme == "file":
        return pafs.LocalFileSystem().open_input_file("/" + path.lstrip("/"))
    fs, path = pafs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{quote(path)}")
    return fs.open_input_file(path)


def _text(v: object) -> str | None:
    if v is None or isinstance(v, bytes):
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (datetime, date)):
        return v.isoformat(" ") if isinstance(v, datetime) else v.isoformat()
    return str(v)


def read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a row group of the files named in ``uri``; runs on executors."""
    import pyarrow.parquet as pq

    names = [x.split()[0] for x in "file_path, file_size, modified, row_group, num_columns, num_rows, total_byte_size, compression, partition, columns, types, spark_schema".split(", ")]
    for b in batches:
        rows = []
        for uri, rel, size, modified in zip(b["uri"], b["file_path"], b["file_size"], b["modified"], strict=True):
            with open_file(uri) as f:
                meta = pq.read_metadata(f)
            stored = meta.schema.to_arrow_schema()
            types = {x.name: str(x.type) for x in stored}
            try:
                struct = spark_schema(stored).json()
            except ValueError as e:
                struct = f"!{e}"
            for g in range(max(1, meta.num_row_groups)):
                group = meta.row_group(g) if meta.num_row_groups else None
                cols = {}
                for i in range(group.num_columns if group else 0):
                    c = group.column(i)
                    s = c.statistics
                    ok = s is not None and s.has_min_max
                    cols[c.path_in_schema] = {"min": _text(s.min) if ok else None, "max": _text(s.max) if ok else None, "null_count": s.null_count if s is not None and s.has_null_count else None, "distinct_count": s.distinct_count if s is not None and s.has_distinct_count else None, "num_values": c.num_values, "physical_type": c.physical_type, "has_min_max": ok}
                compression = group.column(0).compression if group and group.num_columns else None
                rows.append((rel, size, modified, g, meta.num_columns, group.num_rows if group else 0, group.total_byte_size if group else 0, compression, partition_values(rel), cols, types, struct))
        if rows:
            yield pd.DataFrame(rows, columns=names)


def collect(files: DataFrame) -> DataFrame:
    """Statistics of the files of a ``Storage.listing``, read by executors."""
    n = files.count()
    return files.repartition(max(1, -(-n // FILES_PER_TASK))).mapInPandas(read_footers, SCHEMA)


def load(storage: Storage) -> DataFrame | None:
    """The newest whole sidecar."""
    found = storage.versions(SIDECAR)
    return storage.spark.read.schema(SCHEMA).parquet(storage.full(f"{SIDECAR}/{found[-1]}")) if found else None


def current(storage: Storage, suffix: str = ".parquet", save_it: bool = False) -> DataFrame:
    """The sidecar in line with the files: those that are new, or were rewritten under their name, have
    their footers read by executors, rows of gone ones are dropped. ``save_it`` writes it if it changed.

    Files are compared as tables; none of their names comes to the driver.
    """
    listed, old = storage.listing(suffix), load(storage)
    if old is None:
        out = collect(listed)
    else:
        key = ["file_path", "file_size", "modified"]
        known = old.select(*key).distinct()
        new = listed.join(known, key, "left_anti")
        same = new.isEmpty() and known.join(listed, key, "left_anti").isEmpty()
        if same:
            return old
        out = old.join(listed.select(*key), key, "left_semi").select(*old.columns).unionByName(collect(new))
    return save(storage, out) if save_it else out


def refresh(storage: Storage, suffix: str = ".parquet") -> DataFrame:
    return current(storage, suffix, save_it=True)


def save(storage: Storage, stats: DataFrame) -> DataFrame:
    """Written as a version of its own; readers take the newest that is whole, older ones go afterwards."""
    before = storage.versions(SIDECAR)
    name = f"v{max([int(x[1:13]) for x in before], default=0) + 1:012d}-{uuid.uuid4().hex[:12]}"
    # row groups are many where files are: as many partitions as footers were read in
    stats.write.parquet(storage.full(f"{SIDECAR}/{name}"))
    for x in before:
        storage.delete(f"{SIDECAR}/{x}")
    return storage.spark.read.schema(SCHEMA).parquet(storage.full(f"{SIDECAR}/{name}"))


def schemas(stats: DataFrame) -> list[T.StructType]:
    """The distinct schemas of the files; a file that Spark can't read raises."""
    return [parse_schema(r[0]) for r in stats.select("spark_schema").distinct().collect()]


def parse_schema(text: str) -> T.StructType:
    if text.startswith("!"):
        raise ValueError(text[1:])
    return T.StructType.fromJson(json.loads(text))


def without(stats: DataFrame, files: Sequence[str]) -> DataFrame:
    """``stats`` without the rows of some files."""
    gone = stats.sparkSession.createDataFrame([(f,) for f in files], "file_path string")
    return stats.join(gone, "file_path", "left_anti")


def keeps(atom: Atom) -> Column:
    """Whether a row group may hold rows that ``atom`` accepts; without comparable statistics it may.

    A number is compared exactly, and as a double too where the file's type is a whole number or a
    decimal: whichever way Spark will compare it, once files of other types have had their say, it
    stays if one of the two accepts it. A time zone's instant is compared as one.
    """
    kind, stat = F.col("types")[atom.column], F.col("columns")[atom.column]
    low, high = stat["min"], stat["max"]

    def compared(to: str, usable: Column) -> Column:
        a, b, lit = low.try_cast(to), high.try_cast(to), F.lit(atom.text).try_cast(to)
        above = lambda strict: b.isNull() | ((b > lit) if strict else (b >= lit))
        below = lambda strict: a.isNull() | ((a < lit) if strict else (a <= lit))
        may = {">": above(True), ">=": above(False), "<": below(True), "<=": below(False), "=": above(False) & below(False)}[atom.op]
        return ~usable | lit.isNull() | may

    if atom.kind == "number":
        whole = kind.rlike("^(u?int|decimal)")
        fits = ~F.lit(atom.text).rlike(_LONG_FRACTION) & ~F.coalesce(low.rlike(_LONG_FRACTION) | high.rlike(_LONG_FRACTION), F.lit(False))
        exact, real = compared("decimal(38,18)", whole & fits), compared("double", whole | kind.rlike("^(float|double|halffloat)"))
        return F.coalesce(F.when(whole, exact | real).otherwise(real), F.lit(True))
    zoned = kind.rlike("^timestamp.*tz=")
    # dates are midnights: what a file holds later on a day counts as later
    plain = compared("timestamp_ntz", kind.rlike("^(date|timestamp)") & ~zoned)
    return F.coalesce(F.when(zoned, compared("timestamp", zoned)).otherwise(plain), F.lit(True))


#: More decimals than the exact comparison holds, or an exponent.
_LONG_FRACTION = r"\.[0-9]{19,}|[eE]"


def plan(predicate: str, stat_columns: Collection[str], other_columns: set[str]) -> tuple[list[Atom], list[str]]:
    """(atoms to prune by statistics, terms on other columns of the statistics table) of a predicate.

    Terms of any other shape prune nothing, which is always safe.
    """
    if top_level_or(predicate):
        words = columns_in(predicate)
        return [], [predicate] if words & other_columns and not words & {c.lower() for c in stat_columns} else []
    atoms, terms = [], []
    for t in split_and(predicate):
        a = parse_atom(t)
        words = columns_in(t)
        if a and a.column in stat_columns:
            atoms.append(a)  # files whose type of the column can't be compared so stay
        elif words & other_columns and not words & {c.lower() for c in stat_columns}:
            terms.append(t)
    return atoms, terms


def matching(stats: DataFrame, predicate: str) -> DataFrame:
    """``stats`` plus ``may``: whether a row group may hold rows the predicate accepts. Terms on partition
    columns and on the table's own are evaluated row by row; any failure to evaluate lets all stay."""
    first = stats.agg(F.array_distinct(F.flatten(F.collect_set(F.map_keys("partition")))).alias("p"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("types")))).alias("c")).first()
    parts, cols = sorted(first["p"] or []), set(first["c"] or [])
    always = stats.withColumn("may", F.lit(True))
    taken = {c.lower() for c in stats.columns}
    if any(p.lower() in taken for p in parts):
        return always
    other = {p.lower() for p in parts} | {"file_path", "num_rows", "num_columns", "total_byte_size", "compression", "row_group"}
    table = stats.withColumns({p: F.col("partition")[p] for p in parts}) if parts else stats
    try:
        atoms, terms = plan(predicate, cols, other)
        if not atoms and not terms:
            return always
        # a partition's value is text here: a term that compares it with a number casts it
        where = reduce(lambda a, b: a & b, [*[keeps(a) for a in atoms], *[F.coalesce(F.expr(t), F.lit(True)) for t in terms]])
        return table.withColumn("may", where).select(*stats.columns, "may")
    except AnalysisException:
        return always


def prune(stats: DataFrame, predicate: str) -> list[str]:
    """Files that may hold rows the predicate accepts, sorted."""
    found = matching(stats, predicate)
    try:
        return sorted(r[0] for r in found.where("may").select("file_path").distinct().collect())
    except PySparkException:  # a term that fails on some value decides nothing
        return sorted(r[0] for r in stats.select("file_path").distinct().collect())


def metadata_view(spark: SparkSession, stats: DataFrame, name: str = "metadata_table") -> DataFrame:
    """A row a row group with partition values and each column's statistics as a struct of its name."""
    first = stats.agg(F.array_distinct(F.flatten(F.collect_set(F.map_keys("partition")))).alias("p"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("columns")))).alias("c")).first()
    parts, cols = sorted(first["p"] or []), sorted(first["c"] or [])
    out = stats.select("file_path", "row_group", "num_columns", "num_rows", "total_byte_size", "compression", *[F.col("partition")[p].alias(p) for p in parts], *[F.col("columns")[c].alias(c) for c in cols if c not in parts])
    out.createOrReplaceTempView(name)
    return out
