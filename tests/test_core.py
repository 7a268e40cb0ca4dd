"""Contracts of tables, SQL text, types, datasets, merge, maintenance, catalog and streaming."""

import random
import warnings
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pytest
import yaml
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parquarry.functions import misc, reshape, security, types
from parquarry.operators.dataset import CSVDataset, JSONDataset, ParquetDataset
from parquarry.operators.prepare import prepare, to_frames
from parquarry.operators.table import Table
from parquarry.plans import sqltext
from parquarry.sources.catalog import Catalog
from parquarry.streaming.incremental import merge_stream


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


@pytest.fixture
def simple(spark):
    return spark.createDataFrame([(i, f"row_{i}", i * 1.5, datetime(2024, 1, i % 28 + 1)) for i in range(15)], "id long, name string, value double, timestamp timestamp_ntz")


def test_table_surface(spark, simple):
    t = Table(simple)
    assert t.filter("id > 12").count_rows() == 2 and t.filter(F.col("id") > 12, use="pyarrow").count_rows() == 2
    with pytest.raises(TypeError):
        t.filter(F.col("id") > 1, use="duckdb")
    with pytest.raises(ValueError):
        t.filter("id > 1", use="nothing")
    with pytest.raises(ValueError):
        t.filter("nosuch > 1")
    assert t.scanner("id", "value < 3", sort_by="id desc").to_arrow().column("id").to_pylist() == [1, 0]
    for bad in ({"batch_size": 0}, {"batch_readahead": -1}):
        with pytest.raises(ValueError):
            t.scanner(**bad)
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        t.to_scanner(columns="id")
        assert w[0].category is DeprecationWarning
    twice = Table(simple.limit(5).union(simple.limit(5)))
    assert twice.to_arrow(columns="id", distinct=True, sort_by="id desc").column("id").to_pylist() == [4, 3, 2, 1, 0]
    assert t.to_batches().num_rows == t.df.shape[0] == t.arrow.num_rows == 15
    assert t.sql("SELECT count(*) AS n FROM this")().first()["n"] == 15


def test_sort_and_sql_text(spark):
    assert sqltext.parse_sort("a desc, b") == [("a", True), ("b", False)]
    assert sqltext.parse_sort([("a", "DESC"), ["b", "ascending"]]) == [("a", True), ("b", False)]
    with pytest.raises(ValueError):
        sqltext.parse_sort([("a", "up")])
    assert "RLIKE '^(?:b.*)$'" in sqltext.rewrite_expression("a ~ 'b.*'")
    with pytest.raises(ValueError, match="ASOF"):
        sqltext.rewrite("SELECT * FROM a ASOF JOIN b ON TRUE")
    assert sqltext.table_names(spark, "WITH c AS (SELECT * FROM ns.o) SELECT * FROM c JOIN p ON TRUE") and {"ns.o", "c", "p"} == set(sqltext.table_names(spark, "WITH c AS (SELECT * FROM ns.o) SELECT * FROM c JOIN p ON TRUE"))
    assert sqltext.split_and("a > 1 AND (b = 2 AND c BETWEEN 1 AND 2) AND d = 'x AND y'") == ["a > 1", "b = 2", "c BETWEEN 1 AND 2", "d = 'x AND y'"]
    assert sqltext.parse_atom("d >= '2024-01-31'").kind == "date" and sqltext.parse_atom("a + 1 > 2") is None


def test_types(spark):
    df = spark.createDataFrame([("true",), ("wahr",), ("1",), ("no",), ("yes",), (None,)], "flag string")
    assert [r[0] for r in df.select(types.str2bool(F.col("flag"))).collect()] == [True, True, True, False, True, None]
    ts = spark.createDataFrame([(1700000000,)], "t long").select(types.int2timestamp(F.col("t"), "us").alias("t"))
    assert ts.first()[0] == datetime(1970, 1, 1, 0, 28, 20)
    with pytest.raises(ValueError):
        types.check_unit("ns")
    s = lambda t: T.StructType([T.StructField("a", t)])
    assert types.unify_schemas([s(T.IntegerType()), s(T.LongType())])[0].dataType == T.LongType()
    assert types.unify_schemas([s(T.LongType()), s(T.StringType())])[0].dataType == T.StringType()
    assert types.unify_permissive([s(T.IntegerType()), s(T.DoubleType())])[0].dataType == T.DoubleType()
    text = spark.createDataFrame([("1", "1.5", "x"), ("2", "2.5", "y")], "a string, b string, c string")
    assert dict(types.opt_dtype(text).dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert types.propose_types(text, shrink=True) == {"a": "tinyint", "b": "float"}
    assert types.replace_field(s(T.LongType()), T.StructField("z", T.LongType())) is None


def test_helpers(spark):
    assert misc.humanize_size(1536) == "1.5 KB" and misc.humanized_size_to_bytes("1.5 KB") == 1536
    for bad in ("", "-1 B", "1 XB"):
        with pytest.raises(ValueError):
            misc.humanized_size_to_bytes(bad)
    assert misc.get_partitions_from_path("data/year=2024/month=01/f.parquet", "hive") == [("year", "2024"), ("month", "01")]
    assert misc.get_partitions_from_path("2024/f.parquet", "year") == [("year", "2024")]
    with pytest.raises(TypeError):
        misc.get_partitions_from_path("a", None)
    assert misc.get_timedelta_str("1d") == "1 day" and misc.get_timedelta_str("1invalid") == "1 invalid" and misc.parse_interval("2w") == timedelta(days=14)
    assert misc.timestamp_from_string("2024-01-02") == datetime(2024, 1, 2)
    with pytest.raises(ValueError):
        security.escape_sql_identifier("a; drop")
    assert security.escape_sql_literal("it's") == "'it''s'" and security.escape_sql_literal(None) == "NULL"
    assert security.sanitize_filter_expression("a = 'x--y' -- c\n") == "a = 'x--y'"
    with pytest.raises(ValueError):
        security.sanitize_filter_expression("a = 'x")
    with pytest.raises(ValueError):
        security.validate_path("../base2/x", "/tmp/base")
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "k long, g string")
    assert [(v, f.count()) for v, f in reshape.partition_by(df, ["g"])] == [({"g": None}, 1), ({"g": "a"}, 2)]
    assert reshape.delta(df, df.where("g IS NULL")).count() == 2


def test_source_families_and_prepare(spark, simple):
    t = simple.limit(3).toArrow()
    for data in (t, t.to_batches()[0], t.to_pandas(), [t, t], [{"id": 1}, {"id": 2}], Table(simple), pa.RecordBatchReader.from_batches(t.schema, t.to_batches())):
        assert sum(f.count() for f in to_frames(spark, data)) in (2, 3, 6, 15)
    out = prepare(simple, sort_by="id desc", unique_on="name", partition_by=["year"], schema=T.StructType([T.StructField("id", T.IntegerType())]))
    assert out.dtypes == [("id", "int"), ("year", "bigint")]


def test_write_scan_prune(spark, tmp_path, simple):
    ds = ParquetDataset(spark, str(tmp_path / "d"))
    assert ds.count_rows() == 0 and ds.t is None
    assert ds.write_to_dataset(simple.limit(0), sort_by="nosuch") == []
    ds.write_to_dataset(simple.where("id < 10").coalesce(1))
    ds.write_to_dataset(simple.where("id >= 10").coalesce(1), update_metadata=True)
    ds.load()
    assert len(ds.files) == 2 and ds.files == ds.files_in_metadata and ds.collect_stats()["total_rows"] == 15
    assert ds.scan("id > 12 AND value > 1").count_rows() == 5 and len(ds.scan_files) == 1
    assert ds.scan("id != 3").count_rows() == 15 and ds.scan("id IN (1)").count_rows() == 15 and ds.scan("id > 12 OR id < 2").count_rows() == 15
    assert ds.scan("id > 100").count_rows() == 0
    assert ds.metadata_table().select("id.min").count() == 2
    with pytest.raises(ValueError):
        ds.write_to_dataset(simple, mode="replace")
    ds.write_to_dataset(simple.limit(1), mode="overwrite")
    assert ds.load().count_rows() == 1
    ds.vacuum()
    assert not ds.files and not ds.storage.exists("_stats")


def test_pruned_scan_equals_full_filter(spark, tmp_path):
    r = random.Random(1)
    df = spark.createDataFrame([(r.choice([None, r.randint(-50, 50)]), r.random() * 100, datetime(2024, 1, 1) + timedelta(hours=r.randint(0, 2000))) for _ in range(400)], "a int, b double, ts timestamp_ntz")
    ds = ParquetDataset(spark, str(tmp_path / "d"))
    ds.write_to_dataset(df.repartitionByRange(6, "a"))
    ds.load()
    for _ in range(12):
        terms = [f"a {r.choice(['>', '<', '>=', '<=', '='])} {r.randint(-60, 60)}", f"b {r.choice(['>', '<'])} {r.random() * 100:.3f}", f"ts {r.choice(['>', '<='])} '2024-0{r.randint(1, 4)}-1{r.randint(0, 9)}'"]
        p = r.choice([" AND ", " OR "]).join(r.sample(terms, r.randint(1, 3)))
        assert ds.scan(p).filter(p).count_rows() == ds.filter(p).count_rows()


def test_merge_against_a_dict(spark, tmp_path):
    r = random.Random(2)
    model = {}
    ds = ParquetDataset(spark, str(tmp_path / "m"))
    schema = "id long, v string"
    for step, strategy in enumerate(["insert", "upsert", "update", "upsert"]):
        data = [(r.choice([None, *range(20)]), f"{step}-{i}") for i in range(15)]
        last = dict(data)
        fresh = {k: v for k, v in last.items() if k not in model}
        known = {k: v for k, v in last.items() if k in model}
        got = ds.merge([spark.createDataFrame(data[:7], schema).coalesce(1), spark.createDataFrame(data[7:], schema).coalesce(1)], strategy, "id")
        if strategy != "update":
            model |= fresh
        if strategy != "insert":
            model |= known
        assert rows(ds.t(), "id", "v") == sorted(model.items(), key=str)
        assert got.source_count == 15 and got.inserted == (len(fresh) if strategy != "update" else 0) and got.updated == (len(known) if strategy != "insert" else 0)
    with pytest.raises(ValueError):
        ds.merge([], "insert", [])
    with pytest.raises(ValueError):
        ds.merge(spark.createDataFrame([(1, "x")], "other long, v string"), "insert", "id")
    assert ds.merge([], "insert", "id").inserted == 0


def test_merge_partitions_are_immutable(spark, tmp_path):
    ds = ParquetDataset(spark, str(tmp_path / "p"))
    df = spark.createDataFrame([(1, "n", "a"), (2, "s", "b")], "id long, region string, v string")
    ds.write_to_dataset(df, partition_by="region")
    ds.load()
    with pytest.raises(ValueError):
        ds.merge(spark.createDataFrame([(1, "s", "z")], df.schema), "upsert", "id")
    ds.merge(spark.createDataFrame([(1, "n", "z"), (3, "e", "c")], df.schema), "upsert", "id")
    assert rows(ds.t(), "id", "region", "v") == [(1, "n", "z"), (2, "s", "b"), (3, "e", "c")]
    assert ds.partition_values == {"region": ["e", "n", "s"]}


def test_maintenance(spark, tmp_path, simple):
    ds = ParquetDataset(spark, str(tmp_path / "c"))
    ds.write_to_dataset(simple.repartition(6))
    ds.load()
    plan = ds.compact_by_rows(dry_run=True)
    assert plan[0]["rows"] == 15 and plan[0]["planned_groups"] == 1
    ds.compact_by_rows()
    assert len(ds.files) == 1 and ds.count_rows() == 15 and ds.compact_by_rows() is None
    ds.compact_by_rows(sort_by="id desc", max_rows_per_file=4)
    in_order = [r["id"] for f in ds.files for r in spark.read.parquet(ds.storage.full(f)).collect()]
    assert in_order == sorted(in_order, reverse=True) and len(ds.files) >= 4
    ds.write_to_dataset(simple)
    ds.compact_by_rows(unique=True)
    assert ds.count_rows() == 15
    with pytest.raises(TypeError):
        ds.compact_by_rows(nonsense=1)
    ds.repartition("year", derived_partition_columns=["year"])
    assert ds.partition_names == ["year"] and ds.count_rows() == 15
    with pytest.raises(ValueError):
        ds.repartition("year", sort_by="id")
    before = ds.files
    with pytest.raises(RuntimeError):
        ds.optimize_dtypes(types={"value": "tinyint"})
    assert ds.files == before
    ds.optimize_dtypes(include=["id"])
    assert dict(ds.t().dtypes)["id"] == "tinyint" and ds.count_rows() == 15


def test_repair(spark, tmp_path):
    ds = ParquetDataset(spark, str(tmp_path / "r"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    ds.write_to_dataset(a, alter_schema=True)
    ds.write_to_dataset(a.withColumn("id", F.col("id").cast("long")), alter_schema=True)
    assert rows(ds.load().t(), "id") == [(1,), (1,), (2,), (2,)]
    assert len(ds.repair_schema(dry_run=True)["files"]) >= 1
    ds.update()
    assert {str(s.field("id").type) for s in ds.raw_file_schemas().values()} == {"int64"}


def test_csv_json_catalog(spark, tmp_path):
    (tmp_path / "c").mkdir()
    pd.DataFrame({"a": [1, 2], "b": ["x", "y"]}).to_csv(tmp_path / "c/one.csv", index=False)
    assert CSVDataset(spark, str(tmp_path / "c")).load().count_rows() == 2
    (tmp_path / "j").mkdir()
    with pytest.raises(FileNotFoundError):
        JSONDataset(spark, str(tmp_path / "j")).load()
    (tmp_path / "j/part.json").write_text('[{"value": 1}, {"value": 2}]')
    assert JSONDataset(spark, str(tmp_path / "j")).load().count_rows() == 2
    (tmp_path / "j/lines.json").write_text('{"value": 3}\n{"value": 4, "more": "x"}\n')
    (tmp_path / "j/one.json").write_text('{\n "value": 5\n}\n')
    assert rows(JSONDataset(spark, str(tmp_path / "j")).load().t(), "value", "more") == [(1, None), (2, None), (3, None), (4, "x"), (5, None)]
    path = tmp_path / "cat.yml"
    path.write_text(yaml.safe_dump({"filesystem": {}, "tables": {"raw": {"c": {"path": str(tmp_path / "c"), "format": "csv"}}, "none": None}}))
    cat = Catalog(spark, str(path))
    assert cat.all_tables() == ["raw.c"] and sorted(cat.list_namespaces()) == ["none", "raw"]
    assert cat.sql("SELECT sum(a) AS s FROM raw.c WHERE b <> 'raw.c'").first()["s"] == 3
    cat.create_namespace("mart")
    cat.create_table("t", spark.range(3), namespace="mart", path=str(tmp_path / "t"))
    assert cat.sql("SELECT count(*) AS n FROM mart.t JOIN raw.c ON id = a").first()["n"] == 2
    with pytest.raises(ValueError):
        cat.create_table("t", None, namespace="mart", path="x")
    cat.delete_table("mart.t", vacuum=True)
    assert "mart.t" not in cat.all_tables()
    with pytest.raises(ValueError):
        cat.read("raw.c", batch_size=3)


def test_merge_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string").write.parquet(src)
    ds = ParquetDataset(spark, str(tmp_path / "out"))
    go = lambda: merge_stream(spark.readStream.schema("id long, v string").parquet(src), ds, ["id"], str(tmp_path / "cp")).awaitTermination()
    go()
    spark.createDataFrame([(2, "B"), (3, "c")], "id long, v string").write.mode("append").parquet(src)
    go()
    assert rows(ds.t(), "id", "v") == [(1, "a"), (2, "B"), (3, "c")]
