"""Pruning never loses a row, merge over files of several schemas, single files, Arrow filters."""

import os
import time
from datetime import date, datetime, timedelta
from decimal import Decimal

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parquarry.operators.dataset import ParquetDataset
from parquarry.operators.table import Table
from parquarry.plans import sqltext, stats
from parquarry.sources import files as single
from parquarry.sources import storage as storage_module


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def both(ds, p):
    return ds.scan(p).filter(p).count_rows(), ds.filter(p).count_rows()


def test_big_decimals_and_fractions(spark, tmp_path):
    big = 9007199254740992
    pq.write_table(pa.table({"x": pa.array([Decimal(big + 1), Decimal(1)], pa.decimal128(20, 0)), "n": pa.array([big + 1, 1])}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"x": pa.array([Decimal(2)], pa.decimal128(20, 0)), "n": pa.array([2])}), tmp_path / "b.parquet")
    ds = ParquetDataset(spark, str(tmp_path))
    for c in ("x", "n"):
        for p in (f"{c} > {big}", f"{c} >= {big + 1}", f"{c} = {big + 1}", f"{c} < 1.5", f"{c} <= {big}.5", f"{c} > 1e15"):
            got, want = both(ds, p)
            assert got == want, p
    assert ds.scan(f"x > {big}").count_rows() == 2 and ds.scan_files == ["a.parquet"]


def test_file_rewritten_under_its_name(spark, tmp_path):
    pq.write_table(pa.table({"x": [1, 2, 3]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"x": [4, 5]}), tmp_path / "b.parquet")
    ds = ParquetDataset(spark, str(tmp_path))
    assert ds.scan("x > 50").count_rows() == 0
    time.sleep(0.01)
    pq.write_table(pa.table({"x": [61, 62, 63]}), tmp_path / "a.parquet")
    os.utime(tmp_path / "a.parquet", (time.time() + 5, time.time() + 5))
    ds.load()
    assert both(ds, "x > 50") == (3, 3)
    assert len(ds.storage.versions(stats.SIDECAR)) == 1


@pytest.fixture(scope="module")
def many_types(spark, tmp_path_factory):
    """Files whose types of a column differ, with and without statistics."""
    at = tmp_path_factory.mktemp("types")
    cols = {
        "i.parquet": pa.array([-5, 0, 7, None], pa.int32()),
        "l.parquet": pa.array([2**53 + 1, 2**53 - 1, -(2**62)], pa.int64()),
        "f.parquet": pa.array([0.1, -2.5, 1e18, None], pa.float64()),
        "s.parquet": pa.array([0.1, 3.4], pa.float32()),
        "d.parquet": pa.array([Decimal("0.10"), Decimal("7.25")], pa.decimal128(30, 2)),
    }
    for f, a in cols.items():
        pq.write_table(pa.table({"x": a, "t": [f] * len(a)}), at / f, write_statistics=f != "s.parquet")
    return ParquetDataset(spark, str(at))


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
@given(op=st.sampled_from([">", ">=", "<", "<=", "="]), lit=st.sampled_from(["0", "0.1", "7", "7.25", "-2.5", "1e18", "9007199254740992", "9007199254740993", "9007199254740991.5", "-4611686018427387904", "1e-3"]))
def test_pruning_of_any_number_type(many_types, op, lit):
    got, want = both(many_types, f"x {op} {lit}")
    assert got == want


def test_times_and_text(spark, tmp_path):
    t = datetime(2024, 3, 1, 12)
    pq.write_table(pa.table({"d": [date(2024, 3, 1)], "n": pa.array([t], pa.timestamp("us")), "z": pa.array([t], pa.timestamp("us", "Europe/Berlin")), "s": ["10"]}), tmp_path / "a.parquet")
    pq.write_table(pa.table({"d": [date(2024, 3, 2)], "n": pa.array([t + timedelta(days=1)], pa.timestamp("us")), "z": pa.array([t + timedelta(days=1)], pa.timestamp("us", "Europe/Berlin")), "s": ["9"]}), tmp_path / "b.parquet")
    ds = ParquetDataset(spark, str(tmp_path))
    for p in ("d >= '2024-03-02'", "d = '2024-03-01'", "n > '2024-03-01 12:00:00'", "n <= '2024-03-01 12:00:00'", "z = '2024-03-01 12:00:00'", "z >= timestamp '2024-03-02 12:00:00'", "s > 9", "s = 10"):
        got, want = both(ds, p)
        assert got == want, p


def test_many_files_are_planned_without_the_driver_opening_one(spark, tmp_path, monkeypatch):
    for i in range(30):
        pq.write_table(pa.table({"x": [i, i + 1]}), tmp_path / f"{i:03d}.parquet")
    monkeypatch.setattr(storage_module, "FEW", 10)
    with monkeypatch.context() as m:
        m.setattr("parquarry.operators.maintain.file_schemas", lambda *a: pytest.fail("a footer was read on the driver"))
        ds = ParquetDataset(spark, str(tmp_path), name="many")
        assert len(ds.files) == 30 and both(ds, "x > 27") == (5, 5) and len(ds.scan_files) == 3
        assert ds.collect_stats()["total_rows"] == 60
    ds.compact_by_rows(sort_by="x")
    assert ds.count_rows() == 60


def test_metadata_rows_and_edits(spark, tmp_path):
    ds = ParquetDataset(spark, str(tmp_path / "m"))
    ds.write_to_dataset(spark.createDataFrame([(1, "a"), (5, "b"), (9, "b")], "x long, g string").coalesce(1), partition_by="g")
    ds.load()
    assert [r["partition"] for r in ds.scan_metadata("x > 2").select("partition").collect()] == [{"g": "b"}]
    assert ds.scan_metadata("g = 'a'").count() == 1 and ds.collect_stats("g = 'b'")["total_rows"] == 2
    gone = ds.files[0]
    ds.remove_from_metadata(gone)
    assert ds.get_file_paths() == ds.files[1:]
    assert ds.scan("x >= 1").count_rows() == 3 and ds.get_file_paths() == ds.files
    assert "Scan parquet" in ds.explain("x > 2")


def test_merge_over_files_of_two_schemas(spark, tmp_path):
    for strategy, want in (("update", [(1, "new", None), (2, "b", 2)]), ("upsert", [(1, "new", None), (2, "b", 2), (3, "c", 9)])):
        ds = ParquetDataset(spark, str(tmp_path / strategy))
        ds.write_to_dataset(spark.createDataFrame([(1, "a")], "id int, v string"), alter_schema=True)
        ds.write_to_dataset(spark.createDataFrame([(2, "b", 2)], "id long, v string, more int"), alter_schema=True)
        ds.load()
        got = ds.merge(spark.createDataFrame([(1, "new", None), (3, "c", 9)], "id long, v string, more int"), strategy, "id")
        assert rows(ds.t(), "id", "v", "more") == want and (got.updated, got.target_count_before) == (1, 2)


def test_merge_reads_only_files_in_range(spark, tmp_path, monkeypatch):
    ds = ParquetDataset(spark, str(tmp_path / "r"))
    ds.write_to_dataset(spark.range(0, 100).withColumn("v", F.lit("old")).repartitionByRange(5, "id"))
    ds.load()
    read, real = [], ds._read
    monkeypatch.setattr(ds, "_read", lambda files=None, file_col=None: (read.append(files), real(files, file_col))[1])
    got = ds.merge(spark.createDataFrame([(3, "x"), (4, "y"), (500, "z")], "id long, v string").where("id < 100"), "upsert", "id")
    assert got.updated == 2 and len(got.rewritten_files) == 1 and max(len(f) for f in read if f is not None) == 1
    # a source that is another one each time it is computed
    moody = spark.range(0, 50).select((F.rand() * 1000).cast("long").alias("id"), F.lit("m").alias("v"))
    got = ds.merge(moody, "upsert", "id")
    assert ds.count_rows() == got.target_count_after and ds.t().select("id").distinct().count() == ds.count_rows()


def test_strict_narrowing_keeps_the_text(spark, tmp_path):
    for i, (text, ok) in enumerate((("1.123456789012", False), ("00501", False), ("1.50", True), ("17", True), ("-0.25", True), ("+5", False))):
        ds = ParquetDataset(spark, str(tmp_path / f"d{i}"))
        ds.write_to_dataset(spark.createDataFrame([(text,), (None,)], "v string"))
        ds.load()
        if ok:
            ds.optimize_dtypes()
            assert ds.t.schema["v"].dataType.simpleString() != "string"
        else:
            with pytest.raises(RuntimeError):
                ds.optimize_dtypes()
            assert rows(ds.load().t(), "v") == [(None,), (text,)] or rows(ds.t(), "v") == [(text,), (None,)]


def test_arrow_filters(spark, tmp_path):
    df = spark.createDataFrame([(1, "a'b"), (2, None), (3, "c")], "x long, s string")
    f = pc.field
    for e, want in ((f("x") > 1, [2, 3]), ((f("x") == 1) | (f("s") == "c"), [1, 3]), (f("s").is_valid() & (f("x") < 3), [1]), (f("s").is_null(), [2]), (f("s").isin(["a'b", "c"]), [1, 3]), (~(f("x") >= 2), [1]), (f("x") + 1 == 3, [2])):
        assert [r[0] for r in rows(Table(df).filter(e)(), "x")] == want, str(e)
    with pytest.raises(ValueError):
        sqltext.arrow_to_sql(pc.utf8_upper(f("s")) == "A")
    df.write.parquet(str(tmp_path / "p"))
    assert rows(single.read_parquet(spark, str(tmp_path / "p"), f("x") > 1, "x"), "x") == [(2,), (3,)]
    with pytest.raises(ValueError):
        single.read_parquet(spark, str(tmp_path / "p"), backend="other")


def test_single_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 5)], "x long, year int")
    at = single.write_table(spark, df, str(tmp_path / "year=2024" / "one.parquet"))
    assert at.endswith("one.parquet") and [p.name for p in (tmp_path / "year=2024").iterdir() if p.suffix == ".parquet"] == ["one.parquet"]
    got = single.read_table(spark, at, partitioning="hive")
    assert got.dtypes == [("x", "bigint"), ("year", "string")] and got.first()["year"] == "2024"
    single.write_table(spark, df.limit(0), at)
    assert single.read_table(spark, at).count() == 0


def test_table_joins_and_reader(spark):
    a, b = Table(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")), Table(spark.createDataFrame([(2, "z")], "id long, w string"))
    assert rows(a.join(b, "id")(), "id", "v", "w") == [(2, "b", "z")] and a.join(b, ["id"], "left").count_rows() == 2
    assert a.join(b, "l.id < r.id").count_rows() == 1 and a.join(b, "id", "left_anti").count_rows() == 1
    with pytest.raises(ValueError):
        a.join(b, ["v"])
    assert [x.num_rows for x in Table(spark.range(5).toDF("n")).to_batch_reader(batch_size=2)] == [2, 2, 1]
    assert "Join" in a.join(b, "id").explain()
