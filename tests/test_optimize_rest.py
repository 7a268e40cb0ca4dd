"""Types proposed from the first rows hold all rows."""

import pytest
from pyspark.sql import functions as F

from parquarry.operators.dataset import ParquetDataset


@pytest.mark.parametrize("strict", [True, False])
def test_later_rows_widen_a_proposal(spark, tmp_path, strict):
    n = F.col("id")
    late = n == 39_999
    df = spark.range(40_000).coalesce(1).select(
        n.cast("string").alias("key"),
        F.when(late, 2**40).otherwise(n % 100).alias("number"),
        F.when(late, "0.5").otherwise("7").alias("real"),
        F.when(late, "x").otherwise("7").alias("word"),
        F.when(late, "007").otherwise("7").alias("code"),
        F.when(late, 0.1).otherwise(0.5).alias("double"),
        F.when(late, "16777217.5").otherwise("1.5").alias("long_real"),
    )
    ds = ParquetDataset(spark, str(tmp_path / "d"))
    ds.write_to_dataset(df)
    ds.load()
    want = {"key": "int", "real": "float", "long_real": "double" if strict else "float"} | ({} if strict else {"double": "float", "code": "tinyint"})
    assert ds.optimize_dtypes(strict=strict, dry_run=True) == want
    ds.optimize_dtypes(strict=strict)
    assert {c: t for c, t in ds.t().dtypes if c in want} == want and ds.t.schema["number"].dataType == df.schema["number"].dataType
    got = ds.t().where("key = 39999").first()
    assert got["number"] == 2**40 and got["real"] == 0.5 and got["word"] == "x"
    assert ds.t().where("key IS NULL").count() == 0 and ds.t().agg(F.sum("key")).first()[0] == 39_999 * 20_000
    if strict:
        assert (got["double"], got["long_real"], got["code"]) == (0.1, 16777217.5, "007")


def test_first_rows_and_given_types_still_stop_a_rewrite(spark, tmp_path):
    ds = ParquetDataset(spark, str(tmp_path / "d"))
    ds.write_to_dataset(spark.range(200).coalesce(1).select("id", F.when(F.col("id") == 0, "007").otherwise("7").alias("code")))
    ds.load()
    before = ds.files
    for how in ({"infer_schema_size": 10}, {"types": {"id": "tinyint"}}):
        with pytest.raises(RuntimeError):
            ds.optimize_dtypes(**how)
        assert ds.files == before
