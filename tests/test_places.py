"""Places of rows over files, found without one task that holds them all."""

from pyspark.sql import functions as F

from parquarry import queries


def test_places_over_files(spark, tmp_path):
    n = F.col("id")
    prices = spark.range(9_000).select((n * 7 % 9_000).alias("o_orderkey"), (n % 50 / 4).alias("o_totalprice"))
    prices.write.parquet(str(tmp_path / "orders.parquet"))
    out = queries.compact_ordered_places(spark, str(tmp_path))
    want = sorted(prices.collect(), key=lambda r: (-r["o_totalprice"], r["o_orderkey"]))
    assert {r["o_orderkey"]: r["at"] for r in out.collect()} == {r["o_orderkey"]: i for i, r in enumerate(want, 1)}
    assert out.schema["at"].dataType.simpleString() == "bigint"
    assert out.rdd.getNumPartitions() > 1
