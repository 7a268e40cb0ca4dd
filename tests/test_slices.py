"""As-of join and global ranks in slices, against plain versions."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parquarry.functions.reshape import rank_average
from parquarry.functions.slices import slice_of
from parquarry.operators.joins import asof_join

DAY = datetime(2024, 3, 30, 22)
TIMES = {
    "bigint": lambda r: r.randint(-50, 50),
    "double": lambda r: r.choice([r.random(), float("inf"), float("nan"), -1.5]),
    "date": lambda r: date(2024, 1, 1) + timedelta(days=r.randint(0, 30)),
    "timestamp": lambda r: DAY + timedelta(seconds=r.randint(0, 40_000)),
    "timestamp_ntz": lambda r: DAY + timedelta(seconds=r.randint(0, 40_000)),
    "string": lambda r: r.choice("abcdefgh"),
    "decimal(10,2)": lambda r: r.randint(0, 50),
}


def rows(spark, kind, n, seed):
    r = random.Random(seed)
    data = [(i, r.choice([1, 1, 1, 2, None]), None if r.random() < 0.1 else TIMES[kind](r)) for i in range(n)]
    schema = f"id int, g int, t {'bigint' if kind.startswith('decimal') else kind}"
    df = spark.createDataFrame(data, schema).repartition(4)
    return df.withColumn("t", F.col("t").cast(kind))


def order(x):
    return (x is not None, isinstance(x, float) and x != x, x if x is None or x == x else 0)


@pytest.mark.parametrize("kind", TIMES)
@pytest.mark.parametrize("by,slices", [((), None), (("g",), 6), (("g",), None)])
def test_asof(spark, kind, by, slices):
    left, right = rows(spark, kind, 150, 1), rows(spark, kind, 40, 2).dropDuplicates(["g", "t"] if by else ["t"])
    right = spark.createDataFrame(right.collect(), right.schema)
    got = {x["id"]: x["right_id"] for x in asof_join(left, right, "t", "t", by, slices=slices).collect()}
    have = right.collect()
    for x in left.collect():
        may = [y for y in have if y["t"] is not None and x["t"] is not None and order(y["t"]) <= order(x["t"]) and (not by or y["g"] == x["g"])]
        assert got.pop(x["id"]) == (max(may, key=lambda y: order(y["t"]))["id"] if may else None)
    assert not got


def test_asof_without_rows(spark):
    some = rows(spark, "bigint", 9, 3)
    assert asof_join(some.limit(0), some, "t", "t").count() == 0
    assert [x["right_id"] for x in asof_join(some, some.limit(0), "t", "t").collect()] == [None] * 9


@pytest.mark.parametrize("kind", TIMES)
def test_rank(spark, kind):
    df = rows(spark, kind, 120, 4)
    have = sorted((order(x["t"]) for x in df.collect()))
    for x in rank_average(df, "t").collect():
        o = order(x["t"])
        first = have.index(o) + 1
        assert x["rank"] == first + (have.count(o) - 1) / 2
    assert rank_average(df.limit(0), "t").count() == 0


def test_slices_follow_the_order(spark):
    df = rows(spark, "timestamp", 400, 5)
    cut = df.select("t", slice_of(df, "t", 8).alias("s")).orderBy("t").collect()
    found = [x["s"] for x in cut]
    assert found == sorted(found) and len(set(found)) == 8 and max(map(found.count, set(found))) < 150
