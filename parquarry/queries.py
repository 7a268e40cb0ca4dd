"""Registered queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parquarry.functions import reshape, types
from parquarry.operators.dataset import CSVDataset, JSONDataset, ParquetDataset
from parquarry.operators.joins import asof_join
from parquarry.operators.table import Table
from parquarry.plans import sqltext
from parquarry.session import scratch
from parquarry.sources import files as single

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query that is SQL here too, through the rewriter; ``oracle`` where dialects differ."""
    words = {t.lower() for kind, t in sqltext.tokens(text) if kind == "word"}

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if t in words:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sqltext.rewrite(text))

    QUERIES[name] = run
    ORACLE[name] = oracle or text


# -- predicates and projections
_sql("filter_and_or", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount >= 0.05) OR l_returnflag = 'A' AND l_tax < 0.01")
_sql("filter_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('F')")
_sql("filter_between", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000")
_sql("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%S%' AND p_name NOT LIKE 'a%'")
_sql("filter_regex", "SELECT p_partkey, p_brand FROM part WHERE p_brand ~ '.*[13]' AND p_brand !~ '.*11'", "SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, '.*[13]') AND NOT regexp_full_match(p_brand, '.*11')")
_sql("filter_isnull", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders) AS x WHERE p IS NULL")
_sql("project_derived", "SELECT o_orderkey, o_totalprice * 0.9 AS net, o_totalprice - 100 AS less, o_totalprice / 2 AS half FROM orders")
_sql("case_bucket", "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'mid' ELSE 'high' END AS bucket, COUNT(*) AS n FROM orders GROUP BY 1")
_sql("in_subquery", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
# -- joins
_sql("join_inner2", "SELECT o_orderkey, c_name, o_totalprice FROM orders INNER JOIN customer ON o_custkey = c_custkey")
_sql("join_inner3", "SELECT n_name, COUNT(*) AS orders, ROUND(SUM(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY n_name")
_sql("join_left", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("join_right", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM orders RIGHT JOIN customer ON c_custkey = o_custkey GROUP BY c_custkey")
_sql("join_full", "SELECT COALESCE(n_nationkey, -1) AS n, COALESCE(s_suppkey, -1) AS s FROM nation FULL OUTER JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000")
_sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation AS a JOIN nation AS b ON a.n_regionkey < b.n_regionkey")
_sql("join_self", "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier AS a JOIN supplier AS b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
_sql("join_range", "SELECT o_orderkey, COUNT(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
# -- aggregation
_sql("agg_group", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty, ROUND(AVG(l_extendedprice), 4) AS mean, MIN(l_quantity) AS least, MAX(l_quantity) AS most FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("agg_having", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10")
_sql("agg_count_distinct", "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
_sql("agg_cond", "SELECT user_id, COUNT(CASE WHEN event_type = 'click' THEN 1 END) AS clicks, COUNT(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys FROM events GROUP BY user_id")
_sql("agg_alias", "SELECT o_orderpriority AS prio, COUNT(*) AS n FROM orders GROUP BY prio")
_sql("agg_quantile", "SELECT o_orderstatus, ROUND(percentile_cont(0.95) WITHIN GROUP (ORDER BY o_totalprice), 6) AS p95, ROUND(median(o_totalprice), 6) AS mid FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(quantile_cont(o_totalprice, 0.95), 6) AS p95, ROUND(median(o_totalprice), 6) AS mid FROM orders GROUP BY o_orderstatus")
_sql("agg_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("agg_cube", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("agg_minmax", "SELECT MIN(o_orderdate) AS first, MAX(o_orderdate) AS last, COUNT(*) AS n FROM orders")
_sql("agg_stddev", "SELECT c_nationkey, ROUND(stddev_samp(c_acctbal), 4) AS sd, ROUND(var_pop(c_acctbal), 2) AS v FROM customer GROUP BY c_nationkey")
# -- windows
_sql("win_row_number", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders")
_sql("win_rank", "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS d FROM orders")
_sql("win_lag", "SELECT o_orderkey, LAG(o_totalprice, 1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, LEAD(o_orderkey, 1, -1) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders")
_sql("win_range30d", "SELECT o_orderkey, ROUND(SUM(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW), 2) AS last30 FROM orders")
_sql("win_growth", "SELECT m, n, CAST(n - LAG(n) OVER (ORDER BY m) AS DOUBLE) / LAG(n) OVER (ORDER BY m) AS growth FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY 1) AS x", "SELECT CAST(m AS INT) AS m, n, CAST(n - LAG(n) OVER (ORDER BY m) AS DOUBLE) / LAG(n) OVER (ORDER BY m) AS growth FROM (SELECT year(o_orderdate) * 12 + month(o_orderdate) AS m, COUNT(*) AS n FROM orders GROUP BY 1) AS x")
_sql("win_qualify", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
_sql("win_frames", "SELECT o_orderkey, ROUND(AVG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS smooth, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS f, NTILE(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS q, PERCENT_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders")
# -- order, sets, CTEs
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql("limit_offset", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 25")
_sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_sql("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_sql("set_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 0")
_sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
_sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
_sql("cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_custkey, ROUND(s, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE s > 300000")
_sql("correlated", "SELECT o_orderkey FROM orders AS o WHERE o_totalprice > (SELECT AVG(i.o_totalprice) * 1.5 FROM orders AS i WHERE i.o_custkey = o.o_custkey)")
# -- scalars
_sql("scalar_case", "SELECT c_custkey, LOWER(c_name) AS low, UPPER(c_mktsegment) AS up FROM customer")
_sql("scalar_datediff", "SELECT o_orderkey, DATEDIFF('day', o_orderdate, TIMESTAMP '1999-01-01 01:00:00') AS days FROM orders", "SELECT o_orderkey, CAST(DATEDIFF('day', o_orderdate, TIMESTAMP '1999-01-01 01:00:00') AS INT) AS days FROM orders")
_sql("scalar_fill_null", "SELECT o_orderkey, COALESCE(x, 0.0) AS x FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS x FROM orders) AS y")
_sql("scalar_cast", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d, CAST(o_totalprice AS FLOAT) AS f, CAST(o_orderkey AS STRING) AS s FROM orders")


# -- Table
@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'")
def table_scanner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "orders")).scanner(["o_orderkey", "o_custkey"], "o_totalprice > 100000 AND o_orderstatus = 'O'", sort_by="o_totalprice desc")()


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def table_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Table(table(spark, sf_dir, "orders")).to_spark(columns=["o_orderstatus", "o_orderpriority"], distinct=True, sort_by=[("o_orderpriority", "desc"), "o_orderstatus"])


@query("SELECT e.event_id, (SELECT max(x.ts) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'purchase' AND x.ts <= e.ts) AS right_ts FROM events e WHERE e.event_type = 'click'")
def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    buys = e.where("event_type = 'purchase'").select("user_id", "ts")
    return asof_join(clicks, buys, "ts", "ts", ["user_id"]).select("event_id", "right_ts")


@query("SELECT l.event_id, max(r.ts) AS right_ts FROM events l ASOF LEFT JOIN (SELECT ts FROM events WHERE event_type = 'purchase') r ON l.ts >= r.ts WHERE l.event_type = 'click' GROUP BY l.event_id")
def join_asof_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return asof_join(e.where("event_type = 'click'").select("event_id", "ts"), e.where("event_type = 'purchase'").select("ts"), "ts", "ts").select("event_id", "right_ts")


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return types.union_diagonal([a, b])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_suppkey % 10 = 1)")
def delta_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return reshape.delta(left, table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 1").select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"])


# -- helpers
@query("SELECT event_id, year(ts) AS year, month(ts) AS month, week(ts) AS week, dayofyear(ts) AS yearday, day(ts) AS monthday, isodow(ts) AS weekday, hour(ts) AS hour, minute(ts) AS minute FROM events")
def dateparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["year", "month", "week", "yearday", "monthday", "weekday", "hour", "minute"]
    return reshape.with_datepart_columns(table(spark, sf_dir, "events"), parts).select("event_id", *parts)


@query("SELECT event_id, date_trunc('month', ts) AS ts_trunc FROM events")
def trunc_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.with_truncated_columns(table(spark, sf_dir, "events"), "month", "ts").select("event_id", "ts_trunc")


@query("SELECT event_id, strftime(ts, '%Y/%m-%d %H:%M') AS ts_text FROM events")
def strftime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.with_strftime_columns(table(spark, sf_dir, "events"), "%Y/%m-%d %H:%M", "ts").select("event_id", "ts_text")


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS row_nr FROM events")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.with_row_count(table(spark, sf_dir, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_nr")


@query("SELECT vec_id, unnest(embedding) AS embedding FROM embeddings")
def explode_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.explode_all(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("SELECT user_id, min(value) AS v_lo, max(value) AS v_hi FROM events GROUP BY user_id")
def unnest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.struct(F.min("value").alias("lo"), F.max("value").alias("hi")).alias("v"))
    return reshape.unnest_all(e)


@query("SELECT c_custkey FROM customer")
def drop_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.drop_null_columns(table(spark, sf_dir, "customer").select("c_custkey", F.lit(None).cast("string").alias("nothing")))


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def opt_dtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "orders").select(*[F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice", "o_orderstatus")])
    return types.opt_dtype(text)


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT text, count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1) JOIN documents USING (text)")
def is_duplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(reshape.is_duplicated(table(spark, sf_dir, "documents").select("text")),)], "n long")


@query("SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) + (count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) - 1) / 2.0 AS rank FROM customer")
def rank_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.rank_average(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_nationkey"]).select("c_custkey", "rank")


@query("SELECT l_orderkey, l_linenumber, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS rank FROM lineitem")
def rank_average_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.rank_average(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", "rank")


@query("SELECT n_nationkey, n_name ~ 'A.*' AS yes, make_timestamp(n_nationkey::BIGINT * 1000000) AS t FROM nation".replace("n_name ~ 'A.*'", "lower(n_name) IN ('true', 'wahr', '1', '1.0', 'yes', 'ja', 'ok', 'o.k', 'okay')"))
def casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", types.str2bool(F.col("n_name")).alias("yes"), types.int2timestamp(F.col("n_nationkey"), "s").alias("t"))


# -- datasets: written to the shared folder, changed, and read back
def _dataset(spark: SparkSession, name: str, df: DataFrame, **how) -> ParquetDataset:
    ds = ParquetDataset(spark, scratch(spark, name), name=name)
    ds.write_to_dataset(df, **how)
    return ds.load()


@query("SELECT * FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 2000 AND o_totalprice > 5e4")
def prune_scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by key range; the scan opens those that the filter may match."""
    orders = table(spark, sf_dir, "orders")
    ds = _dataset(spark, "orders_ranges", orders.repartitionByRange(16, "o_orderkey"))
    p = "o_orderkey >= 1000 AND o_orderkey < 2000 AND o_totalprice > 5e4"
    return ds.scan(p).filter(p)()


@query("SELECT o_orderstatus, CAST(1 AS BIGINT) AS num_files, CAST(count(*) AS BIGINT) AS num_rows FROM orders GROUP BY o_orderstatus")
def partition_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, "orders_parts", table(spark, sf_dir, "orders").repartition(3, "o_orderstatus"), partition_by=["o_orderstatus"])
    return ds.partition_groups().select(F.map_from_entries("partition")["o_orderstatus"].alias("o_orderstatus"), "num_files", "num_rows")


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0")
    changed = c.withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return changed.unionByName(changed.withColumn("c_custkey", F.col("c_custkey") + 10_000_000))


_OLD = "SELECT * FROM customer"
_NEW = "SELECT c_custkey + 10000000 AS c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 10 = 0"
_UPDATED = "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer"


def _merged(spark: SparkSession, sf_dir: str, strategy: str) -> DataFrame:
    ds = _dataset(spark, f"customer_{strategy}", table(spark, sf_dir, "customer").repartitionByRange(4, "c_custkey"))
    ds.merge(_changes(spark, sf_dir), strategy, "c_custkey")
    return ds.t()


@query(f"{_OLD} UNION ALL {_NEW}")
def merge_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "insert")


@query(_UPDATED)
def merge_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "update")


@query(f"{_UPDATED} UNION ALL {_NEW}")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir, "upsert")


@query("SELECT CASE WHEN r_regionkey = 0 THEN -1 ELSE r_regionkey END AS k, CASE WHEN r_regionkey = 0 THEN 'null' ELSE r_name END AS v FROM region")
def merge_nullsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null key is a key: it is updated, not inserted again."""
    r = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") != 0, F.col("r_regionkey")).alias("k"), F.col("r_name").alias("v"))
    ds = _dataset(spark, "region_null", r)
    ds.merge(r.where("k IS NULL").withColumn("v", F.lit("null")), "upsert", "k")
    return ds.t().fillna(-1, ["k"])


@query(f"{_OLD} UNION ALL {_NEW}")
def delta_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, "customer_delta", table(spark, sf_dir, "customer"))
    ds.write_to_dataset(_changes(spark, sf_dir), mode="delta", delta_subset=["c_custkey"])
    return ds.load().t()


@query("SELECT *, year(ts) AS year, month(ts) AS month FROM events".replace("year(ts)", "CAST(year(ts) AS INT)").replace("month(ts)", "CAST(month(ts) AS INT)"))
def write_partition_dateparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dataset(spark, "events_parts", table(spark, sf_dir, "events"), partition_by=["year", "month"]).t()


@query("SELECT * FROM orders WHERE o_orderkey % 2 = 0")
def overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ds = _dataset(spark, "orders_over", o)
    ds.write_to_dataset(o.where("o_orderkey % 2 = 0"), mode="overwrite")
    return ds.load().t()


@query("SELECT * FROM orders")
def repartition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, "orders_repart", table(spark, sf_dir, "orders"))
    ds.repartition(["o_orderstatus"])
    return ds.t()


@query("SELECT * FROM orders")
def compact_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, "orders_compact", table(spark, sf_dir, "orders").repartition(16))
    ds.compact_by_rows(max_rows_per_file=1_000_000)
    return ds.t()


@query("SELECT DISTINCT * FROM nation")
def compact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    ds = _dataset(spark, "nation_twice", [n, n])
    ds.compact_by_rows(unique=True)
    return ds.t()


@query("SELECT * FROM orders")
def compact_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, "orders_ordered", table(spark, sf_dir, "orders").repartition(8))
    ds.compact_by_rows(max_rows_per_file=5000, sort_by="o_orderdate desc, o_orderkey")
    return ds.t()


@query("SELECT * FROM events")
def compact_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = _dataset(spark, "events_time", table(spark, sf_dir, "events").repartitionByRange(8, "ts"))
    ds.compact_by_timeperiod("7d", "ts")
    return ds.t()


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation")
def repair_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    ds = ParquetDataset(spark, scratch(spark, "nation_widths"), name="nation_widths")
    ds.write_to_dataset([n], alter_schema=True)
    ds.write_to_dataset([n.withColumn("n_nationkey", F.col("n_nationkey").cast("long"))], alter_schema=True)
    ds.update()
    return ds.t()


@query("SELECT CAST(p_partkey AS BIGINT) AS p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size FROM part")
def optimize_dtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("long"))
    ds = _dataset(spark, "part_text", p)
    ds.optimize_dtypes()
    return ds.t().select(F.col("p_partkey").cast("long"), "p_name", F.col("p_size").cast("long"))


# -- what maintenance leaves behind: files, their order and types, beside the rows
def _files(ds: ParquetDataset) -> DataFrame:
    """A row a file: its place in the order of names, rows, and row groups' least and greatest values."""
    table = ds.stats().groupBy("file_path").agg(F.sum("num_rows").alias("num_rows"), F.first("columns").alias("columns"), F.first("types").alias("types"))
    return table.withColumn("nth", F.row_number().over(Window.orderBy("file_path")).cast("long"))


@query("SELECT CAST(1 AS BIGINT) AS files, CAST(count(*) AS BIGINT) AS num_rows, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders")
def compact_rows_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen files become one, no row is lost."""
    ds = _dataset(spark, "orders_sixteen", table(spark, sf_dir, "orders").repartition(16))
    ds.compact_by_rows(max_rows_per_file=10_000_000)
    files = _files(ds).agg(F.count(F.lit(1)).alias("files"), F.sum("num_rows").alias("num_rows"))
    return files.crossJoin(ds.t().agg(F.sum("o_orderkey").alias("keys")))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS at FROM orders")
def compact_ordered_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's place when the files are read one after another in the order of their names."""
    ds = _dataset(spark, "orders_places", table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(6))
    ds.compact_by_rows(max_rows_per_file=4000, sort_by="o_totalprice desc, o_orderkey")
    one = ds.spark.read.parquet(ds.path).select("o_orderkey", F.col("_metadata.file_name").alias("file_path"), F.col("_metadata.row_index").alias("i"))
    before = F.sum("num_rows").over(Window.orderBy("nth").rowsBetween(Window.unboundedPreceding, -1))
    starts = _files(ds).select("file_path", F.coalesce(before, F.lit(0)).alias("before"))
    return one.join(starts, "file_path").select("o_orderkey", (F.col("before") + F.col("i") + 1).alias("at"))


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS num_rows, CAST(min(o_orderkey) AS BIGINT) AS least, CAST(max(o_orderkey) AS BIGINT) AS most FROM orders GROUP BY o_orderstatus")
def repartition_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders after repartitioning, from paths and footers alone."""
    ds = _dataset(spark, "orders_folders", table(spark, sf_dir, "orders"))
    ds.repartition(["o_orderstatus"])
    key = F.col("columns")["o_orderkey"]
    return ds.stats().groupBy(F.col("partition")["o_orderstatus"].alias("o_orderstatus")).agg(F.sum("num_rows").alias("num_rows"), F.min(key["min"].cast("long")).alias("least"), F.max(key["max"].cast("long")).alias("most"))


@query("SELECT CAST(count(*) AS BIGINT) AS windows FROM (SELECT DISTINCT floor((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 604800000000) FROM events)")
def compact_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many files as weeks, where each file held less than a week."""
    e = table(spark, sf_dir, "events")
    start = e.agg(F.unix_micros(F.min("ts").cast("timestamp"))).first()[0]
    week = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(start)) / F.lit(7 * 86_400_000_000))
    half = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(start)) / F.lit(7 * 43_200_000_000))
    split = e.withColumns({"w": week, "h": half}).repartition(8, "w", "h")
    ds = ParquetDataset(spark, scratch(spark, "events_weeks"), name="events_weeks")
    for r in split.select("w", "h").distinct().orderBy("w", "h").collect():
        ds.write_to_dataset(split.where((F.col("w") == r["w"]) & (F.col("h") == r["h"])).drop("w", "h").coalesce(1))
    ds.load().compact_by_timeperiod("7d", "ts")
    return _files(ds).agg(F.count(F.lit(1)).alias("windows"))


@query("SELECT 'p_partkey' AS name, 'int16' AS type UNION ALL SELECT 'p_size', 'int8' UNION ALL SELECT 'price', 'double' UNION ALL SELECT 'p_name', 'string'")
def optimize_dtypes_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored types after narrowing: text that spells whole numbers becomes one, text that does not stays."""
    p = table(spark, sf_dir, "part").where("p_partkey < 1000").select(F.col("p_partkey").cast("string"), "p_name", F.col("p_size").cast("long"), (F.col("p_size") / 3).alias("price"))
    ds = _dataset(spark, "part_types", p.coalesce(1))
    ds.optimize_dtypes(exclude=["price"])
    return ds.stats().select(F.explode("types").alias("name", "type")).distinct()


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(20, 2)) AS DOUBLE) AS price FROM orders WHERE CAST(o_totalprice AS DECIMAL(20, 2)) > 1000.55 AND CAST(o_totalprice AS DECIMAL(20, 2)) <= 20000.1")
def prune_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(20,2)").alias("price"))
    ds = _dataset(spark, "orders_decimal", o.repartitionByRange(12, "price"))
    p = "price > 1000.55 AND price <= 20000.1"
    return ds.scan(p).filter(p)().withColumn("price", F.col("price").cast("double"))


@query(f"SELECT * EXCLUDE (extra), extra FROM (SELECT *, CAST(NULL AS INTEGER) AS extra FROM ({_UPDATED}) UNION ALL SELECT *, CAST(NULL AS INTEGER) AS extra FROM ({_NEW})) AS x")
def merge_mixed_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An upsert into files of two schemas."""
    c = table(spark, sf_dir, "customer")
    ds = ParquetDataset(spark, scratch(spark, "customer_mixed"), name="customer_mixed")
    ds.write_to_dataset(c.where("c_custkey % 2 = 0").withColumn("c_nationkey", F.col("c_nationkey").cast("int")), alter_schema=True)
    ds.write_to_dataset(c.where("c_custkey % 2 = 1").withColumn("extra", F.lit(None).cast("int")), alter_schema=True)
    ds.load().merge(_changes(spark, sf_dir), "upsert", "c_custkey")
    return ds.t()


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey < 500 AND o_orderstatus IN ('F', 'P')")
def read_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file read with an Arrow expression."""
    import pyarrow.compute as pc

    return single.read_parquet(spark, f"{sf_dir}/orders.parquet", (pc.field("o_orderkey") < 500) & pc.field("o_orderstatus").isin(["F", "P"]), ["o_orderkey", "o_orderpriority"])


@query("SELECT n_nationkey, n_name, '7' AS region FROM nation")
def read_single_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file written, and read with its folder's value."""
    at = single.write_table(spark, table(spark, sf_dir, "nation"), f"{scratch(spark, 'one')}/region=7/nation.parquet")
    return single.read_table(spark, at, partitioning="hive").select("n_nationkey", "n_name", "region")


@query("SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, s_name, s_acctbal FROM supplier")
def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "supplier_csv")
    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").repartition(3).write.option("header", "true").csv(at)
    return CSVDataset(spark, at, name="supplier_csv").load().t().select(F.col("s_suppkey").cast("long"), "s_name", "s_acctbal")


@query("SELECT CAST(r_regionkey AS BIGINT) AS r_regionkey, r_name FROM region")
def read_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "region_json")
    table(spark, sf_dir, "region").select("r_regionkey", "r_name").repartition(2).write.json(at)
    return JSONDataset(spark, at, name="region_json").load().t().select("r_regionkey", "r_name")


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = Table(table(spark, sf_dir, "nation")), Table(table(spark, sf_dir, "region"))
    return n.join(r, "n_regionkey = r_regionkey").filter("r_name <> 'ASIA'").select(["n_name", "r_name"])()


@query("SELECT CAST(min(o_orderkey) AS BIGINT) AS least, CAST(max(o_orderkey) AS BIGINT) AS most FROM orders")
def metadata_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least and greatest key of all row groups, from the statistics view by SQL."""
    ds = _dataset(spark, "orders_bounds", table(spark, sf_dir, "orders").repartition(5))
    ds.metadata_table()
    return spark.sql("SELECT min(CAST(o_orderkey.min AS BIGINT)) AS least, max(CAST(o_orderkey.max AS BIGINT)) AS most FROM metadata_table")


@query("SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def catalog_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    import os
    import tempfile

    import yaml

    from parquarry.sources.catalog import Catalog

    tables = {"sales": {"customer": {"path": f"{sf_dir}/customer.parquet"}}, "ref": {"nation": {"path": f"{sf_dir}/nation.parquet"}}}
    fd, path = tempfile.mkstemp(suffix=".yml")  # the catalog file is the driver's
    with os.fdopen(fd, "w") as f:
        yaml.safe_dump({"tables": tables}, f)
    return Catalog(spark, path).sql("SELECT n_name, COUNT(*) AS customers FROM sales.customer JOIN ref.nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["join_inner3"](spark, sf_dir)
