"""Relational features that come from Spark itself, as queries over the plain tables.

Each text runs unchanged in Spark and in DuckDB where their dialects agree, so it is its own oracle.
"""

from __future__ import annotations

from datetime import timedelta

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from rasterspark.operators.joins import as_of_join, interval_join
from rasterspark.session import Scratch
from rasterspark.streaming import events as event_streams
from rasterspark.streaming.scenes import run_available

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SHARED = {
    "host_filter_case": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size_class FROM orders WHERE o_orderpriority LIKE '%HIGH%' OR o_orderstatus = 'F'",
    "host_pricing_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "host_join_group": "SELECT r_name, n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name HAVING count(*) > 5",
    "host_outer_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "host_semi_anti": "SELECT 'with' AS kind, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) UNION ALL SELECT 'without', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "host_subquery": "WITH big AS (SELECT c_nationkey, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey) SELECT c_custkey, c_acctbal FROM customer JOIN big USING (c_nationkey) WHERE c_acctbal = top AND c_acctbal > (SELECT avg(c_acctbal) FROM customer)",
    "host_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "host_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_linestatus) AS BIGINT) AS g FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "host_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())",
    "host_any_value": "SELECT c_custkey, any_value(c_name) AS c_name, any_value(c_mktsegment) AS segment, count(o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "host_typeof": "SELECT lower(typeof(o_orderkey)) AS key_type, lower(typeof(o_totalprice)) AS price_type, lower(typeof(o_orderkey > 5)) AS test_type, count(*) AS n FROM orders GROUP BY 1, 2, 3",
    "host_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "host_window": "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders",
    "host_topk": "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10",
    "host_set_operations": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)",
    "host_strings": "SELECT p_partkey, concat(upper(substring(p_name, 1, 3)), '-', replace(p_brand, '#', '_')) AS label, CAST(length(p_type) AS BIGINT) AS n FROM part",
}


def _shared(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if name in sql:
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(sql)

    return run


def host_lists_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.groupBy("event_type").agg(F.array_sort(F.collect_set(k)).alias("ks")).select("event_type", F.size("ks").alias("n"), F.element_at("ks", 1).alias("first"), F.aggregate("ks", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


def host_time_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "total")


def host_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql("DESCRIBE QUERY SELECT o_orderkey, o_totalprice, o_totalprice > 0 AS positive FROM orders").select("col_name", "data_type")


def host_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate aggregates beside the exact ones: within 5 % in distinct values, within 2 % in the rank of the median."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    exact, near = F.count_distinct("user_id"), F.approx_count_distinct("user_id", 0.01)
    median = events.groupBy("event_type").agg(F.percentile_approx("value", 0.5, 10_000).alias("median"))
    rank = F.avg((F.col("value") <= F.col("median")).cast("double"))
    out = events.join(median, "event_type").groupBy("event_type").agg(exact.alias("users"), (F.abs(near - exact) <= exact * 0.05).alias("near"), (F.abs(rank - 0.5) < 0.02).alias("middle"))
    return out.select("event_type", "users", "near", "middle")


def _visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Events of the even ids, and for each user and time the largest value of those of the odd ids."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), events.where("event_id % 2 = 1").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))


def host_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _visits(spark, sf_dir)
    return as_of_join(left, right, by=["user_id"], at="ts", take=["last_value"], width=86_400).select("event_id", "last_value")


def host_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    bands = part.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("band"), (F.col("p_retailprice") - 5).alias("lo"), (F.col("p_retailprice") + 5).alias("hi"))
    met = interval_join(part.select("p_partkey", "p_retailprice"), bands, at="p_retailprice", low="lo", high="hi", width=10.0)
    return met.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first"))


def host_theta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join on inequalities of both sides, as an interval join plus a condition."""
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    low = supplier.select(F.col("s_suppkey").alias("a"), F.col("s_acctbal").alias("lo"), (F.col("s_acctbal") + 100).alias("hi"))
    met = interval_join(supplier.select(F.col("s_suppkey").alias("b"), F.col("s_acctbal").alias("at")), low, at="at", low="lo", high="hi", width=100.0)
    return met.where("a <> b AND at > lo").select("a", "b")


def host_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written in three formats, one of them partitioned, and read back."""
    scratch, out = Scratch(spark, "sinks"), None
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_totalprice")
    for kind in ("parquet", "json", "csv"):
        at = f"{scratch.path}/{kind}"
        writer = orders.write.partitionBy("o_orderstatus") if kind == "parquet" else orders.write
        writer.format(kind).save(at)
        back = spark.read.schema(orders.schema).format(kind).load(at).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.sum("o_orderkey").alias("ids"))
        back = back.select(F.lit(kind).alias("sink"), "o_orderstatus", "n", "total", "ids")
        out = back if out is None else out.unionByName(back)
    return out


def _streamed(spark: SparkSession, sf_dir: str, make) -> DataFrame:
    """Result of a stream over the events in three batches: the earlier half, the later half, and a part of what is a day older again, too late."""
    scratch = Scratch(spark, "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    middle = low + (high - low) / 2
    late = (F.col("ts") < F.lit(middle - timedelta(days=1))) & (F.col("event_id") % 10 == 0)
    for rows in (events.where(F.col("ts") < F.lit(middle)), events.where(F.col("ts") >= F.lit(middle)), events.where(late)):
        rows.coalesce(1).write.mode("append").parquet(f"{scratch.path}/in")  # one file for each batch
    stream = event_streams.arrivals(spark, f"{scratch.path}/in", events.schema, files_per_trigger=1)
    run_available(make(stream), f"{scratch.path}/out", f"{scratch.path}/state")
    return spark.read.parquet(f"{scratch.path}/out")


_STAMP = "yyyy-MM-dd HH:mm:ss"


def host_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda s: event_streams.tumbling(s, time="ts", keys=["event_type"], value="value", size="1 hour", late="2 hours"))
    return out.select(F.date_format("start", _STAMP).alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def host_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, lambda s: event_streams.sessions(s, time="ts", keys=["user_id"], value="value", gap="30 minutes", late="2 hours"))
    return out.select("user_id", F.date_format("start", _STAMP).alias("start"), F.date_format("end", _STAMP).alias("until"), "n", F.round("total", 2).alias("total"))


OWN = (host_lists_json, host_time_windows, host_describe, host_approximate, host_as_of_join, host_interval_join, host_theta_join, host_sinks, host_stream_windows, host_stream_sessions)
QUERIES = {name: _shared(sql) for name, sql in SHARED.items()} | {f.__name__: f for f in OWN}
_LATEST = "latest AS (SELECT max(ts) - INTERVAL 2 HOUR AS mark FROM events)"
ORACLE = SHARED | {
    "host_lists_json": "SELECT event_type, CAST(len(ks) AS INTEGER) AS n, ks[1] AS first, CAST(list_sum(ks) AS BIGINT) AS total FROM (SELECT event_type, list_sort(list_distinct(list(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER)))) AS ks FROM events GROUP BY event_type)",
    "host_time_windows": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
    "host_describe": "SELECT column_name AS col_name, lower(column_type) AS data_type FROM (DESCRIBE SELECT o_orderkey, o_totalprice, o_totalprice > 0 AS positive FROM orders)",
    "host_approximate": "SELECT event_type, count(DISTINCT user_id) AS users, true AS near, true AS middle FROM events GROUP BY event_type",
    "host_as_of_join": "SELECT e.event_id, v.last_value FROM (SELECT * FROM events WHERE event_id % 2 = 0) e ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS last_value FROM events WHERE event_id % 2 = 1 GROUP BY user_id, ts) v ON e.user_id = v.user_id AND e.ts >= v.ts",
    "host_interval_join": "SELECT b.p_partkey AS band, count(*) AS n, min(p.p_partkey) AS first FROM part b JOIN part p ON p.p_retailprice BETWEEN b.p_retailprice - 5 AND b.p_retailprice + 5 WHERE b.p_partkey % 20 = 0 GROUP BY b.p_partkey",
    "host_theta_join": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_acctbal <= a.s_acctbal + 100 AND a.s_suppkey <> b.s_suppkey",
    "host_sinks": "SELECT sink, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, CAST(sum(o_orderkey) AS BIGINT) AS ids FROM orders, (VALUES ('parquet'), ('json'), ('csv')) AS k(sink) GROUP BY sink, o_orderstatus",
    "host_stream_windows": f"WITH {_LATEST} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, latest WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= mark GROUP BY date_trunc('hour', ts), event_type",
    "host_stream_sessions": f"WITH {_LATEST}, gaps AS (SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM gaps), "
    "found AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n, round(sum(value), 2) AS total FROM numbered GROUP BY user_id, k) "
    "SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS until, n, total FROM found, latest WHERE b <= mark",
}
