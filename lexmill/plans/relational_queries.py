"""Relational filters and set operations, and labelled extensions on the generic tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.catalog import merged_batches
from .registry import query


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query("publication_filter", "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part WHERE p_size >= 10 AND p_type IS NOT NULL AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#21', 'Brand#22') GROUP BY 1")
def publication_filter(spark, d):
    p = t(spark, d, "part").where((F.col("p_size") >= 10) & F.col("p_type").isNotNull() & F.col("p_brand").isin("Brand#11", "Brand#12", "Brand#13", "Brand#21", "Brand#22"))
    return p.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@query("merge_batches", "SELECT DISTINCT n_regionkey AS key, NULL::VARCHAR AS name FROM nation UNION SELECT r_regionkey, r_name FROM region")
def merge_batches(spark, d):
    return merged_batches(t(spark, d, "nation").select(F.col("n_regionkey").alias("key")), t(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name")))


@query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 4) AS mean_discount, count(*) AS n
    FROM lineitem GROUP BY 1, 2""",
)
def pricing_summary(spark, d):
    return t(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 4).alias("mean_discount"), F.count("*").alias("n")
    )


@query(
    "revenue_by_nation",
    """SELECT r_name, n_name, round(sum(o_totalprice), 2) AS revenue, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def revenue_by_nation(spark, d):
    o = t(spark, d, "orders").select("o_custkey", "o_totalprice").join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    n = t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count("*").alias("orders"))


@query("top_orders", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders) WHERE rank <= 3")
def top_orders(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t(spark, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("o_custkey", "o_orderkey", "rank")


@query("customers_without_orders", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("event_windows", "SELECT event_type, CAST(date_trunc('day', ts) AS VARCHAR)[:10] AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return t(spark, d, "events").groupBy("event_type", day).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(
    "event_sessions",
    """SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s
    FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY 1""",
)
def event_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"))
    gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)
    e = e.withColumn("new", F.when(gap <= 6 * 3600 * 1_000_000, 0).otherwise(1)).withColumn("s", F.sum("new").over(w))
    return e.groupBy("user_id", "s").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("event_props", "SELECT event_type, count(*) AS n, sum(json_extract(props, '$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def event_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
