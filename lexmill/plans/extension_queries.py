"""Labelled extensions on the generic tables: joins in time and ranges, sets, cubes, dates, sketches, functions in SQL, streams."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

import pandas as pd
from pyspark.sql import functions as F

from ..operators import temporal as J
from ..streaming import incremental as I
from .registry import query


def t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(
    "asof_join",
    """SELECT a.event_id, max(b.event_id) AS last_event_id FROM events a LEFT JOIN events b ON b.user_id = a.user_id AND b.event_id % 10 <> 0 AND b.ts = (SELECT max(c.ts) FROM events c WHERE c.user_id = a.user_id AND c.event_id % 10 <> 0 AND c.ts <= a.ts)
    WHERE a.event_id % 10 = 0 GROUP BY 1""",
)
def asof_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    left, right = e.where("event_id % 10 = 0"), e.where("event_id % 10 <> 0")
    return J.as_of(left, right, "user_id", "ts", "event_id").select("event_id", "last_event_id")


@query("interval_join", "SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id <> b.event_id AND abs(epoch(a.ts) - epoch(b.ts)) <= 7200 GROUP BY 1")
def interval_join(spark, d):
    e = t(spark, d, "events").select("event_id", "user_id", "ts")
    return J.within(e, e, "user_id", "ts", 7200).where("l.event_id <> r.event_id").groupBy(F.col("l.event_id").alias("event_id")).agg(F.count("*").alias("near"))


@query("range_join", "SELECT band, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN (VALUES ('low', 0, 10000), ('middle', 10000, 30000), ('high', 20000, 1000000)) b(band, low, high) ON l_extendedprice >= low AND l_extendedprice < high GROUP BY 1")
def range_join(spark, d):
    bands = spark.createDataFrame([("low", 0.0, 1e4), ("middle", 1e4, 3e4), ("high", 2e4, 1e6)], "band string, low double, high double")
    return J.in_bands(t(spark, d, "lineitem").select("l_extendedprice", "l_quantity"), bands, "l_extendedprice").groupBy("band").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("cube_sales", "SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_sales(spark, d):
    c = t(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
    return c.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@query("grouping_sets", "SELECT coalesce(o_orderstatus, '*') AS status, coalesce(o_orderpriority, '*') AS priority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(spark, d):
    o = t(spark, d, "orders")
    g = o.groupingSets([[o.o_orderstatus], [o.o_orderpriority], []], o.o_orderstatus, o.o_orderpriority).agg(F.count("*").alias("n"))
    return g.select(F.coalesce("o_orderstatus", F.lit("*")).alias("status"), F.coalesce("o_orderpriority", F.lit("*")).alias("priority"), "n")


@query("set_operations", "SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'first', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, d):
    c, o = t(spark, d, "customer").select("c_custkey"), t(spark, d, "orders").select("o_custkey")
    one = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one(c.intersect(o), "both").unionByName(one(c.subtract(o), "first"))


@query(
    "dates_decimals",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m') AS month, count(*) AS n, sum(o_totalprice::DECIMAL(18, 2))::VARCHAR AS total, max(date_diff('day', o_orderdate::DATE, DATE '2030-01-01'))::INT AS oldest FROM orders GROUP BY 1",
)
def dates_decimals(spark, d):
    o = t(spark, d, "orders")
    return o.groupBy(F.date_format(F.date_trunc("month", "o_orderdate"), "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("string").alias("total"), F.max(F.date_diff(F.lit("2030-01-01").cast("date"), F.col("o_orderdate").cast("date"))).alias("oldest")
    )


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_status(spark, d):
    p = t(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *[F.coalesce(c, F.lit(0)).alias(c.lower()) for c in "FOP"])


@query(
    "approximate_counts",
    "SELECT l_returnflag, count(DISTINCT l_partkey) AS exact, TRUE AS near, TRUE AS median_near FROM lineitem GROUP BY 1",
)
def approximate_counts(spark, d):
    """Sketches against exact values: distinct counts within a tenth, medians within a hundredth of the ranks.

    The distinct pairs are counted by themselves, as sketches beside them would be kept for every pair. The exact
    percentiles are not made: ranks of the approximate median, counted in a second pass, tell on which side they are.
    """
    rows = t(spark, d, "lineitem").select("l_returnflag", "l_partkey", F.col("l_extendedprice").alias("x"))
    sketches = rows.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"), F.percentile_approx("x", F.lit(0.5), F.lit(1000)).alias("m"))
    exact = rows.where("l_partkey is not null").select(F.col("l_returnflag").alias("flag"), "l_partkey").distinct().groupBy("flag").agg(F.count("*").alias("exact"))
    medians = sketches.select(F.col("l_returnflag").alias("flag"), "m")
    ranks = J.ranks_of(rows.join(F.broadcast(medians), F.col("l_returnflag").eqNullSafe(F.col("flag"))), "flag", "x", "m")
    near = ranks.select(F.col("flag").alias("of"), (J.at_least(0.49) & J.at_most(0.51)).alias("median_near"))
    out = sketches.join(exact, F.col("l_returnflag").eqNullSafe(F.col("flag")), "left").join(near, F.col("l_returnflag").eqNullSafe(F.col("of")))
    n = F.coalesce("exact", F.lit(0)).cast("long")
    return out.select("l_returnflag", n.alias("exact"), (F.abs(F.col("a") - n) <= n * 0.1).alias("near"), "median_near")


@query("sql_functions", r"SELECT lang, sum(len(regexp_extract_all(text, '\S+')))::BIGINT AS words, sum(len(text) * 2)::BIGINT AS twice FROM documents GROUP BY 1")
def sql_functions(spark, d):
    """A vectorised function and a table function, registered and called from SQL."""

    @F.pandas_udf("long")
    def twice(n: pd.Series) -> pd.Series:
        return n * 2

    @F.udtf(returnType="word string")
    class Words:
        def eval(self, text: str):
            for w in (text or "").split():
                yield (w,)

    spark.udf.register("lexmill_twice", twice)
    spark.udtf.register("lexmill_words", Words)
    docs = t(spark, d, "documents").select("lang", "text")
    words = spark.sql("SELECT lang, count(*) AS words FROM {docs} AS x, LATERAL lexmill_words(x.text) GROUP BY lang", docs=docs)
    both = spark.sql("SELECT lang, sum(lexmill_twice(length(text))) AS twice FROM {docs} GROUP BY lang", docs=docs)
    return words.join(both, "lang").select("lang", "words", "twice")


def folder(spark) -> str:
    """A folder for a stream's state: shared by the cluster where it names one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="lexmill-stream-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
    return os.path.join(at, f"stream-{uuid.uuid4().hex}")


def streamed(spark, d, name):
    """A table as a stream of its files."""
    one = t(spark, d, name)
    return spark.readStream.schema(one.schema).parquet(f"{d}/{name}.parquet*")


@query("stream_windows", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    """The events as a stream in daily windows; what the stream has written when it has read all there is."""
    at = folder(spark)
    e = streamed(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = I.windowed(e, "1 day").select("event_type", F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", F.round("total", 2).alias("total"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{at}/out")

    w.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")


@query("stream_upsert", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def stream_upsert(spark, d):
    """The events as a stream into a table with one row a user: the newest wins, in whatever batch it comes."""
    at = folder(spark)
    rows = streamed(spark, d, "events").select("user_id", "event_id", "ts")
    I.upsert(rows, f"{at}/out", f"{at}/state", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return I.current(spark, f"{at}/out").select("user_id", "event_id")
