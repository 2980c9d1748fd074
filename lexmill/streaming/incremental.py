"""Incremental jobs with Structured Streaming: upserts, windows, sessions, first occurrences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.records import newest
from ..functions.text import normalised, quality_flags, token_estimate


def read(spark: SparkSession, path: str, schema: str, fmt: str = "json", files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def cleaned(docs: DataFrame) -> DataFrame:
    """Normalised text, its flags and token estimate; stateless, so the same in batches and streams."""
    t = docs.withColumn("text", normalised(F.col("text")))
    return t.withColumn("flags", quality_flags(F.col("text"))).withColumn("tokens", token_estimate(F.col("text")))


def upsert(stream: DataFrame, out: str, checkpoint: str, keys: list[str], order: list[str], buckets: int = 16) -> StreamingQuery:
    """Keep one row a key, the last by ``order``, however often it comes and in whichever micro-batch.

    Keys are hashed into buckets. A batch writes a new version of the buckets it touches, named by
    its number: the rows of the version before it and its own, the newest of each key. A batch that
    is repeated replaces its own version. ``current`` reads the latest version of every bucket.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        b = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        touched = [r[0] for r in b.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        if number > 0:
            before = current(spark, out, below=number)
            if before is not None:
                b = b.unionByName(before.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).where(F.col("bucket").isin(touched)))
        rows = newest(b, keys, *order)
        for_bucket = rows.withColumn("version", F.lit(number))
        for_bucket.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(out)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, below: int | None = None) -> DataFrame | None:
    """The rows of the latest version (before ``below``) of every bucket of an upserted table; None if there is none yet."""
    try:
        rows = spark.read.parquet(out)
    except AnalysisException:
        return None
    if below is not None:
        rows = rows.where(F.col("version") < below)
    last = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(last, ["bucket", "version"]).drop("bucket", "version")


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    """Rows whose keys did not occur within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Count and sum of values in tumbling or sliding windows."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n"))
