"""Joins in time and ranges, composed of windows, buckets and equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, ts: str, value: str) -> DataFrame:
    """Each left row with ``value`` of the last right row of the same ``by`` that is not later; null if there is none.

    One sort of both sides together, no join: a window carries the last right value on. Of right rows
    of the same time the larger value counts.
    """
    r = right.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(F.col(value).alias("v")).alias("_value"), F.lit(None).cast(left.select(F.struct("*").alias("r")).schema["r"].dataType).alias("_row"))
    x = left.select(F.col(by).alias("_by"), F.col(ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_value"].dataType).alias("_value"), F.struct("*").alias("_row"))
    w = Window.partitionBy("_by").orderBy("_ts", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    both = r.unionByName(x).withColumn("_last", F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", F.col("_last.v").alias(f"last_{value}"))


def within(left: DataFrame, right: DataFrame, by: str, ts: str, seconds: int) -> DataFrame:
    """Pairs of rows of the same ``by`` at most so many seconds apart: an equality on time buckets, then the exact test.

    A right row goes to its own bucket and the ones beside it, so each pair meets once. Columns l (left row), r (right row).
    """
    at = F.col(ts).cast("timestamp").cast("double")
    bucket = F.floor(at / seconds)
    x = left.select(F.struct("*").alias("l"), F.col(by).alias("_by"), at.alias("_lt"), bucket.alias("_b"))
    y = right.select(F.struct("*").alias("r"), F.col(by).alias("_by"), at.alias("_rt"), bucket.alias("_own"))
    y = y.withColumn("_b", F.explode(F.sequence(F.col("_own") - 1, F.col("_own") + 1)))
    near = F.abs(F.col("_lt") - F.col("_rt")) <= seconds
    return x.join(y, ["_by", "_b"]).where(near).select("l", "r")


def in_bands(rows: DataFrame, bands: DataFrame, value: str) -> DataFrame:
    """Rows with the bands (low inclusive, high exclusive) they fall into; a table of bands is small, Spark decides how to send it."""
    return rows.join(bands, (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high")))


def ranks_of(rows: DataFrame, group: str, x: str, m: str) -> DataFrame:
    """Where a group's value ``m`` stands among its ``x``: how many there are (n), are less (lt) and at most m (le), and the values next to it.

    Counts, maxima and minima only: nothing is sorted or kept.
    """
    x, m = F.col(x), F.col(m)
    when = lambda c: F.when(c, x)
    return rows.groupBy(group).agg(
        F.count(x).alias("n"), F.count_if(x < m).alias("lt"), F.count_if(x <= m).alias("le"), F.first(m).alias("m"),
        F.max(when(x < m)).alias("below"), F.max(when(x <= m)).alias("upto"), F.min(when(x >= m)).alias("from"), F.min(when(x > m)).alias("above"),
    )


def _between(p: float, low: str, high: str) -> Column:
    """The percentile p, if it lies between two neighbouring values."""
    at = (F.col("n") - 1) * F.lit(p)
    lower, higher = F.floor(at), F.ceil(at)
    return F.when(lower == higher, F.col(low)).otherwise((higher - at) * F.col(low) + (at - lower) * F.col(high))


def at_least(p: float) -> Column:
    """Of ``ranks_of``: whether m is not less than the exact percentile p (interpolated)."""
    at = (F.col("n") - 1) * F.lit(p)
    return F.when(F.ceil(at) < F.col("le"), True).when(F.floor(at) >= F.col("le"), False).otherwise(F.col("m") >= _between(p, "upto", "above"))


def at_most(p: float) -> Column:
    """Of ``ranks_of``: whether m is not more than the exact percentile p (interpolated)."""
    at = (F.col("n") - 1) * F.lit(p)
    return F.when(F.floor(at) >= F.col("lt"), True).when(F.ceil(at) < F.col("lt"), False).otherwise(F.col("m") <= _between(p, "below", "from"))
