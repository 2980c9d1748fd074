"""Writers: JSON lines, CSV, collections, and upserts that can be repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str, by: str | None = None, mode: str = "errorifexists") -> None:
    """JSON lines, one folder for each value of ``by``; mode ``ignore`` skips what is there."""
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).json(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def sheets(frames: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """One Parquet table for each sheet of a report."""
    for name, df in frames.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def create_collection(spark: SparkSession, name: str, columns: str, path: str | None = None) -> None:
    """A table partitioned by collection, if there is none of that name."""
    where = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}, collection STRING) USING parquet PARTITIONED BY (collection){where}")


def drop_collections(spark: SparkSession, names: list[str]) -> None:
    for n in names:
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows without those that new rows replace, and the last new row of each key."""
    last = new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), order).alias("r")).select("r.*")
    return old.join(last, keys, "left_anti").unionByName(last)
