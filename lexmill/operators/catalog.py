"""Catalogs, merges and completeness: joins and counts over document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cut_at_word


def source_catalog(docs: DataFrame) -> DataFrame:
    """Documents, characters, first document and a digest of the cut texts of every source.

    The digest is a sum over the documents, so no task holds a whole source.
    """
    own = F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(":"), cut_at_word(F.col("text"), 80)))
    digest = F.sum(F.conv(F.substring(own, 1, 8), 16, 10).cast("long"))
    chars = F.sum(F.length(F.trim(F.regexp_replace("text", r"\s+", " "))))
    return docs.groupBy("source").agg(F.count("*").alias("docs"), chars.alias("chars"), F.min("doc_id").alias("first_doc"), digest.alias("digest"))


def first_of_each(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order; ties must be broken by the order."""
    best = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("r")
    return df.groupBy(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(best).select("r.*")


def file_duplicates(files: DataFrame) -> DataFrame:
    """Which copy to keep of files with one name and size: one in a sub-folder before one at the root, then by path.

    Columns path, name, size, depth; adds keep and the bytes that deleting the others frees.
    """
    w = Window.partitionBy("name", "size")
    rank = F.row_number().over(w.orderBy((F.col("depth") == 1).cast("int"), "path"))
    n = F.count("*").over(w)
    return files.withColumn("keep", rank == 1).withColumn("copies", n).withColumn("freed", F.when(rank == 1, 0).otherwise(F.col("size"))).where("copies > 1")


def merged_batches(*frames: DataFrame) -> DataFrame:
    """All rows of tables that may lack columns, without full duplicates."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates()


def completeness(available: DataFrame, indexed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Per source: rows available, indexed in its collection, and the status missing, partial (below 90 %) or complete.

    ``available``: source, n; ``indexed``: collection, n; ``mapping``: source, collection.
    """
    a = available.select("source", F.col("n").alias("available"))
    i = indexed.select("collection", F.col("n").alias("indexed"))
    out = a.join(mapping, "source").join(i, "collection", "left").withColumn("indexed", F.coalesce("indexed", F.lit(0)))
    status = F.when(F.col("indexed") == 0, "missing").when(F.col("indexed") < F.col("available") * 0.9, "partial").otherwise("complete")
    share = F.round(F.least(F.lit(100.0), F.coalesce(F.try_divide(F.col("indexed") * 100.0, F.col("available")), F.lit(0.0))), 4)
    return out.select("source", "collection", "available", "indexed", share.alias("percent"), status.alias("status"))


def with_side(left: DataFrame, right: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Left join with a flag that tells which rows found a partner."""
    return left.join(right.withColumn(flag, F.lit(True)), on, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
