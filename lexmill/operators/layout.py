"""Repeated headers and footers, sections and table-of-contents paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def repeated_edges(pages: DataFrame, group: str, share: float = 0.5, most: int = 80, separator: str = "\n") -> DataFrame:
    """First and last non-blank lines (or what else is between separators) that are on more than ``share`` of a group's pages.

    ``pages``: the group column and text. Returns group, edge (first or last), line, n.
    """
    parts = F.split("text", "\\Q" + separator + "\\E")
    full = F.filter(F.transform(parts, T.stripped), lambda s: s != "")
    edges = pages.select(group, full.alias("f")).where(F.size("f") > 0).select(
        group, F.explode(F.array(F.struct(F.lit("first").alias("edge"), F.get("f", F.lit(0)).alias("line")), F.struct(F.lit("last").alias("edge"), F.element_at("f", -1).alias("line")))).alias("x")
    )
    counts = edges.select(group, "x.*").where(F.length("line") <= most).groupBy(group, "edge", "line").agg(F.count("*").alias("n"))
    pages_of = pages.groupBy(group).agg(F.count("*").alias("pages"))
    return counts.join(pages_of, group).where(F.col("n") > F.col("pages") * share).select(group, "edge", "line", "n")


def without_edges(pages: DataFrame, group: str, edges: DataFrame) -> DataFrame:
    """Pages with their first and last non-blank line dropped where it is a repeated one."""
    full = F.filter(F.transform(T.lines(F.col("text")), T.stripped), lambda s: s != "")
    p = pages.withColumn("_f", full).withColumn("_first", F.get("_f", F.lit(0))).withColumn("_last", F.try_element_at("_f", F.lit(-1)))
    for edge, column in (("first", "_first"), ("last", "_last")):
        e = edges.where(F.col("edge") == edge).select(F.col(group), F.col("line").alias(column), F.lit(True).alias(f"_is{edge}"))
        p = p.join(e, [group, column], "left")
    a = F.coalesce("_isfirst", F.lit(False)).cast("int")
    b = F.coalesce("_islast", F.lit(False)).cast("int")
    body = F.slice("_f", a + 1, F.greatest(F.size("_f") - a - b, F.lit(0)))
    return p.withColumn("text", F.array_join(body, "\n")).drop("_f", "_first", "_last", "_isfirst", "_islast")


def toc_path(toc: Column, page: Column) -> Column:
    """The path of headings that is open on a page: a stack cut to each entry's level."""
    start = F.array().cast("array<string>")
    return F.aggregate(F.filter(toc, lambda e: e["page"] <= page), start, lambda s, e: F.concat(F.slice(s, F.lit(1), e["level"] - 1), F.array(e["title"])))


def blocks_of(docs: DataFrame) -> DataFrame:
    """One row for each non-blank line: doc_id, block_idx, text, is_heading, level, tokens."""
    at = docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("block_idx", "text")).where(F.col("text").rlike(r"\S"))
    head = (F.length("text") <= 60) & (T.word_count(F.col("text")) <= 8)
    return at.select("doc_id", "block_idx", "text", head.alias("is_heading"), T.heading_level(F.col("text")).alias("level"), T.token_estimate(F.col("text")).alias("tokens"))


def with_sections(blocks: DataFrame) -> DataFrame:
    """Each block with the heading above it (its own, if it is one) as section_title and section_level."""
    w = Window.partitionBy("doc_id").orderBy("block_idx")
    title = F.last(F.when(F.col("is_heading"), F.col("text")), ignorenulls=True).over(w)
    level = F.last(F.when(F.col("is_heading"), F.col("level")), ignorenulls=True).over(w)
    return blocks.withColumn("section_title", title).withColumn("section_level", level)
