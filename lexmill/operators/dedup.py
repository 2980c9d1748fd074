"""Exact and near duplicates of chunks, and overlap with other texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, words


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, canonical (smallest doc_id of the same text) and copies of texts that occur more than once."""
    key = F.sha2("text", 256)
    d = docs.select("doc_id", key.alias("k"))
    groups = d.groupBy("k").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(groups, "k").select("doc_id", "canonical", "copies")


def shingles(text: Column, n: int = 3) -> Column:
    """Sorted distinct hashes of all runs of n lower-case words."""
    def of(w: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(w) - n + 1)
        runs = F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(n)), " ")))
        return F.when(F.size(w) >= n, F.array_sort(F.array_distinct(runs))).otherwise(F.array().cast("array<bigint>"))

    return let(words(F.lower(text)), of)


def first_copies(docs: DataFrame) -> DataFrame:
    """doc_id and text of the first document of each distinct text."""
    return docs.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")


def near_duplicates(docs: DataFrame, threshold: float = 0.9, n: int = 3) -> DataFrame:
    """Pairs (a, b, jaccard) of different texts with shingle sets of at least that Jaccard similarity.

    Equal texts are one, by their first document (``exact_duplicates`` has the others). Prefix
    filter in order of rarity: of two such sets the first ``size - ceil(t size) + 1`` shingles
    of each share one, so only these are joined, and of them only those that occur twice. What
    many texts have in common comes last and is not joined at all. Sizes must fit as well.
    """
    texts = first_copies(docs)
    # Shingles once a text: a filter or a size beside them would compute them again.
    own = let(shingles(F.col("text"), n), lambda s: F.transform(s, lambda h: F.struct(F.size(s).alias("n"), h.alias("h"))))
    each = texts.select("doc_id", F.inline(own))
    again = each.withColumn("df", F.count("*").over(Window.partitionBy("h"))).where("df > 1")
    ordered = again.groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("t"))
    # Those that occur once come first in the order, and are not here.
    alone = F.col("n") - F.size("t")
    prefix = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9).cast("int") + 1
    tokens = ordered.where(prefix > alone).select("doc_id", "n", F.explode(F.slice("t", F.lit(1), prefix - alone)).alias("x")).select("doc_id", "n", "x.h")
    b = tokens.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "h")
    a = tokens.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "h")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    pairs = a.join(b, "h").where(fits).select("a", "b").distinct()
    members = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    s = texts.join(members, "doc_id", "left_semi").select("doc_id", shingles(F.col("text"), n).alias("s"))
    sa, sb = s.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), s.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    both = pairs.join(sa, "a").join(sb, "b").withColumn("o", F.size(F.array_intersect("sa", "sb")))
    j = F.col("o") / (F.size("sa") + F.size("sb") - F.col("o"))
    return both.select("a", "b", j.alias("j")).where(F.col("j") >= threshold).select("a", "b", F.round("j", 4).alias("jaccard"))


def benchmark_overlap(docs: DataFrame, items: DataFrame, n: int = 8) -> DataFrame:
    """doc_id, item_id and how many distinct runs of n words of the item the document has."""
    d = docs.select("doc_id", F.explode(shingles(F.col("text"), n)).alias("h"))
    i = items.select("item_id", F.explode(shingles(F.col("text"), n)).alias("h"))
    return d.join(i, "h").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


def term_counts(docs: DataFrame, n: int) -> DataFrame:
    """The n commonest words of four letters or more: word, n; ties by the word."""
    w = docs.select(F.explode(words(F.lower("text"))).alias("word")).where(F.length("word") > 3)
    return w.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(n)


def deterministic_uuid(*parts: Column) -> Column:
    """A version 5 UUID of the parts joined by colons, in the URL namespace."""
    ns = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(ns, F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )
