"""Search: nearest vectors, keyword scores, routing, staged ranking and diversification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import vectors as V
from ..functions.text import let, words
from .keywords import Asked, all_blocks, best_documents, rounded
from .nearest import Products, Vectors, best_of

#: Which collections each agent searches; general searches all.
ROUTES = {
    "policy": ("NIST_SP", "NIST_CSWP", "NIST_FIPS"),
    "research": ("USENIX",),
    "attack": ("MITRE",),
    "security": ("OWASP", "SecurityTools"),
    "ai": ("NIST_AI", "AISecKG"),
    "training": ("AnnoCTR",),
}
COLLECTIONS = tuple(sorted({c for cs in ROUTES.values() for c in cs}))
#: Queries are broadcast in blocks of at most this many rows.
QUERY_BLOCK = 2_000


def collection_of(key: Column) -> Column:
    """A collection for a row by a hash of its key."""
    return F.element_at(F.array(*map(F.lit, COLLECTIONS)), F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 6), 16, 10).cast("long"), F.lit(len(COLLECTIONS))).cast("int") + 1)


def routed(agent: Column, collection: Column) -> Column:
    """Whether an agent searches a collection; agents that are not known search all."""
    out = F.lit(True)
    for name, own in ROUTES.items():
        out = F.when(F.lower(agent) == name, collection.isin(*own)).otherwise(out)
    return out


def in_query_blocks(queries: DataFrame) -> list[DataFrame]:
    """The queries in blocks small enough to broadcast; their number is counted first."""
    n = max(1, -(-queries.count() // QUERY_BLOCK))
    if n == 1:
        return [queries]
    key = F.pmod(F.xxhash64(*queries.columns), F.lit(n))
    return [queries.where(key == i) for i in range(n)]


def nearest(queries: DataFrame, rows: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The k rows of the highest cosine for each query (and each value of ``by``), with ``semantic`` and ``rank``.

    ``queries``: query_id, qv[, agent]; ``rows``: id (a whole number), v, and what else is wanted.
    A stated set of queries against all rows. Every block of queries is broadcast; a task multiplies it with tiles of
    its rows, as matrices, and keeps k rows a query, however many rows it has. The products only tell which rows may be
    among the best; their cosines are computed like ``vectors.cosine``. Cosines are compared by nine digits, ties go to
    the smaller id, rows without a cosine come last. There is one task a core, so the shuffle grows with the queries only.
    """
    rows = rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)
    split = ("collection",) if "agent" in queries.columns and "collection" in rows.columns else ()
    found = {f.name: f for f in [*queries.schema.fields, *rows.schema.fields]}
    names = [*(c for c in rows.columns if c != "v"), *(c for c in queries.columns if c != "qv")]
    kind = StructType([*(StructField(c, found[c].dataType) for c in names), StructField("semantic", DoubleType()), StructField("_key", DoubleType())])
    out = None
    for q in in_query_blocks(queries):
        asked = q.sparkSession.sparkContext.broadcast(q.toArrow())

        def run(batches: Iterator[pa.RecordBatch], asked=asked) -> Iterator[pa.RecordBatch]:
            table = asked.value
            agents = [a and a.lower() for a in table["agent"].to_pylist()] if split else None

            def may(group: tuple) -> np.ndarray:
                return np.array([i for i in range(len(table)) if not split or agents[i] not in ROUTES or group[-1] in ROUTES[agents[i]]], np.int64)

            best = best_of(batches, table, k, by, split, may)
            if best is not None:
                yield from best.select(names + ["semantic", "_key"]).to_batches()

        one = rows.mapInArrow(run, kind)
        out = one if out is None else out.unionByName(one)
    w = Window.partitionBy("query_id", *by).orderBy(F.desc("_key"), F.asc_nulls_last("id"))
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_key")


def hybrid_best(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k rows of the highest hybrid score (by nine digits) for each query: query_id, doc_id, semantic, keyword, final, rank.

    ``queries``: query_id, terms, qv; ``rows``: doc_id, w (words), v. All rows are scored, those without a vector or a hit
    too, in one pass; a task keeps k rows a query.
    """

    def one(asked: Asked) -> DataFrame:
        vectors = Vectors(asked.table["qv"])

        def combine(x: np.ndarray, tile: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
            semantic = Products(Vectors(tile["v"]), vectors, np.arange(vectors.n)).rough
            semantic = np.where(np.isneginf(semantic), 0.0, np.where(np.isposinf(semantic), np.nan, semantic))
            keyword = 1 / (1 + np.exp(x * V.KEYWORD))
            final = semantic * 0.7 + np.minimum(keyword / 5, 1.0) * (1 - 0.7)
            return rounded(final, 9), {"semantic": semantic, "keyword": keyword, "final": final}

        return best_documents(rows, asked, k, ["semantic", "keyword", "final"], lambda text, term, tf, length: tf * 2.5 / (tf + 1.5), combine)

    return all_blocks(queries, one)


def staged(candidates: DataFrame, k: int, alpha: float = 0.7) -> DataFrame:
    """Hybrid score, top 4k, then by rerank score top 2k, with the rank among them.

    ``candidates``: query_id, id, semantic, keyword, rerank. The final score stays
    the hybrid one though the order is that of the rerank score.
    """
    c = candidates.withColumn("final", V.hybrid(F.col("semantic"), F.col("keyword"), alpha))
    first = Window.partitionBy("query_id").orderBy(F.desc("final"), "id")
    c = c.withColumn("hybrid_rank", F.row_number().over(first)).where(F.col("hybrid_rank") <= 4 * k)
    second = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "id")
    return c.withColumn("rank", F.row_number().over(second)).where(F.col("rank") <= 2 * k)


def diversified(ranked: DataFrame, k: int, most: float = 0.9, pages: int = 2) -> DataFrame:
    """Ranked rows without those too near to one kept before: the same document within
    ``pages`` pages, or a cosine above ``most``; the first k of each query.

    ``ranked``: query_id, rank, id, doc_id, page, v, at most a few dozen rows a query,
    so the fold over them stays small.
    """
    item = F.struct("rank", "id", "doc_id", "page", "v")
    kind = "array<struct<rank:int,id:bigint,doc_id:bigint,page:int,v:array<float>>>"

    def step(kept, r):
        near = F.exists(kept, lambda o: ((o["doc_id"] == r["doc_id"]) & (F.abs(o["page"] - r["page"]) <= pages)) | (V.cosine(o["v"], r["v"]) > most))
        return F.when(near, kept).otherwise(F.concat(kept, F.array(r)))

    rows = F.array_sort(F.collect_list(item)).cast(kind)
    g = ranked.groupBy("query_id").agg(F.aggregate(rows, F.array().cast(kind), step).alias("kept"))
    return g.select("query_id", F.posexplode(F.slice("kept", 1, k)).alias("place", "r")).select("query_id", (F.col("place") + 1).alias("place"), "r.rank", "r.id")


def explained(query_terms: Column, content: Column) -> dict[str, Column]:
    """How many of the query's terms a text has, their share, and its length in words."""
    tokens = words(F.lower(content))
    hits = F.size(F.array_intersect(query_terms, tokens))
    share = F.round(F.coalesce(F.try_divide(hits, F.size(F.array_distinct(query_terms))), F.lit(0.0)), 2)
    return {"matched_terms": hits, "match_share": share, "doc_words": F.size(words(content))}


def highlighted(content: Column, query_terms: Column, window: int = 50, otherwise: int = 300) -> Column:
    """The window of words with most query terms (the first of equals), hits in capitals; the beginning, if none."""
    def of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - window, F.lit(0)))

        def scored(i: Column) -> Column:
            part = F.slice(w, i + 1, F.lit(window))
            n = F.size(F.filter(query_terms, lambda t: F.exists(part, lambda x: F.contains(F.lower(x), t))))
            return F.struct(n.alias("n"), (-i).alias("i"))

        def shown(best: Column) -> Column:
            loud = F.transform(F.slice(w, -best["i"] + 1, F.lit(window)), lambda x: F.when(F.array_contains(query_terms, F.lower(x)), F.upper(x)).otherwise(x))
            return F.when(best["n"] > 0, F.array_join(loud, " ")).otherwise(F.substring(content, 1, otherwise))

        return let(F.array_max(F.transform(starts, scored)), shown)

    return let(words(content), of)


def suggested_terms(results: DataFrame, query_terms: list[str], stop: tuple[str, ...], n: int = 20) -> DataFrame:
    """The commonest words of four letters or more in the results, ties by first appearance: term, n."""
    at = results.select("rank", F.posexplode(words(F.lower(F.col("content")))).alias("pos", "term"))
    good = at.where((F.length("term") > 3) & ~F.col("term").isin(*query_terms, *stop))
    counts = good.groupBy("term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(n).select("term", "n")


def search_quality(results: DataFrame) -> DataFrame:
    """Count, mean, variance and deviation of the scores, collections and mean length of each query's results."""
    return results.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.round(F.avg("score"), 4).alias("mean_score"),
        F.round(F.var_pop("score"), 4).alias("var_score"),
        F.round(F.stddev_pop("score"), 4).alias("std_score"),
        F.count_distinct("collection").alias("collections"),
    )
