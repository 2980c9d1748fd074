"""The whole search as one plan over a batch of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions import vectors as V
from ..functions.text import words
from ..operators import search as S
from ..operators.embedding import query_terms
from ..operators.keywords import term_scores
from ..operators.records import newest


def search(queries: DataFrame, index: DataFrame, k: int = 8, rerank: bool = True, filters: Column | None = None, config: SearchConfig | None = None) -> DataFrame:
    """Results of a batch of queries, best first.

    ``queries``: query_id, text, qv (vector), agent. ``index``: id, doc_id, page,
    collection, content, v, and any columns the filter names. The filter and the
    agent's collections restrict the rows before anything is scored. Steps: nearest
    rows of each collection, hybrid score, the best 4k, rerank by corpus BM25 to 2k,
    diversification to k, highlight and explanation. Ties go to the smaller id. Blank
    queries have no results.
    """
    c = config or SearchConfig()
    if filters is not None:
        index = index.where(filters)
    q = queries.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("terms", query_terms(F.col("text"), c.max_query_chars))
    rows = index.select("id", "collection", "v", F.col("v").cast("array<float>").alias("own_v"))
    near = S.nearest(q.select("query_id", "qv", "agent"), rows, c.per_collection * k, ("collection",)).select("query_id", "id", "semantic", "own_v")
    body = near.join(index.select("id", "doc_id", "page", "collection", "content"), "id").join(q.select("query_id", "terms"), "query_id")
    body = body.withColumn("tokens", words(F.lower("content")))
    if rerank:
        # Only rows that are near need their scores; the statistics are those of all.
        x = term_scores(q.select("query_id", "terms"), index.select(words(F.lower("content")).alias("w")), F.col("terms"), F.col("tokens"))
        scored = body.withColumn("x", x).withColumn("keyword", V.keyword_score_of(F.col("x.x"))).withColumn("rerank", F.col("x.bm25")).drop("tokens", "x")
    else:
        scored = body.withColumn("keyword", V.keyword_score_compat(F.col("terms"), F.col("tokens"))).drop("tokens")
        scored = scored.withColumn("rerank", V.hybrid(F.col("semantic"), F.col("keyword"), c.alpha))
    ranked = S.staged(scored, k, c.alpha).withColumnRenamed("own_v", "v")
    picked = ranked.select("query_id", "rank", "id", F.col("doc_id").cast("long").alias("doc_id"), F.col("page").cast("int").alias("page"), "v")
    best = S.diversified(picked, k, c.max_cosine, c.page_distance).drop("rank")
    out = best.join(ranked.drop("v", "rank"), ["query_id", "id"])
    why = S.explained(F.col("terms"), F.col("content"))
    return out.select(
        "query_id",
        "place",
        "id",
        "doc_id",
        "collection",
        F.when(F.length("content") > 500, F.concat(F.substring("content", 1, 500), F.lit("..."))).otherwise(F.col("content")).alias("content"),
        F.struct(*[F.round(s, 4).alias(s) for s in ("semantic", "keyword", "rerank", "final")]).alias("scores"),
        S.highlighted(F.col("content"), F.col("terms")).alias("highlight"),
        *[v.alias(n) for n, v in why.items()],
    )


def cached_answers(answers: DataFrame, asked: DataFrame, seconds: int = 3600) -> DataFrame:
    """Each question with the newest answer that was there when it was asked and not older than its time to live.

    Both have ``key`` and ``ts``; the answer's time is ``made``.
    """
    made = answers.withColumnRenamed("ts", "made")
    age = F.col("ts").cast("long") - F.col("made").cast("long")
    found = asked.join(made, "key").where((age >= 0) & (age < seconds))
    return newest(found, asked.columns, "made")
