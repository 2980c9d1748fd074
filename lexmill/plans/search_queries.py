"""Queries on vectors and keyword scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import words
from ..operators import search as S
from ..operators.chunking import boundary_scores
from ..operators.keywords import bm25_best
from ..session import spread
from .registry import query
from .text_queries import docs

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
COS = f"{DOT.format(a='{a}', b='{b}')} / (sqrt({DOT.format(a='{a}', b='{a}')}) * sqrt({DOT.format(a='{b}', b='{b}')}))"
COLLECTION = f"([{', '.join(repr(c) for c in S.COLLECTIONS)}])[(('0x' || substr(md5({{k}}::VARCHAR), 1, 6))::BIGINT % {len(S.COLLECTIONS)})::INT + 1]"
#: Which part of the ids asks: a search's stated query set.
ASKS = 50


def embeddings(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def asked(spark, d):
    return embeddings(spark, d).where(F.col("vec_id") % ASKS == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qv"))


def vectors(spark, d, *cols):
    """All rows as id and v, over all cores."""
    return spread(embeddings(spark, d)).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), *cols)


PAIRS = f"""SELECT q.vec_id AS query_id, e.vec_id AS id, {COLLECTION.format(k='e.vec_id')} AS collection, {COS.format(a='q.embedding', b='e.embedding')} AS semantic
 FROM embeddings q, embeddings e WHERE q.vec_id % {ASKS} = 0"""


@query(
    "cosine_topk",
    f"SELECT query_id, id, rank, round(semantic, 4) AS semantic FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC, id)::INT AS rank FROM ({PAIRS})) WHERE rank <= 10",
)
def cosine_topk(spark, d):
    rows = vectors(spark, d)
    return S.nearest(asked(spark, d), rows, 10).select("query_id", "id", "rank", F.round("semantic", 4).alias("semantic"))


@query(
    "topk_per_collection",
    f"SELECT query_id, collection, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY round(semantic, 9) DESC, id)::INT AS rank FROM ({PAIRS})) WHERE rank <= 3",
)
def topk_per_collection(spark, d):
    rows = vectors(spark, d, S.collection_of(F.col("vec_id")).alias("collection"))
    return S.nearest(asked(spark, d), rows, 3, ("collection",)).select("query_id", "collection", "id", "rank")


AGENTS = [*S.ROUTES, "general"]
ROUTE = "CASE agent " + " ".join(f"WHEN '{a}' THEN collection IN ({', '.join(repr(c) for c in cs)})" for a, cs in S.ROUTES.items()) + " ELSE TRUE END"


@query(
    "routed_search",
    f"""WITH p AS (SELECT *, ([{', '.join(repr(a) for a in AGENTS)}])[(query_id // {ASKS} % {len(AGENTS)})::INT + 1] AS agent FROM ({PAIRS}))
    SELECT query_id, agent, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC, id)::INT AS rank FROM p WHERE {ROUTE}) WHERE rank <= 5""",
)
def routed_search(spark, d):
    agent = F.element_at(F.array(*map(F.lit, AGENTS)), ((F.col("query_id") / ASKS).cast("long") % len(AGENTS)).cast("int") + 1)
    rows = vectors(spark, d, S.collection_of(F.col("vec_id")).alias("collection"))
    return S.nearest(asked(spark, d).withColumn("agent", agent), rows, 5).select("query_id", "agent", "id", "rank")


ITEM_TERMS = r"list_distinct(regexp_extract_all(lower(text), '\S+'))"


HYBRID = rf"""WITH q AS (SELECT item_id AS query_id, {ITEM_TERMS} AS terms, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id),
 t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT unnest(terms) FROM q) GROUP BY 1, 2),
 k AS (SELECT query_id, doc_id, sum(tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE)) AS s FROM (SELECT query_id, unnest(terms) AS term FROM q) JOIN c USING (term) GROUP BY 1, 2),
 p AS (SELECT q.query_id, d.doc_id, coalesce({COS.format(a='q.qv', b='e.embedding')}, 0) AS semantic, 1 / (1 + exp(0.27465307216702745::DOUBLE * coalesce(s, 0))) AS keyword
  FROM q CROSS JOIN documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN k ON k.query_id = q.query_id AND k.doc_id = d.doc_id),
 h AS (SELECT *, semantic * 0.7::DOUBLE + least(keyword / 5, 1.0::DOUBLE) * 0.3::DOUBLE AS final FROM p)"""


@query(
    "hybrid_search",
    f"""{HYBRID} SELECT query_id, doc_id, rank, round(semantic, 4) AS semantic, round(keyword, 4) AS keyword, round(final, 4) AS final
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, doc_id)::INT AS rank FROM h) WHERE rank <= 10""",
)
def hybrid_search(spark, d):
    """Top 10 of all documents for each benchmark item (its whole text, and the vector of its number) by 0.7 of the cosine and 0.3 of the keyword score.

    A stated query set against all rows, in one pass over the documents; a document without a vector has no semantic
    score, one without a hit that of no hit.
    """
    e = embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.array_distinct(words(F.lower("text"))).alias("terms"))
    q = items.join(e.select(F.col("doc_id").alias("query_id"), F.col("v").alias("qv")), "query_id")
    rows = docs(spark, d, "doc_id", "text").join(e, "doc_id", "left").select("doc_id", words(F.lower("text")).alias("w"), "v")
    best = S.hybrid_best(q, rows, 10)
    return best.select("query_id", "doc_id", "rank", *[F.round(c, 4).alias(c) for c in ("semantic", "keyword", "final")])


@query(
    "bm25_corpus",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM documents), l AS (SELECT doc_id, count(*) AS len FROM t GROUP BY 1),
    n AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM t) / (SELECT count(*) FROM documents) AS mean), q AS (SELECT item_id AS query_id, unnest({ITEM_TERMS}) AS term FROM benchmark),
    p AS (SELECT term, doc_id, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT query_id, doc_id, sum(ln(1 + (n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))) AS score FROM p JOIN f USING (term) JOIN q USING (term) JOIN l USING (doc_id), n GROUP BY 1, 2)
    SELECT query_id, doc_id, round(score, 4) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id)::INT AS rank FROM s) WHERE rank <= 10""",
)
def bm25_corpus(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.array_distinct(words(F.lower("text"))).alias("terms"))
    s = bm25_best(items, docs(spark, d, "doc_id", words(F.lower("text")).alias("w")), 10)
    return s.select("query_id", "doc_id", F.round("score", 4).alias("score"), "rank")


@query(
    "search_quality",
    f"""WITH r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC, id) AS rank FROM ({PAIRS})) WHERE rank <= 10)
    SELECT query_id, count(*) AS n, round(avg(semantic), 4) AS mean_score, round(var_pop(semantic), 4) AS var_score, round(stddev_pop(semantic), 4) AS std_score, count(DISTINCT collection) AS collections FROM r GROUP BY 1""",
)
def search_quality(spark, d):
    rows = vectors(spark, d, S.collection_of(F.col("vec_id")).alias("collection"))
    return S.search_quality(S.nearest(asked(spark, d), rows, 10).withColumnRenamed("semantic", "score"))


@query("softmax_rank", f"""SELECT query_id, id, round(exp(semantic - max(semantic) OVER w) / sum(exp(semantic)) OVER w * exp(max(semantic) OVER w), 4) AS p FROM
 (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(semantic, 9) DESC, id) AS rank FROM ({PAIRS})) WHERE rank <= 10) WINDOW w AS (PARTITION BY query_id)""")
def softmax_rank(spark, d):
    rows = vectors(spark, d)
    best = S.nearest(asked(spark, d), rows, 10)
    return best.select("query_id", "id", F.round(V.softmax(F.col("semantic"), "query_id"), 4).alias("p"))


@query(
    "seq_cosine_distance",
    f"""WITH s AS (SELECT label, vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
    d AS (SELECT label, vec_id, 1 - {COS.format(a='a', b='b')} AS dist FROM s WHERE b IS NOT NULL),
    m AS (SELECT *, sum(dist) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth FROM d),
    x AS (SELECT *, median(smooth) OVER (PARTITION BY label) AS med FROM m), y AS (SELECT *, median(abs(smooth - med)) OVER (PARTITION BY label) AS mad FROM x)
    SELECT label, vec_id, round(dist, 4) AS dist, round(smooth, 4) AS smooth, round(CASE WHEN mad = 0 THEN 0 ELSE (smooth - med) * 0.6745::DOUBLE / mad END, 4) AS z FROM y""",
)
def seq_cosine_distance(spark, d):
    v = embeddings(spark, d).select("label", "vec_id", F.col("embedding").alias("v"))
    return boundary_scores(v, "label", "vec_id").select("label", "vec_id", *[F.round(c, 4).alias(c) for c in ("dist", "smooth", "z")])


@query("diversify")
def diversify(spark, d):
    rows = vectors(spark, d)
    best = S.nearest(asked(spark, d), rows, 20).join(rows, "id")
    page = best.select("query_id", "rank", "id", (F.col("id") / 10).cast("long").alias("doc_id"), (F.col("id") % 10).cast("int").alias("page"), "v")
    return S.diversified(page, 10)


@query("collection_stats", f"SELECT {COLLECTION.format(k='vec_id')} AS collection, count(*) AS n, count(embedding) AS with_vector FROM embeddings GROUP BY 1")
def collection_stats(spark, d):
    return embeddings(spark, d).groupBy(S.collection_of(F.col("vec_id")).alias("collection")).agg(F.count("*").alias("n"), F.count("embedding").alias("with_vector"))


@query(
    "explain_score",
    rf"""WITH q AS (SELECT item_id, {ITEM_TERMS} AS terms, text FROM benchmark), m AS (SELECT q.item_id, d.doc_id, count(DISTINCT term) AS hits FROM (SELECT item_id, unnest(terms) AS term FROM q) q
    JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM documents) d USING (term) GROUP BY 1, 2)
    SELECT item_id, count(*) AS docs, max(hits)::INT AS most_terms, round(max(hits / len(terms)), 2) AS best_share FROM m JOIN q USING (item_id) GROUP BY 1""",
)
def explain_score(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_distinct(words(F.lower("text"))).alias("terms"))
    terms = items.select("item_id", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    own = docs(spark, d, "doc_id", F.explode(F.array_distinct(words(F.lower("text")))).alias("term"))
    hits = own.join(terms, "term").groupBy("item_id", "doc_id").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    return hits.groupBy("item_id").agg(F.count("*").alias("docs"), F.max("hits").cast("int").alias("most_terms"), F.round(F.max(F.col("hits") / F.col("n")), 2).alias("best_share"))


@query("full_search")
def full_search(spark, d):
    """Every benchmark item as a query against all documents, with hashed vectors, routing by collection and reranking."""
    from functools import partial

    from ..operators.embedding import embedded, hashed_model, vector_of
    from .search_api import search

    model = partial(hashed_model, 64)

    items = spark.read.parquet(f"{d}/benchmark.parquet").withColumnRenamed("item_id", "query_id")
    q = items.select("query_id", "text", F.lit("general").alias("agent")).join(embedded(items, "query_id", "text", model).withColumnRenamed("vector", "qv"), "query_id")
    own = docs(spark, d, F.col("doc_id").alias("id"), "doc_id", F.lit(0).alias("page"), S.collection_of(F.col("doc_id")).alias("collection"), F.col("text").alias("content"))
    index = own.withColumn("v", vector_of(F.col("content"), model))
    return search(q, index, 8).select("query_id", "place", "id", "collection", "matched_terms", "match_share", "doc_words")
