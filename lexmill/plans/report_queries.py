"""Reports over runs, files, answers and collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import words
from ..operators import dedup as U
from ..operators import search as S
from ..operators.keywords import most_terms
from .registry import query
from .search_queries import COLLECTION, ITEM_TERMS, embeddings
from .text_queries import STRIP, WORDS, docs


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


@query(
    "run_totals",
    rf"""SELECT coalesce(source, 'all') AS source, count(*) AS pages, count(*) FILTER (WHERE len(t) >= 100) AS valid, sum(words)::BIGINT AS words,
    coalesce(sum(len(t)) FILTER (WHERE len(t) >= 100), 0)::BIGINT AS valid_chars FROM (SELECT source, {STRIP.format("coalesce(text, '')")} AS t, coalesce({WORDS}, 0) AS words FROM documents) GROUP BY ROLLUP (source)""",
)
def run_totals(spark, d):
    """Pages, valid pages (100 characters), words and valid characters of each source and of all."""
    text = F.coalesce("text", F.lit(""))
    p = docs(spark, d, "source", F.length(T.stripped(text)).alias("n"), T.word_count(text).alias("words"))
    valid = F.col("n") >= 100
    out = p.rollup("source").agg(
        F.count("*").alias("pages"), F.count_if(valid).alias("valid"), F.sum("words").cast("long").alias("words"), F.coalesce(F.sum(F.when(valid, F.col("n"))), F.lit(0)).cast("long").alias("valid_chars")
    )
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


@query(
    "grand_totals",
    f"""WITH s AS (SELECT source, count(*) AS pages, count(*) FILTER (WHERE {WORDS} >= 200) AS ok, count(*) FILTER (WHERE {WORDS} < 50) AS fail FROM documents GROUP BY 1)
    SELECT count(*) AS files, sum(pages)::BIGINT AS pages, sum(ok)::BIGINT AS ok, sum(fail)::BIGINT AS fail, count(*) FILTER (WHERE fail * 5 <= pages) AS good_files, round(sum(ok) * 100.0::DOUBLE / sum(pages), 4) AS percent FROM s""",
)
def grand_totals(spark, d):
    """Totals over all files, and the share of pages that are fine."""
    n = T.word_count(F.col("text"))
    s = docs(spark, d, "source", n.alias("n")).groupBy("source").agg(F.count("*").alias("pages"), F.count_if(F.col("n") >= 200).alias("ok"), F.count_if(F.col("n") < 50).alias("fail"))
    return s.agg(
        F.count("*").alias("files"), F.sum("pages").alias("pages"), F.sum("ok").alias("ok"), F.sum("fail").alias("fail"), F.count_if(F.col("fail") * 5 <= F.col("pages")).alias("good_files"),
        F.round(F.try_divide(F.sum("ok") * 100.0, F.sum("pages")), 4).alias("percent"),
    )


@query("timing_summary", "SELECT event_type, count(*) AS answers, round(avg(value), 4) AS mean_seconds, round(sum(value), 2) AS total_seconds, count(*) FILTER (WHERE value > 100) AS slow FROM events GROUP BY 1")
def timing_summary(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.count("*").alias("answers"), F.round(F.avg("value"), 4).alias("mean_seconds"), F.round(F.sum("value"), 2).alias("total_seconds"), F.count_if(F.col("value") > 100).alias("slow"))


@query(
    "metric_summary",
    rf"""SELECT metric, round(avg(v), 4) AS mean, min(v)::DOUBLE AS least, max(v)::DOUBLE AS most FROM (SELECT 'words' AS metric, {WORDS} AS v FROM conversations UNION ALL SELECT 'chars', len(text) FROM conversations
    UNION ALL SELECT 'sentences', len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S'))) FROM conversations) GROUP BY 1""",
)
def metric_summary(spark, d):
    """Mean, least and most of every metric, one row each."""
    t = F.col("text")
    wide = turns(spark, d).select(T.word_count(t).cast("double").alias("words"), F.length(t).cast("double").alias("chars"), T.sentence_count(t).cast("double").alias("sentences"))
    return wide.unpivot([], ["words", "chars", "sentences"], "metric", "v").groupBy("metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.min("v").alias("least"), F.max("v").alias("most"))


@query(
    "results_by_collection",
    f"""SELECT collection, n, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS first_ids FROM (SELECT collection, doc_id, row_number() OVER w AS rank, count(*) OVER (PARTITION BY collection) AS n
    FROM (SELECT doc_id, n_chars, {COLLECTION.format(k='doc_id')} AS collection FROM documents) WINDOW w AS (PARTITION BY collection ORDER BY n_chars DESC, doc_id)) WHERE rank <= 5 GROUP BY 1, 2""",
)
def results_by_collection(spark, d):
    """Per collection how many results, and the first five."""
    rows = docs(spark, d, "doc_id", "n_chars", S.collection_of(F.col("doc_id")).alias("collection"))
    n = rows.groupBy("collection").agg(F.count("*").alias("n"))
    w = Window.partitionBy("collection").orderBy(F.desc("n_chars"), "doc_id")
    first = rows.withColumn("rank", F.row_number().over(w)).where("rank <= 5").groupBy("collection").agg(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))).alias("r"))
    return n.join(first, "collection").select("collection", "n", F.array_join(F.transform("r", lambda x: x["doc_id"].cast("string")), ",").alias("first_ids"))


LINKS = "regexp_extract_all(coalesce(html, ''), 'href=\"([^\"]*)\"', 1)"


@query("nested_counts", f"SELECT count(*) AS items, sum(len({LINKS}))::BIGINT AS links, sum(len(list_filter({LINKS}, lambda x: starts_with(x, 'http'))))::BIGINT AS outer_links, count(*) FILTER (WHERE len({LINKS}) > 0) AS with_links FROM pages")
def nested_counts(spark, d):
    """Counts over nested arrays, without exploding them."""
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), 1).alias("l"))
    return p.agg(F.count("*").alias("items"), F.sum(F.size("l")).alias("links"), F.sum(F.size(F.filter("l", lambda x: x.startswith("http")))).alias("outer_links"), F.count_if(F.size("l") > 0).alias("with_links"))


@query("page_concat", "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS pages FROM conversations GROUP BY 1")
def page_concat(spark, d):
    """Pages joined to documents in their order."""
    c = turns(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")).alias("digest"), F.size("p").cast("long").alias("pages"))


@query("line_counts", r"SELECT source, count(*) AS files, sum(len(string_split(text, chr(10))))::BIGINT AS lines, sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))))::BIGINT AS full_lines FROM documents GROUP BY 1")
def line_counts(spark, d):
    t = docs(spark, d, "source", T.lines(F.col("text")).alias("l"))
    return t.groupBy("source").agg(F.count("*").alias("files"), F.sum(F.size("l")).alias("lines"), F.sum(F.size(F.filter("l", lambda x: x.rlike(r"\S")))).alias("full_lines"))


@query(
    "collection_checks",
    rf"""SELECT {COLLECTION.format(k='doc_id')} AS collection, count(*) AS n, count(doc_id) AS with_id, count(*) FILTER (WHERE regexp_matches(text, '\S')) AS with_text, count(*) FILTER (WHERE source <> '') AS with_title,
    count(embedding) AS with_vector, bool_and(coalesce(regexp_matches(text, '\S'), FALSE) AND embedding IS NOT NULL) AS complete FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1""",
)
def collection_checks(spark, d):
    """Per collection how many objects have an id, a text, a title and a vector, and whether all have all."""
    rows = docs(spark, d, "doc_id", "text", "source").join(embeddings(spark, d).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    full = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return rows.groupBy(S.collection_of(F.col("doc_id")).alias("collection")).agg(
        F.count("*").alias("n"), F.count("doc_id").alias("with_id"), F.count_if(full).alias("with_text"), F.count_if(F.col("source") != "").alias("with_title"), F.count("embedding").alias("with_vector"),
        F.bool_and(full & F.col("embedding").isNotNull()).alias("complete"),
    )


@query(
    "response_filters",
    "SELECT role, count(*) AS n, count(*) FILTER (WHERE contains(upper(text), 'ERROR')) AS errors, count(*) FILTER (WHERE NOT contains(upper(text), 'ERROR')) AS answers FROM conversations WHERE role = 'assistant' GROUP BY 1",
)
def response_filters(spark, d):
    """Rows of one model, those with an error and the others apart."""
    bad = F.contains(F.upper("text"), F.lit("ERROR"))
    return turns(spark, d).where(F.col("role") == "assistant").groupBy("role").agg(F.count("*").alias("n"), F.count_if(bad).alias("errors"), F.count_if(~bad).alias("answers"))


@query(
    "suggestions",
    rf"""WITH q AS (SELECT item_id, {ITEM_TERMS} AS terms FROM benchmark), t AS (SELECT doc_id, w, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents)),
    h AS (SELECT q.item_id, t.doc_id, count(DISTINCT t.term) AS hits FROM (SELECT item_id, unnest(terms) AS term FROM q) q JOIN t USING (term) GROUP BY 1, 2),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, doc_id)::INT AS rank FROM h) WHERE rank <= 5),
    c AS (SELECT item_id, term, count(*) AS n, min(rank * 1000000 + pos) AS first FROM r JOIN t USING (doc_id) JOIN q USING (item_id) WHERE len(term) > 3 AND NOT list_contains(terms, term) GROUP BY 1, 2)
    SELECT item_id, place, term, n FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, first)::INT AS place FROM c) WHERE place <= 5""",
)
def suggestions(spark, d):
    """Each query's commonest other words of four letters or more in its five best results; of equals the one that comes first."""
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.array_distinct(words(F.lower("text"))).alias("terms"))
    w = docs(spark, d, "doc_id", words(F.lower("text")).alias("w"))
    results = most_terms(items.withColumnRenamed("item_id", "query_id"), w, 5).withColumnRenamed("query_id", "item_id").join(items, "item_id")
    at = results.select("item_id", "rank", "terms", F.posexplode("w").alias("pos", "term")).where((F.length("term") > 3) & ~F.array_contains("terms", F.col("term")))
    counts = at.groupBy("item_id", "term").agg(F.count("*").alias("n"), F.min(F.struct("rank", "pos")).alias("first"))
    order = Window.partitionBy("item_id").orderBy(F.desc("n"), "first")
    return counts.withColumn("place", F.row_number().over(order)).where("place <= 5").select("item_id", "place", "term", "n")


@query(
    "object_ids",
    f"""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || doc_id || ':0:' || {COLLECTION.format(k='doc_id')})) AS h FROM documents)
    SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""",
)
def object_ids(spark, d):
    """Stable object ids of document, chunk and collection together, so that no two objects collide."""
    return docs(spark, d, "doc_id").select("doc_id", U.deterministic_uuid(F.lit("chunk"), F.col("doc_id"), F.lit(0), S.collection_of(F.col("doc_id"))).alias("uuid"))
