"""Queries on layout, chunks, duplicates, training sets and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog as C
from ..operators import chunking as K
from ..operators import dataset as D
from ..operators import dedup as U
from ..operators import layout as L
from ..operators import metrics as M
from ..operators import refine as N
from ..operators import search as S
from .registry import query
from .text_queries import BULLETS, FULL, STRIP, TOKENS, WORDS, docs  # noqa: F401

EDGES = f"""SELECT source, edge, line, n FROM (SELECT source, edge, line, count(*) AS n FROM (SELECT source, 'first' AS edge, f[1] AS line FROM (SELECT source, {FULL} AS f FROM documents) WHERE len(f) > 0
 UNION ALL SELECT source, 'last', f[-1] FROM (SELECT source, {FULL} AS f FROM documents) WHERE len(f) > 0) WHERE len(line) <= 80 GROUP BY ALL) JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY 1) USING (source) WHERE n > pages * 0.02"""


@query("repeated_header_footer", EDGES)
def repeated_header_footer(spark, d):
    return L.repeated_edges(docs(spark, d, "source", "text"), "source", share=0.02)


@query(
    "strip_header_footer",
    f"""WITH e AS ({EDGES}), p AS (SELECT doc_id, source, {FULL} AS f FROM documents)
    SELECT doc_id, md5(array_to_string(list_slice(f, 1 + (a.line IS NOT NULL)::INT, len(f) - (b.line IS NOT NULL)::INT), chr(10))) AS digest FROM p
    LEFT JOIN e a ON a.source = p.source AND a.edge = 'first' AND a.line = f[1] LEFT JOIN e b ON b.source = p.source AND b.edge = 'last' AND b.line = f[-1]""",
)
def strip_header_footer(spark, d):
    pages = docs(spark, d, "doc_id", "source", "text")
    return L.without_edges(pages, "source", L.repeated_edges(pages, "source", share=0.02)).select("doc_id", F.md5("text").alias("digest"))


LEVEL = r"""CASE WHEN regexp_matches(s, '^\d+\.\s') THEN 1 WHEN regexp_matches(s, '^\d+\.\d+\s') THEN 2 WHEN regexp_matches(s, '^\d+\.\d+\.\d+\s') THEN 3
 WHEN len(s) < 50 AND upper(s) = s AND lower(s) <> s THEN 1 ELSE 2 END"""
BLOCKS = rf"""SELECT doc_id, pos - 1 AS block_idx, text, {TOKENS} AS tokens, len(text) <= 60 AND {WORDS} <= 8 AS is_heading, {STRIP.format('text')} AS s
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(text, '\S')"""


@query(
    "section_path",
    f"""SELECT doc_id, count(*) AS blocks, count(title) AS titled, count(DISTINCT title) AS sections, max(level)::INT AS deepest FROM (SELECT doc_id,
    last_value(CASE WHEN is_heading THEN text END IGNORE NULLS) OVER w AS title, last_value(CASE WHEN is_heading THEN {LEVEL} END IGNORE NULLS) OVER w AS level
    FROM ({BLOCKS}) WINDOW w AS (PARTITION BY doc_id ORDER BY block_idx ROWS UNBOUNDED PRECEDING)) GROUP BY 1""",
)
def section_path(spark, d):
    s = L.with_sections(L.blocks_of(docs(spark, d, "doc_id", "text")))
    return s.groupBy("doc_id").agg(
        F.count("*").alias("blocks"), F.count("section_title").alias("titled"), F.count_distinct("section_title").alias("sections"), F.max("section_level").alias("deepest")
    )


def typed_blocks(spark, d):
    """Blocks with their sections and categories."""
    b = L.with_sections(L.blocks_of(docs(spark, d, "doc_id", "text")))
    f = T.content_flags(F.col("text"))
    return b.withColumn("category", N.enriched(F.col("is_heading"), f["in_table"], f["in_code"])["category"])


def chunks_of(spark, d):
    return K.pack_by_structure(typed_blocks(spark, d))


@query("chunk_pack")
def chunk_pack(spark, d):
    return chunks_of(spark, d).select("doc_id", "chunk_id", F.md5("content").alias("digest"), "chunk_tokens", "is_heading_block", "block_cohesion", "source_blocks")


@query("chunk_totals", f"SELECT doc_id, count(*) AS blocks, sum({'tokens'})::BIGINT AS tokens FROM ({BLOCKS}) GROUP BY 1")
def chunk_totals(spark, d):
    """Packing loses nothing: the chunks' blocks and tokens are those of the document."""
    return chunks_of(spark, d).groupBy("doc_id").agg(F.sum("source_blocks").alias("blocks"), F.sum("chunk_tokens").alias("tokens"))


@query(
    "chunk_pack_split",
    f"SELECT doc_id, sum({WORDS})::BIGINT AS words, count(*) FILTER (WHERE {TOKENS} <= 256) AS small_blocks FROM ({BLOCKS}) GROUP BY 1",
)
def chunk_pack_split(spark, d):
    """Packing after oversize blocks were split: no word is lost, and blocks that were not over the limit stay whole."""
    pieces = N.split_oversize(typed_blocks(spark, d))
    words = K.pack_by_structure(pieces).groupBy("doc_id").agg(F.sum(T.word_count(F.col("content"))).alias("words"))
    return words.join(pieces.groupBy("doc_id").agg(F.count_if(~F.col("is_split")).alias("small_blocks")), "doc_id")


@query("chunk_overlap")
def chunk_overlap(spark, d):
    return K.with_overlap(chunks_of(spark, d)).select("doc_id", "chunk_id", F.md5("content").alias("digest"), "chunk_tokens", "overlap_applied")


@query("chunk_stats")
def chunk_stats(spark, d):
    return K.chunk_statistics(chunks_of(spark, d))


@query("token_windows")
def token_windows(spark, d):
    return K.token_windows(docs(spark, d, "doc_id", "text"))


@query(
    "exact_dups",
    "SELECT doc_id, canonical, copies FROM documents JOIN (SELECT text, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1) USING (text)",
)
def exact_dups(spark, d):
    return U.exact_duplicates(docs(spark, d, "doc_id", "text"))


FIRST = "(SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)"


def _sets(n, table="documents", key="doc_id"):
    return rf"""SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS h FROM (SELECT {key}, w, unnest(range(1, len(w) - {n - 2})) AS i FROM (SELECT {key}, regexp_extract_all(lower(text), '\S+') AS w FROM {table}))"""


@query(
    "near_dups",
    f"""WITH s AS ({_sets(3, FIRST)}), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1), o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2)
    SELECT a, b, round(o / (p.n + q.n - o), 4) AS jaccard FROM o JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE o / (p.n + q.n - o) >= 0.9""",
)
def near_dups(spark, d):
    return U.near_duplicates(docs(spark, d, "doc_id", "text"))


@query("benchmark_overlap", f"WITH s AS ({_sets(8)}), b AS ({_sets(8, 'benchmark', 'item_id')}) SELECT doc_id, item_id, count(*) AS shared FROM s JOIN b USING (h) GROUP BY 1, 2")
def benchmark_overlap(spark, d):
    return U.benchmark_overlap(docs(spark, d, "doc_id", "text"), spark.read.parquet(f"{d}/benchmark.parquet"))


@query("suggest_terms", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS word FROM documents) WHERE len(word) > 3 GROUP BY 1 ORDER BY n DESC, word LIMIT 20")
def suggest_terms(spark, d):
    return U.term_counts(docs(spark, d, "text"), 20)


STOPS = T.ENGLISH + T.SPANISH
_IN = ", ".join(f"'{w}'" for w in STOPS)
QA = rf"""WITH c AS (SELECT doc_id, text, {STRIP.format("coalesce(text, '')")} AS t FROM documents), w AS (SELECT *, regexp_extract_all(lower(t), '\S+') AS w FROM c),
 f AS (SELECT doc_id, text, array_to_string(list_filter([CASE WHEN len(w) = 0 THEN 'empty' END, CASE WHEN len(w) < 400 THEN 'too_short' END, CASE WHEN len(w) > 1200 THEN 'too_long' END,
 CASE WHEN t <> '' AND NOT regexp_matches(t, '^[\p{{Lu}}0-9]') THEN 'start_mid_sentence' END, CASE WHEN t <> '' AND NOT regexp_matches(t, '[.!?…:;][''")\]]?$') THEN 'end_mid_sentence' END,
 CASE WHEN coalesce(len(list_filter(w, lambda x: x IN ({_IN}))) / nullif(len(w), 0), 1) > 0.88 AND len(w) >= 12 THEN 'mostly_stopwords' END,
 CASE WHEN coalesce(len(regexp_extract_all(t, '\pL')) / nullif(len(t), 0), 0) < 0.45 AND len(t) >= 40 THEN 'low_alpha_ratio' END], lambda x: x IS NOT NULL), ',') AS flags FROM w)
 SELECT f.doc_id, flags, CASE WHEN contains(flags, 'empty') OR f.doc_id > first THEN 'FAIL' WHEN flags <> '' THEN 'WARN' ELSE 'OK' END AS status FROM f JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY 1) USING (text)"""


@query("chunk_qa_status", QA)
def chunk_qa_status(spark, d):
    t = docs(spark, d, "doc_id", "text")
    dup = U.exact_duplicates(t).where("doc_id <> canonical").select("doc_id", F.lit(True).alias("dup"))
    flags = M.chunk_flags(F.col("text"), STOPS)
    q = t.join(dup, "doc_id", "left").select("doc_id", flags.alias("f"), F.coalesce("dup", F.lit(False)).alias("dup"))
    return q.select("doc_id", F.array_join("f", ",").alias("flags"), M.chunk_status(F.col("f"), F.col("dup")).alias("status"))


KEPT = r"CASE WHEN len(w) >= 50 THEN array_to_string(list_slice(w, 1, 2000), ' ') END"
SPLIT = "CASE WHEN ('0x' || substr(md5(doc_id::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296 < 0.1 THEN 'validation' ELSE 'train' END"


@query(
    "ft_dataset",
    rf"""SELECT doc_id, source, least(len(w), 2000)::INT AS word_count, {SPLIT} AS split, md5('Source: ' || source || chr(10) || chr(10) || {KEPT}) AS digest
    FROM (SELECT doc_id, source, regexp_extract_all(text, '\S+') AS w FROM documents) WHERE len(w) >= 50""",
)
def ft_dataset(spark, d):
    return D.fine_tuning_rows(docs(spark, d, "doc_id", "source", "text")).select("doc_id", "source", "word_count", "split", F.md5("text").alias("digest"))


@query(
    "ft_split_stats",
    r"""SELECT source, count(*) AS loaded, count(*) FILTER (WHERE n >= 50) AS kept, count(*) FILTER (WHERE n < 50) AS dropped, round(avg(least(n, 2000)) FILTER (WHERE n >= 50), 4) AS mean_words,
    (min(least(n, 2000)) FILTER (WHERE n >= 50))::INT AS min_words, coalesce(max(least(n, 2000)) FILTER (WHERE n >= 50), 0)::INT AS max_words FROM (SELECT source, len(regexp_extract_all(text, '\S+')) AS n FROM documents) GROUP BY 1""",
)
def ft_split_stats(spark, d):
    return D.split_statistics(docs(spark, d, "source", "text"))


def turns(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet")


@query(
    "qa_pairs",
    "SELECT u.conv_id, u.turn, md5(u.text) AS question, md5(a.text) AS answer FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND u.text <> '' AND a.text <> ''",
)
def qa_pairs(spark, d):
    return D.question_rows(turns(spark, d)).select("conv_id", "turn", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("response_clean", r"""SELECT conv_id, turn, md5(trim(regexp_replace(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(text, '<\|[a-z_]+\|>|\[/?INST\]|</?s>', '', 'g'), '(?i)^\s*(answer|response|assistant)\s*:\s*', '', 'g'), chr(10)),
 lambda s: NOT regexp_matches(s, '(?i)(you are an? |instructions?:|### |as an ai|system prompt|question:|context:)')), chr(10)), '\s+', ' ', 'g'))) AS digest FROM conversations""")
def response_clean(spark, d):
    return turns(spark, d).select("conv_id", "turn", F.md5(T.response_cleaned(F.col("text"))).alias("digest"))


@query(
    "response_lengths",
    r"""SELECT role, count(*) AS n, min(len(text))::INT AS least, max(len(text))::INT AS most, median(len(text)) AS median, round(stddev_samp(len(text)), 4) AS std, round(avg(len(regexp_extract_all(text, '\S+'))), 4) AS mean_words FROM conversations GROUP BY 1""",
)
def response_lengths(spark, d):
    n = F.length("text")
    return turns(spark, d).groupBy("role").agg(
        F.count("*").alias("n"), F.min(n).alias("least"), F.max(n).alias("most"), F.median(n).alias("median"), F.round(F.stddev_samp(n), 4).alias("std"), F.round(F.avg(T.word_count(F.col("text"))), 4).alias("mean_words")
    )


SYL = "greatest(1, len(regexp_extract_all(lower({x}), '[aeiouyáéíóúäöüèêàâîôû]+')))"


@query(
    "readability",
    rf"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_extract_all(text, '\S+'), lambda x: regexp_matches(x, '\pL')) AS w, greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S')))) AS s FROM conversations),
    n AS (SELECT conv_id, turn, len(w) AS n, s, coalesce(list_sum(list_transform(w, lambda x: {SYL.format(x='x')})), 0)::DOUBLE AS syl, len(list_filter(w, lambda x: {SYL.format(x='x')} >= 3)) AS hard FROM w)
    SELECT conv_id, turn, round(CASE WHEN n > 0 THEN n / s * 0.39::DOUBLE + syl / n * 11.8::DOUBLE - 15.59::DOUBLE ELSE 0 END, 4) AS grade, round(CASE WHEN n > 0 THEN (n / s + hard / n * 100) * 0.4::DOUBLE ELSE 0 END, 4) AS fog FROM n""",
)
def readability(spark, d):
    r = M.readability(F.col("text"))
    return turns(spark, d).select("conv_id", "turn", F.round(r["grade"], 4).alias("grade"), F.round(r["fog"], 4).alias("fog"))


@query("answer_metrics")
def answer_metrics(spark, d):
    q = D.question_rows(turns(spark, d)).select("conv_id", "turn", F.col("question").alias("reference"), "answer")
    return M.answer_metrics(q, ["conv_id", "turn"]).select("conv_id", "turn", F.round("bleu", 6).alias("bleu"), F.round("rouge_l", 6).alias("rouge_l"))


@query("chunk_ids")
def chunk_ids(spark, d):
    """Stable object ids: document, chunk and collection together, so that no two objects collide."""
    parts = (F.lit("chunk"), F.col("doc_id"), F.col("chunk_id"), S.collection_of(F.col("doc_id")))
    return chunks_of(spark, d).select("doc_id", "chunk_id", U.deterministic_uuid(*parts).alias("uuid"))


@query(
    "index_completeness",
    """WITH a AS (SELECT source, count(*) AS available, 'C' || (substr(source, 4)::INT % 5) AS collection FROM documents GROUP BY 1), i AS (SELECT 'C' || (label % 5) AS collection, count(*) AS n FROM embeddings GROUP BY 1)
    SELECT source, collection, available, coalesce(n, 0) AS indexed, round(least(100.0::DOUBLE, coalesce(n, 0) * 100.0::DOUBLE / available), 4) AS percent,
    CASE WHEN coalesce(n, 0) = 0 THEN 'missing' WHEN n < available * 0.9 THEN 'partial' ELSE 'complete' END AS status FROM a LEFT JOIN i USING (collection)""",
)
def index_completeness(spark, d):
    a = docs(spark, d, "source").groupBy("source").agg(F.count("*").alias("n"))
    i = spark.read.parquet(f"{d}/embeddings.parquet").groupBy(F.concat(F.lit("C"), F.col("label") % 5).alias("collection")).agg(F.count("*").alias("n"))
    m = a.select("source", F.concat(F.lit("C"), F.substring("source", 4, 9).cast("int") % 5).alias("collection"))
    return C.completeness(a, i, m)


@query(
    "validation_report",
    """SELECT coalesce(lang, 'all') AS lang, count(*) FILTER (WHERE n >= 200) AS ok, count(*) FILTER (WHERE n >= 50 AND n < 200) AS warn, count(*) FILTER (WHERE n < 50) AS fail, round(avg((n > 0)::INT), 4) AS coverage
    FROM (SELECT lang, len(regexp_extract_all(text, '\\S+')) AS n FROM documents) GROUP BY ROLLUP (lang)""",
)
def validation_report(spark, d):
    n = docs(spark, d, "lang", T.word_count(F.col("text")).alias("n"))
    return (
        n.rollup("lang")
        .agg(F.count_if(F.col("n") >= 200).alias("ok"), F.count_if(F.col("n").between(50, 199)).alias("warn"), F.count_if(F.col("n") < 50).alias("fail"), F.round(F.avg((F.col("n") > 0).cast("int")), 4).alias("coverage"))
        .withColumn("lang", F.coalesce("lang", F.lit("all")))
    )
