"""Queries on texts, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import DataFrame

from ..functions import text as T
from ..session import spread
from .registry import query


def docs(spark, d, *cols) -> DataFrame:
    df = spark.read.parquet(f"{d}/documents.parquet")
    if cols and all(isinstance(c, str) for c in cols):
        df = df.select(*cols)
        return spread(df) if "text" in cols else df
    return spread(df).select(*cols) if cols else spread(df)


WORDS = r"len(regexp_extract_all(text, '\S+'))"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
COLLAPSE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"
PLAIN = "replace(replace(replace(text, chr(173), ''), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
NORM = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
 '\r', '', 'g'), '([\pL\pN_])-\n([\pL\pN_])', '\1\2', 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '([^\n])\n([^\n])', '\1 \2', 'g'),
 '[ \t]+', ' ', 'g'), '[\x00-\x08\x0B-\x0C\x0E-\x1F\x7F]', '', 'g'), '^\s+|\s+$', '', 'g')"""
TOKENS = f"CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, trunc(({WORDS} * 1.3::DOUBLE + len(text) / 4) / 2)::INT) END"


@query("text_normalize", f"SELECT doc_id, md5({NORM}) AS digest, len({NORM}) AS n_chars FROM documents")
def text_normalize(spark, d):
    t = T.normalised(F.col("text"))
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(t).alias("digest"), F.length(t).cast("long").alias("n_chars"))


@query("text_plain", f"SELECT doc_id, md5({COLLAPSE.format(PLAIN)}) AS digest FROM documents")
def text_plain(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(T.plain(F.col("text"))).alias("digest"))


@query(
    "token_estimate",
    f"""SELECT doc_id, {TOKENS} AS tokens, CASE WHEN len(text) = 0 THEN 0 ELSE greatest(1, trunc(CASE WHEN len(text) < 8 * {WORDS}
    THEN {WORDS} * 1.3::DOUBLE * 0.7::DOUBLE + len(text) / 3.5::DOUBLE * 0.3::DOUBLE ELSE {WORDS} * 1.3::DOUBLE * 0.4::DOUBLE + len(text) / 3.5::DOUBLE * 0.6::DOUBLE END)::INT) END AS tokens_weighted FROM documents""",
)
def token_estimate(spark, d):
    t = F.col("text")
    return docs(spark, d, "doc_id", "text").select("doc_id", T.token_estimate(t).alias("tokens"), T.token_estimate_weighted(t).alias("tokens_weighted"))


@query(
    "text_stats",
    rf"""WITH s AS (SELECT doc_id, len(text) AS chars, {WORDS} AS words, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: regexp_matches(x, '\S'))) AS sentences,
    len(list_filter(string_split(text, chr(10)||chr(10)), lambda x: regexp_matches(x, '\S'))) AS paragraphs,
    len(string_split(text, chr(10))) AS lines, list_max(list_transform(string_split(text, chr(10)), lambda x: len(x))) AS longest_line FROM documents)
    SELECT *, round(coalesce(words / nullif(sentences, 0), 0), 4) AS words_per_sentence, round(coalesce(words / (nullif(chars, 0) / 1000), 0), 4) AS density FROM s""",
)
def text_stats(spark, d):
    t = F.col("text")
    s = docs(spark, d, "doc_id", "text").select(
        "doc_id",
        F.length(t).cast("long").alias("chars"),
        T.word_count(t).cast("long").alias("words"),
        T.sentence_count(t).cast("long").alias("sentences"),
        T.paragraph_count(t).cast("long").alias("paragraphs"),
        F.size(T.lines(t)).cast("long").alias("lines"),
        F.array_max(F.transform(T.lines(t), lambda x: F.length(x))).cast("long").alias("longest_line"),
    )
    return s.select(
        "*",
        F.round(F.coalesce(F.try_divide("words", "sentences"), F.lit(0.0)), 4).alias("words_per_sentence"),
        F.round(F.coalesce(F.try_divide(F.col("words") * 1.0, F.col("chars") / 1000), F.lit(0.0)), 4).alias("density"),
    )


FLAGS = rf"""SELECT *, {STRIP.format("coalesce(text, '')")} AS t FROM documents"""
FLAGS_SQL = rf"""SELECT doc_id, lang, source, array_to_string(list_filter([CASE WHEN t = '' THEN 'empty' END, CASE WHEN t <> '' AND len(t) < 40 THEN 'short_text' END,
 CASE WHEN len(regexp_extract_all(t, '[^\pL\pN_\s]')) / nullif(len(t), 0) > 0.2 THEN 'high_special_chars' END], lambda x: x IS NOT NULL), ',') AS flags FROM ({FLAGS})"""


@query("quality_flags", f"SELECT doc_id, flags FROM ({FLAGS_SQL})")
def quality_flags(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.array_join(T.quality_flags(F.col("text")), ",").alias("flags"))


@query(
    "quality_by_language",
    f"""SELECT a.lang, count(*) AS docs, sum(CASE WHEN flags <> '' THEN 1 ELSE 0 END)::BIGINT AS flagged, sum({TOKENS})::BIGINT AS tokens,
    round(avg({WORDS}), 4) AS mean_words FROM documents a JOIN ({FLAGS_SQL}) f USING (doc_id) GROUP BY a.lang""",
)
def quality_by_language(spark, d):
    t = F.col("text")
    return (
        docs(spark, d, "lang", "text")
        .groupBy("lang")
        .agg(
            F.count("*").alias("docs"),
            F.count_if(F.size(T.quality_flags(t)) > 0).alias("flagged"),
            F.sum(T.token_estimate(t)).alias("tokens"),
            F.round(F.avg(T.word_count(t)), 4).alias("mean_words"),
        )
    )


def _list(x):
    return "[" + ", ".join(f"'{w}'" for w in x) + "]"


LOW = r"regexp_extract_all(lower(text), '\S+')"
GUESS = f"""CASE WHEN len({LOW}) > 10 THEN CASE WHEN len(list_intersect({_list(T.SPANISH)}, {LOW})) > len(list_intersect({_list(T.ENGLISH)}, {LOW})) THEN 'spanish' ELSE 'english' END END"""


@query("language_guess", f"SELECT doc_id, {GUESS} AS guess FROM documents")
def language_guess(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.language_guess(F.col("text")).alias("guess"))


@query("lang_confusion", f"SELECT lang, coalesce({GUESS}, 'unknown') AS guess, count(*) AS n FROM documents GROUP BY ALL")
def lang_confusion(spark, d):
    guess = F.coalesce(T.language_guess(F.col("text")), F.lit("unknown"))
    return docs(spark, d, "lang", "text").groupBy("lang", guess.alias("guess")).agg(F.count("*").alias("n"))


IDS = r"""list_slice(list_sort(list_distinct(list_concat(list_concat(list_transform(regexp_extract_all(text, '(?i)cve-\d{4}-\d{4,}'), lambda x: upper(x)),
 list_transform(regexp_extract_all(text, '(?i)\b[tgms]\d{4}(?:\.\d{3})?\b'), lambda x: upper(x))), list_slice(regexp_extract_all(text, '\b(?:[a-fA-F0-9]{64}|[a-fA-F0-9]{40}|[a-fA-F0-9]{32})\b'), 1, 10)))), 1, 10)"""


@query("identifiers", f"SELECT doc_id, array_to_string({IDS}, ',') AS ids FROM documents")
def identifiers(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.array_join(T.identifiers(F.col("text")), ",").alias("ids"))


def _score(patterns):
    return "(" + " + ".join(f"regexp_matches(lower(text), '{p}')::INT" for p in patterns) + ")"


_SCORES = [_score(p) for p in T.DOCUMENT_TYPES.values()]
TYPE = "CASE " + " ".join(f"WHEN greatest({', '.join(_SCORES)}) > 0 AND {s} = greatest({', '.join(_SCORES)}) THEN '{k}'" for k, s in zip(T.DOCUMENT_TYPES, _SCORES, strict=True)) + " ELSE 'general_text' END"


@query("doc_type", f"SELECT doc_id, {TYPE} AS kind FROM documents")
def doc_type(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.document_type(F.col("text")).alias("kind"))


BULLETS, NUMBERS = r"regexp_matches(text, '(?m)^\s*[*\-+•]\s+')", r"regexp_matches(text, '(?m)^\s*\d+\.\s+')"
CODE, URLS = r"regexp_matches(text, '(?m)```|`[^`]+`|^\s{4,}\w')", r"regexp_matches(text, 'https?://|www\.')"
EMAIL = r"regexp_matches(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b')"


@query(
    "content_flags",
    rf"""SELECT doc_id, {BULLETS} AS bullets, {NUMBERS} AS numbered, {CODE} AS code, {URLS} AS urls, {EMAIL} AS email,
    len(t) < 100 AND ((upper(text) = text AND lower(text) <> text) OR len(list_filter([{', '.join(map(repr, T.HEADING_STARTS))}], lambda s: starts_with(t, s))) > 0) AS is_heading,
    contains(text, '│') OR (contains(text, chr(9)) AND len(text) - len(replace(text, '|', '')) > 2) AS in_table, regexp_matches(text, '^\s*[-•*]\s') OR regexp_matches(text, '(?m)^\s*\d+\.\s') AS in_list,
    contains(text, '```') OR regexp_matches(text, '(?m)^\s*(def|class|import|from)\s') OR regexp_matches(text, '[{{}}();].*[{{}}();]') AS in_code,
    contains(lower(text), 'fig') AND (contains(lower(text), 'caption') OR contains(lower(text), 'figure')) AS is_figure,
    starts_with({STRIP.format('text')}, '"') AND ends_with({STRIP.format('text')}, '"') AS is_quote,
    regexp_matches(text, '\[\d+\]|\(\d{{4}}\)|\bet al\.') AS is_reference FROM (SELECT *, {STRIP.format('text')} AS t FROM documents)""",
)
def content_flags(spark, d):
    t = F.col("text")
    return docs(spark, d, "doc_id", "text").select(
        "doc_id",
        T.has_bullets(t).alias("bullets"),
        T.has_numbers(t).alias("numbered"),
        T.has_code(t).alias("code"),
        T.has_urls(t).alias("urls"),
        T.has_email(t).alias("email"),
        *[c.alias(k) for k, c in T.content_flags(t).items()],
    )


PER_LINE = rf"coalesce({WORDS} / nullif(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))), 0), 0)"


@query(
    "quality_score",
    f"""SELECT doc_id, round(least(100.0::DOUBLE, CASE WHEN {WORDS} > 100 THEN least(40.0::DOUBLE, {WORDS} / 10) ELSE 0 END + CASE WHEN {BULLETS} OR {NUMBERS} THEN 25 ELSE 0 END
    + CASE WHEN len({IDS}) > 0 THEN 5 ELSE 0 END + CASE WHEN {TYPE} <> 'general_text' THEN 10 ELSE 0 END + CASE WHEN {URLS} OR {CODE} THEN 10 ELSE 0 END
    + CASE WHEN {PER_LINE} BETWEEN 5 AND 20 THEN 10 WHEN {PER_LINE} > 3 THEN 5 ELSE 0 END), 4) AS score FROM documents""",
)
def quality_score(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.round(T.text_quality(F.col("text")), 4).alias("score"))


_FOUND = "nullif(" + STRIP.format(r"regexp_extract(text, '(?is){h}\s*[:\-]?\s*(.+?)(?:\n\n|\n[A-Z]|$)', 1)") + ", '')"
FOUND = "coalesce(" + ", ".join(_FOUND.replace("{h}", h) for h in T.ABSTRACT_HEADS) + ")"


@query(
    "abstract",
    f"""SELECT doc_id, md5(coalesce(CASE WHEN len(f) > 500 THEN f[:500] || '...' ELSE f END, CASE WHEN len(text) > 200 THEN {STRIP.format('text[:200]')} || '...' ELSE {STRIP.format('text')} END)) AS digest
    FROM (SELECT *, {FOUND} AS f FROM documents)""",
)
def abstract(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(T.abstract(F.col("text"))).alias("digest"))


FIRST10 = f"list_transform(list_slice(string_split(text, chr(10)), 1, 10), lambda x: {STRIP.format('x')})"


@query(
    "title_guess",
    rf"""SELECT doc_id, coalesce(list_filter({FIRST10}, lambda x: len(x) BETWEEN 11 AND 199 AND NOT regexp_matches(x, '^(http|www|#|\*|-)'))[1], source) AS title FROM documents""",
)
def title_guess(spark, d):
    return docs(spark, d, "doc_id", "text", "source").select("doc_id", T.first_title(F.col("text"), F.col("source")).alias("title"))


@query(
    "catalog",
    rf"""WITH b AS (SELECT doc_id, lang, source, {COLLAPSE.format('text')} AS t FROM documents)
    SELECT source, count(*) AS docs, sum(len(t))::BIGINT AS chars, min(doc_id) AS first_doc,
    sum(('0x' || substr(md5(doc_id || ':' || CASE WHEN len(t) > 80 THEN regexp_replace(t[:80], ' [^ ]*$', '') || '...' ELSE t END), 1, 8))::BIGINT)::BIGINT AS digest FROM b GROUP BY source""",
)
def catalog(spark, d):
    from ..operators.catalog import source_catalog

    return source_catalog(docs(spark, d, "doc_id", "source", "text"))


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents"


@query(
    "heading_level",
    rf"""SELECT level, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, CASE WHEN regexp_matches(s, '^\d+\.\s') THEN 1 WHEN regexp_matches(s, '^\d+\.\d+\s') THEN 2
    WHEN regexp_matches(s, '^\d+\.\d+\.\d+\s') THEN 3 WHEN len(s) < 50 AND upper(s) = s AND lower(s) <> s THEN 1 ELSE 2 END AS level
    FROM (SELECT doc_id, {STRIP.format('line')} AS s FROM ({LINES})) WHERE s <> '') GROUP BY level""",
)
def heading_level(spark, d):
    s = docs(spark, d, "doc_id", F.explode(T.lines(F.col("text"))).alias("line")).where(F.col("line").rlike(r"\S"))
    return s.groupBy(T.heading_level(F.col("line")).alias("level")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


FULL = rf"list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')"


@query(
    "doc_structure",
    rf"""SELECT doc_id, len(list_filter(f, lambda s: len(regexp_extract_all(s, '\S+')) <= 8 AND NOT ends_with(s, '.') AND regexp_matches(s, '^\p{{Lu}}') AND NOT regexp_matches(s, '^(•|-|\*|1\.|2\.|3\.)')))::INT AS n_headers,
    len(list_filter(f, lambda s: regexp_matches(s, '^[•◦▪‣\-*]'))) > 0 AS has_bullets, len(list_filter(f, lambda s: regexp_matches(s, '^\d+\.'))) > 0 AS has_numbers,
    len(list_filter(f, lambda s: ends_with(s, '.')))::INT AS n_paragraphs, round(coalesce({WORDS} / nullif(len(f), 0), 0), 4) AS words_per_line FROM (SELECT *, {FULL} AS f FROM documents)""",
)
def doc_structure(spark, d):
    s = {k: F.round(c, 4) if k == "words_per_line" else c for k, c in T.structure(F.col("text")).items()}
    return docs(spark, d, "doc_id", "text").select("doc_id", *[c.alias(k) for k, c in s.items()])


@query(
    "sentence_split",
    r"""SELECT doc_id, len(p) AS n, len(p[1]) AS first_chars, list_max(list_transform(p, lambda x: len(x))) AS longest
    FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents)""",
)
def sentence_split(spark, d):
    p = docs(spark, d, "doc_id", T.sentences(F.col("text")).alias("p"))
    return p.select(
        "doc_id",
        F.size("p").cast("long").alias("n"),
        F.length(F.get("p", F.lit(0))).cast("long").alias("first_chars"),
        F.array_max(F.transform("p", lambda x: F.length(x))).cast("long").alias("longest"),
    )


@query(
    "source_routes",
    "SELECT source, tactic, count(*) AS n FROM (SELECT source, coalesce((list_filter([" + ", ".join(f"CASE WHEN contains(lower(text), '{x.lower()}') THEN '{x}' END" for x in T.TACTICS)
    + "], lambda x: x IS NOT NULL))[1], 'General') AS tactic FROM documents) GROUP BY ALL",
)
def source_routes(spark, d):
    """Texts by source and by the first of the twelve tactics they name."""
    return docs(spark, d, "source", "text").groupBy("source", T.tactic(F.col("text")).alias("tactic")).agg(F.count("*").alias("n"))


@query("line_clean")
def line_clean(spark, d):
    t = T.cleaned_lines(F.col("text"))
    return docs(spark, d, "doc_id", "text").select("doc_id", F.md5(t).alias("digest"), F.length(t).alias("n_chars"))


@query(
    "human_sizes",
    "SELECT doc_id, CASE WHEN strlen(text) < 1024 THEN printf('%.1f B', strlen(text)::DOUBLE) WHEN strlen(text) < 1048576 THEN printf('%.1f KB', floor(strlen(text) / 1024 * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(strlen(text) / 1048576 * 10 + 0.5) / 10) END AS size FROM documents",
)
def human_sizes(spark, d):
    return docs(spark, d, "doc_id", "text").select("doc_id", T.human_bytes(F.octet_length("text").cast("double")).alias("size"))


@query(
    "page_text",
    r"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) AS n_chars FROM pages""",
)
def page_text(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    t = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?is)<script\b.*?</script\s*>", " "), r"(?is)<style\b.*?</style\s*>", " ")
    t = T.collapsed(F.regexp_replace(t, r"(?s)<[^>]*>", " "))
    return p.select("page_id", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"), F.length(t).cast("long").alias("n_chars"))
