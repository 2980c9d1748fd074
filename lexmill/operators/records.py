"""Records: fields with fallbacks, properties by source, metadata and its errors, files and their metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped, truthy

# --- Fixed values: names that decide results. -------------------------------------------------------------------
FINAL_SERIES = ("FIPS", "SP", "800", "ITL Bulletin", "Description", "CSWP", "GCR", "AI")
REQUIRED = (
    "source_id", "source_type", "source_file", "page_number", "text", "title", "page_start", "page_end", "document_type", "words",
    "quality_score", "has_structure", "has_identifiers", "special_identifiers", "language", "encoding",
)
PLATFORMS = "Enterprise,Mobile,ICS"
# --------------------------------------------------------------------------------------------------------------


def first_full(*values: Column) -> Column:
    """The first value that is neither null, empty nor (for numbers given as text) zero."""
    return F.coalesce(*[F.nullif(truthy(v.cast("string")), F.lit("0")) for v in values])


def publications(rows: DataFrame) -> DataFrame:
    """Final publications of the known series that have an address. Columns Stage, Series, URL, CurrentURL."""
    there = [F.col(c).isNotNull() & (F.col(c) != "nan") for c in ("URL", "CurrentURL")]
    return rows.where((F.col("Stage") == "Final") & F.col("Series").isin(*FINAL_SERIES) & (there[0] | there[1]))


def series_folder(series: Column) -> Column:
    """A series as a folder name: white space as underscores, no other signs; Unknown if nothing is left."""
    s = F.regexp_replace(stripped(F.coalesce(series, F.lit(""))), r"\s+", "_")
    return F.coalesce(truthy(F.regexp_replace(s, "[^A-Za-z0-9_.-]", "")), F.lit("Unknown"))


def pdf_address(url: Column) -> Column:
    """An address trimmed; on hosts that serve PDF files by number, with the ending."""
    u = stripped(F.coalesce(url, F.lit("")))
    bare = F.contains(u, F.lit("nvlpubs.nist.gov")) & ~u.endswith("/") & ~F.lower(u).endswith(".pdf")
    return F.when(bare, F.concat(u, F.lit(".pdf"))).otherwise(u)


def file_name(number: Column, url: Column, row: Column) -> Column:
    """A file's name by its publication number, else by the last part of its address, else by its row."""
    n = F.replace(stripped(F.coalesce(number, F.lit(""))), F.lit(" "), F.lit("_"))
    base = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)\?.*$", ""), r"(?s)^.*/", "")
    name = F.coalesce(truthy(n), truthy(base), F.concat(F.lit("file_"), row.cast("string"), F.lit(".pdf")))
    return F.when(F.lower(name).endswith(".pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def broken_parts(files: DataFrame, least: int = 1024) -> DataFrame:
    """Partial downloads that are too short to go on with. Columns path and length."""
    return files.where(F.col("path").endswith(".part") & (F.col("length") < least))


def source_properties(path: Column, meta: Column, text: Column, tactic: Column, technique: Column) -> Column:
    """What follows from the folder a record comes from, as a map of strings; ``meta`` is a map of strings."""
    has = lambda s: F.contains(path, F.lit(s))
    got = lambda k, other="": F.coalesce(meta[k], F.lit(other))
    stem = F.regexp_replace(got("source_file"), r"(?<=.)\.[^.]*$", "")
    pairs = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    own = (
        F.when(has("NIST") & has("CSWP"), pairs("cswp_number", stem, "publication_type", "Cybersecurity White Paper"))
        .when(has("NIST") & has("AI"), pairs("ai_guideline_number", stem, "publication_type", "AI Guidelines"))
        .when(has("NIST"), pairs("publication_number", got("doc_title"), "publication_type", "Special Publication"))
        .when(has("USENIX"), pairs("conference", "USENIX Security", "year", got("year", "2024"), "authors", got("authors")))
        .when(has("MITRE"), pairs("tactic", tactic, "technique_id", technique, "platform", PLATFORMS))
        .when(has("OWASP"), pairs("owasp_category", got("category", "General"), "risk_level", "Medium"))
        .when(has("SecurityTools"), pairs("tool_category", got("category", "General"), "tool_name", F.split_part(got("source_file"), F.lit("."), F.lit(1))))
        .when(has("AISecKG"), pairs("lab_id", got("lab_id", "unknown"), "topic", got("topic", "AI Security")))
        .when(has("AnnoCTR"), pairs("split", got("split", "unknown"), "annotation_type", got("annotation_type", "general")))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    base = pairs("source_type", F.regexp_replace(path, r"^.*/", ""), "source_path", path)
    return F.map_concat(base, own)


def mapped(rows: DataFrame) -> DataFrame:
    """docId, level, title, text, pageStart and pageEnd of records by their chains of fallbacks; empty strings and zeros fall through.

    ``rows``: doc_id, source_id, chunk_id, title, source_file, page_start, page_end, page, chunk_index, text,
    content, and metadata (a map of strings). Other columns stay.
    """
    m = lambda k: F.col("metadata")[k]
    page = (F.col("page"), m("page"), m("page_num_real"))
    start = F.coalesce(first_full(F.col("page_start"), m("page_start"), *page), F.lit("0"))
    end = F.coalesce(first_full(F.col("page_end"), m("page_end"), *page), start)
    doc_id = first_full(F.col("doc_id"), m("doc_id"), F.col("source_id"), F.col("chunk_id"), m("source_id"), m("file_id"), m("page_name"))
    return rows.select(
        "*",
        F.coalesce(doc_id, F.lit("unknown")).alias("docId"),
        F.coalesce(first_full(F.col("chunk_index"), m("level"), m("section_level")), F.lit("0")).cast("int").alias("level"),
        F.coalesce(*[truthy(x) for x in (F.col("title"), m("title"), m("doc_title"), m("page_name"), F.col("source_file"))], F.lit("")).alias("mapped_title"),
        F.coalesce(truthy(F.col("text")), truthy(F.col("content")), F.lit("")).alias("mapped_text"),
        start.cast("int").alias("pageStart"),
        end.cast("int").alias("pageEnd"),
    )


def passage(text: Column, start: Column, end: Column) -> Column:
    """What an answering model is shown of a result: its pages and the first 500 characters."""
    pages = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return F.struct(pages.alias("pages"), F.substring(text, 1, 500).alias("text"))


def metadata_errors(fields: dict[str, Column]) -> Column:
    """What is wrong with a metadata record, as an array: each required field that is missing or null, and values out of range."""
    missing = [F.lit(f"missing {c}") if c not in fields else F.when(fields[c].isNull(), F.lit(f"missing {c}")) for c in REQUIRED]
    ranged = [
        F.when(fields[c] < 0, F.lit(f"{c} below 0")) for c in ("words",) if c in fields
    ] + [F.when(~fields[c].between(0, 100), F.lit(f"{c} not in 0 to 100")) for c in ("quality_score",) if c in fields]
    return F.array_compact(F.array(*missing, *ranged))


def metadata_record(fields: dict[str, Column], strict: bool = True) -> Column:
    """A metadata record as a struct: at most ten identifiers; a quality score out of range is an error if strict."""
    own = dict(fields)
    own["special_identifiers"] = F.slice(own["special_identifiers"], 1, 10)
    if strict:
        q = own["quality_score"]
        own["quality_score"] = F.when(q.isNull() | q.between(0, 100), q).otherwise(F.raise_error(F.lit("quality_score not in 0 to 100")))
    return F.struct(*[own[c].alias(c) for c in REQUIRED])


def with_metadata(record: Column, more: Column) -> Column:
    """A map of strings merged over another; the right one wins."""
    keep = F.map_filter(record, lambda k, _: ~F.map_contains_key(more, k))
    return F.map_concat(keep, more)


def first_by(rows: DataFrame, key: str, *order) -> DataFrame:
    """One row of each key, the first in an order that breaks ties."""
    best = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("r")
    return rows.groupBy(F.col(key).alias("k")).agg(best).select("r.*")


def matched_pages(extracted: DataFrame, originals: DataFrame) -> DataFrame:
    """Each extracted page with its original's text, empty if there is none. Both: stem, page, text; of repeated originals the smallest text."""
    o = originals.groupBy("stem", "page").agg(F.min("text").alias("original"))
    return extracted.join(o, ["stem", "page"], "left").withColumn("original", F.coalesce("original", F.lit("")))


def page_status(similarity: Column, has_text: Column, ok: float = 0.8, warn: float = 0.6) -> Column:
    """OK, WARN or FAIL of an extracted page."""
    return F.when(~has_text, "FAIL").when(similarity >= ok, "OK").when(similarity >= warn, "WARN").otherwise("FAIL")


def word_similarity(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts, whatever their order: 0 to 1. (``unicode.matching_ratio`` compares characters.)"""
    x, y = (F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(r"(\S+)"), 1)) for t in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def merged_catalog(files: DataFrame, processed: DataFrame) -> DataFrame:
    """Every file with what processing knows of it: a title of ten characters or the stem, has_pages, and not_processed as its flag.

    ``files``: stem, title, pages; ``processed``: stem, category, total_pages, flags; of repeated ones the first by category.
    """
    p = first_by(processed, "stem", "category", "total_pages").withColumn("found", F.lit(True))
    j = files.join(p, "stem", "left")
    title = F.when(F.length(F.coalesce("title", F.lit(""))) >= 10, F.col("title")).otherwise(F.col("stem"))
    return j.select(
        "stem",
        title.alias("doc_title"),
        F.coalesce("category", F.lit("UNKNOWN")).alias("category"),
        F.coalesce("total_pages", "pages").alias("total_pages"),
        F.coalesce(F.col("flags"), F.when(F.col("found").isNull(), "not_processed"), F.lit("")).alias("flags"),
        F.coalesce("found", F.lit(False)).alias("has_pages"),
    )


def labelled_files(files: DataFrame, labels: DataFrame, otherwise: str = "otros") -> DataFrame:
    """Files with the label of their name; a name with several labels takes the last one. Columns file_name; file_name, label."""
    one = labels.groupBy("file_name").agg(F.max("label").alias("label"))
    return files.join(one, "file_name", "left").withColumn("label", F.coalesce("label", F.lit(otherwise)))


def kept_files(files: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """What is left of a table of files: inputs are never deleted, a new table leaves the rejected ones out."""
    return files.join(rejected.select(key), key, "left_anti")


def newest(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The last row of each key in an order; helper columns cannot clash with the rows' own."""
    packed = rows.select(F.struct("*").alias("r"), F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), F.struct(*order).alias("o"))
    w = Window.partitionBy("k").orderBy(F.desc("o"))
    return packed.withColumn("n", F.row_number().over(w)).where("n = 1").select("r.*")
