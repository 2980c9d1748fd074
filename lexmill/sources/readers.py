"""Readers: page and chunk records, question tables, raw files, side tables."""

from __future__ import annotations

import csv
import io
import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_V1 = (
    "pipeline_version string, doc_title string, authors array<string>, page_num_real int, page_num_logical string, toc_path array<string>, "
    "source_id string, text string, quality_flags array<string>, abstract string, source_category string"
)
PAGE_V2 = (
    "source_id string, source_type string, source_file string, page_number int, text string, title string, page_start int, page_end int, "
    "document_type string, words int, quality_score double, has_structure boolean, has_identifiers boolean, special_identifiers array<string>, "
    "language string, encoding string, metadata map<string,string>"
)
CHUNK = (
    "content string, metadata struct<category:string,section_title:string,section_level:int,page_num_real:int,page_num_logical:string,doc_title:string,"
    "authors:array<string>,toc_path:array<string>,source_id:string,quality_flags:array<string>,is_heading:boolean,in_table:boolean,in_list:boolean,"
    "in_code:boolean,is_figure:boolean,is_quote:boolean,is_reference:boolean,chunk_id:int,chunk_tokens:int,overlap_applied:boolean,"
    "is_heading_block:boolean,block_cohesion:double,source_blocks:int,combined_categories:array<string>>"
)
SIDECAR = "tool_id string, name string, title string, description string, category string, urls array<string>, download_date string, char_count int"
ITEM = (
    "uuid string, handle string, name string, metadata array<struct<key:string,value:string>>, "
    "bitstreams array<struct<name:string,uuid:string,mimeType:string,retrieveLink:string,sizeBytes:bigint>>"
)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines with a fixed schema and the file of each; malformed lines are dropped, or fail if strict."""
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    rows = spark.read.schema(schema).option("mode", mode).option("recursiveFileLookup", True).json(path)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path and length of all files under a folder, empty ones too, which Spark's readers leave out."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    found, rows = at.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        if not re.match(r"[._]", f.getPath().getName()):
            rows.append((f.getPath().toString(), f.getLen()))
    return spark.createDataFrame(rows, "path string, length long")


def json_file_checks(spark: SparkSession, path: str, least_chars: int = 20) -> DataFrame:
    """Per file: pages, characters of text, and the reason why it is not valid (null if it is)."""
    local = lambda c: F.regexp_replace(c, "^file:/+", "file:///")
    rows = json_lines(spark, path, "text string").withColumn("file", local(F.col("file")))
    n = F.length(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", ""))
    counts = rows.groupBy("file").agg(F.count("*").alias("pages"), F.sum(n).alias("chars"))
    # From the listing, as a file without rows has no group.
    files = listing(spark, path).select(local(F.col("path")).alias("file"))
    out = files.join(counts, "file", "left").fillna(0, ["pages", "chars"])
    return out.withColumn("reason", F.when(F.col("pages") == 0, "no pages").when(F.col("chars") < least_chars, "too little text"))


def questions(spark: SparkSession, path: str, title: str = "Titulo", body: str = "Cuerpo", start: int = 0, n: int | None = None) -> DataFrame:
    """Rows of a semicolon-separated table with title and body, the question made of both, and their place.

    A slice keeps the records start to start + n - 1 of each file. Positions are counted while a file is read
    whole, in one task, so that neither splits nor the reader's order decide them.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    names = spark.read.option("sep", ";").option("header", True).csv(path).columns
    stop = None if n is None else start + n

    def run(batches):
        for b in batches:
            for content in b["content"]:
                records = csv.DictReader(io.StringIO(content.decode("utf-8-sig", "replace"), newline=""), delimiter=";")
                yield pd.DataFrame([{c: r.get(c) for c in names} for r in islice(records, start, stop)], columns=names)

    raw = files.mapInPandas(run, T.StructType([T.StructField(c, T.StringType()) for c in names]))
    ok = (F.coalesce(F.trim(title), F.lit("")) != "") & (F.coalesce(F.trim(body), F.lit("")) != "")
    return raw.where(ok).withColumn("question", F.concat_ws("\n\n", F.col(title), F.col(body)))


def raw_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Text files with path, id, length, decoded text and encoding: UTF-8 where valid, else Latin-1."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    body = F.when(F.substring(F.hex("content"), 1, 6) == "EFBBBF", F.expr("substring(content, 4)")).otherwise(F.col("content"))
    raw = raw.withColumn("body", body)
    valid = F.is_valid_utf8(F.col("body").cast("string"))
    text = F.when(valid, F.col("body").cast("string")).otherwise(F.decode("body", "ISO-8859-1"))
    return raw.select("path", source_id(F.col("content")).alias("source_id"), "length", text.alias("text"), F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def source_id(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def stem(path: Column) -> Column:
    """A file's name without folders and its last ending."""
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?<=.)\.[^.]*$", "")


def with_sidecars(files: DataFrame, sides: DataFrame) -> DataFrame:
    """Files joined to their ``{stem}_metadata.json`` records; files without one stay."""
    s = sides.withColumn("_stem", F.regexp_replace(stem(F.col("file")), "_metadata$", "")).drop("file")
    w = Window.partitionBy("_stem").orderBy(F.col("tool_id"))
    s = s.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return files.withColumn("_stem", stem(F.col("path"))).join(s, "_stem", "left").drop("_stem")


def pdf_links(items: DataFrame) -> DataFrame:
    """A row for each PDF bitstream of each item: uuid, handle, file_name, link, bytes."""
    pdf = F.filter("bitstreams", lambda b: b["mimeType"] == "application/pdf")
    each = items.select("uuid", "handle", F.explode(pdf).alias("b"))
    return each.select("uuid", "handle", F.col("b.name").alias("file_name"), F.col("b.retrieveLink").alias("link"), F.col("b.sizeBytes").alias("bytes"))


def first_items(items: DataFrame) -> DataFrame:
    """One item for each uuid (or handle): the first by handle and name."""
    key = F.coalesce(F.nullif("uuid", F.lit("")), F.col("handle"))
    w = Window.partitionBy("_k").orderBy("handle", "name")
    return items.withColumn("_k", key).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_k", "_rn")


def keyword_items(items: DataFrame, keywords: list[str]) -> DataFrame:
    """Items whose title or subjects contain one of the keywords, whatever the case of either."""
    values = F.transform(F.filter("metadata", lambda m: m["key"].isin("dc.title", "dc.subject", "dc.subject.other")), lambda m: m["value"])
    hay = F.lower(F.array_join(F.concat(F.array(F.coalesce("name", F.lit(""))), F.coalesce(values, F.array().cast("array<string>"))), " "))
    hit = F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(hay, k))
    return items.where(hit)


def vector_records(spark: SparkSession, path: str) -> DataFrame:
    """Vectors keyed by id, never by position: id, collection, vector."""
    kind = T.StructType([T.StructField("id", T.LongType()), T.StructField("collection", T.StringType()), T.StructField("vector", T.ArrayType(T.FloatType()))])
    return spark.read.schema(kind).parquet(path)


def largest_file(files: DataFrame) -> DataFrame:
    """The longest file of each folder: folder, path."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("folder")).agg(F.max_by("path", F.struct("length", "path")).alias("path"))
