"""URL filter: unigram Viterbi segmentation of names and multinomial naive Bayes.

1. Words of all page texts are counted. A name (a run of letters in a host or a
   path) is split into words by Viterbi: the cheapest way through it, where a word
   costs its negative log probability and unknown letters cost ``UNKNOWN`` each.
   Only words that are substrings of some name are joined to the names; nothing of
   the vocabulary is broadcast.
2. A multinomial naive Bayes model with features hashed into ``BUCKETS`` places
   (host and path words apart) learns from all distinct urls on which a rule
   decides, and gives the verdict on the others. Its table has a fixed size. There are
   no other labels, so it learns what the rules' hosts and paths have in common.

Rules: a host, with all its subdomains, and the beginning of a path; the longest
that fits wins.

A null url or one without ``://`` has an empty host and path; no rule fits it, and
an empty url has the more frequent verdict. Without urls of both verdicts that
rules decide, the one that occurs (allow, if none) is given. Repeated rows give
repeated results, a null page_id stays null; names and words may have any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import stored, table, tuned

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS = 1 << 16
HEAD, UNKNOWN = 20, 12.0
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def word_counts(pages: DataFrame) -> DataFrame:
    """How often each word is in the pages' texts, without tags and scripts."""
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<[^>]*>|&\w+;", " ")
    return pages.select(F.explode(words_in(text)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def names_in(text: Column, kind: str) -> Column:
    """The names of a host or path, each with its kind."""
    return F.transform(words_in(text), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("name")))


def segmented(names: DataFrame, counts: DataFrame) -> DataFrame:
    """name and the array of its words, of every distinct name."""
    total = counts.agg(F.sum("n")).first()[0] or 1
    at = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("start"))
    most = F.least(F.lit(HEAD), F.length("name") - F.col("start") + 1)
    subs = at.select("name", "start", F.explode(F.sequence(F.lit(1), most)).alias("len"))
    subs = subs.select("name", "start", "len", F.col("name").substr(F.col("start"), F.col("len")).alias("word"))
    short = subs.join(counts, "word").select("name", "start", "len", "n")
    # Longer words are found by their first HEAD letters, and compared whole.
    heads = counts.where(F.length("word") > HEAD).select(F.substring("word", 1, HEAD).alias("head"), F.col("word").alias("whole"), "n")
    long = at.where(F.length("name") - F.col("start") >= HEAD).withColumn("head", F.col("name").substr(F.col("start"), F.lit(HEAD))).join(heads, "head")
    long = long.where(F.col("name").substr(F.col("start"), F.length("whole")) == F.col("whole")).select("name", "start", F.length("whole").alias("len"), "n")
    known = short.unionByName(long).groupBy("name").agg(F.collect_list(F.struct("start", "len", "n")).alias("known"))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            words = [viterbi(n, [] if k is None else k, total) for n, k in zip(b["name"], b["known"], strict=True)]
            yield pd.DataFrame({"name": b["name"], "words": words})

    return names.join(known, "name", "left").mapInPandas(run, "name string, words array<string>")


def viterbi(name: str, known, total: int) -> list[str]:
    """The cheapest split of a name; of equals the one with the longer last word."""
    ends: dict[int, list[tuple[int, float]]] = {}
    for k in known:
        ends.setdefault(k["start"] - 1 + k["len"], []).append((k["start"] - 1, math.log(total) - math.log(k["n"])))
    cost, back = [0.0], [0]
    for i in range(1, len(name) + 1):
        best = (cost[i - 1] + UNKNOWN, i - 1)
        for start, c in sorted(ends.get(i, [])):
            best = min(best, (cost[start] + c, start))
        cost.append(best[0])
        back.append(best[1])
    out, i = [], len(name)
    while i:
        out.append(name[back[i] : i])
        i = back[i]
    return out[::-1]


def bucket(kind: Column, word: Column) -> Column:
    return F.pmod(F.xxhash64(kind, word), F.lit(BUCKETS)).cast("int")


def verdicts(pages: DataFrame, rules=RULES, learn: Column | None = None) -> DataFrame:
    """host, path, rule, verdict and learned (the model's own verdict) of every distinct host and path.

    The model learns from the urls that a rule decides and for which ``learn``, if given, is true.
    """
    spark = pages.sparkSession
    urls = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).distinct()
    urls = urls.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    urls = stored(urls.withColumn("names", F.concat(names_in(F.col("host"), "h"), names_in(F.col("path"), "p"))), "op5u")
    each = urls.select("host", "path", F.explode("names").alias("x")).select("host", "path", "x.kind", "x.name")
    counts = stored(word_counts(pages), "op5w")
    words = stored(segmented(each.select("name").distinct(), counts), "op5n")
    # A name may be in a third of all urls: its rows are salted.
    salted = words.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    each = each.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int"))
    features = each.join(salted, ["name", "salt"]).select("host", "path", F.transform("words", lambda w: bucket(F.col("kind"), w)).alias("b"))
    features = features.groupBy("host", "path").agg(F.flatten(F.collect_list("b")).alias("b"))
    urls = stored(urls.drop("names").join(features, ["host", "path"], "left"), "op5f")

    allow = {r for r, v in rules if v == "allow"}
    label = F.col("rule").isin(*allow).cast("int")
    known = urls.where("rule is not null").where(F.lit(True) if learn is None else learn).select(label.alias("allow"), "b")
    docs = {r["allow"]: r["n"] for r in known.groupBy("allow").agg(F.count("*").alias("n")).collect()}
    weights = np.zeros(BUCKETS)
    prior = 1.0 if not docs.get(0) else -1.0
    if docs.get(0) and docs.get(1):
        # At most two rows for each of the buckets.
        n = np.zeros((2, BUCKETS))
        rows = known.select("allow", F.explode("b").alias("b")).groupBy("allow", "b").agg(F.count("*").alias("n")).toPandas()
        n[rows["allow"].to_numpy(), rows["b"].to_numpy()] = rows["n"].to_numpy()
        p = np.log((n + 1) / (n.sum(1, keepdims=True) + BUCKETS))
        weights, prior = p[1] - p[0], math.log(docs[1] / docs[0])
    sent = spark.sparkContext.broadcast((weights, prior))

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, constant = sent.value
        for b in it:
            score = [constant if x is None else constant + w[np.asarray(x, np.int64)].sum() for x in b["b"]]
            yield pd.DataFrame({"host": b["host"], "path": b["path"], "rule": b["rule"], "learned": np.where(np.array(score) >= 0, "allow", "block")})

    out = urls.mapInPandas(judge, "host string, path string, rule string, learned string")
    given = F.lit(None).cast("string")
    for rule, v in rules:
        given = F.when(F.col("rule") == rule, F.lit(v)).otherwise(given)
    return out.withColumn("verdict", F.coalesce(given, "learned"))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and learned of every row."""
    tuned(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return own.join(stored(verdicts(pages, rules), "op5v"), ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "learned")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages", "page_id", "url", "html"))
