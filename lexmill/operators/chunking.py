"""Chunking: packing blocks by structure, overlap, token windows and semantic cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, sentences, token_estimate

TARGET, LEAST, MOST = 200, 100, 256


def cohesion(sections: Column, categories: Column, headings: Column) -> Column:
    """1 for fewer than two blocks; else half for one section, .3 for two categories or fewer, .2 without headings. Arrays of one chunk."""
    one = F.size(F.array_distinct(sections)) == 1
    few = F.size(F.array_distinct(categories)) <= 2
    plain = ~F.exists(headings, lambda h: h)
    parts = F.when(one, 0.5).otherwise(0.0) + F.when(few, 0.3).otherwise(0.0) + F.when(plain, 0.2).otherwise(0.0)
    return F.when(F.size(sections) < 2, 1.0).otherwise(F.round(parts, 1))


def pack_by_structure(blocks: DataFrame, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Greedy packing of a document's blocks into chunks.

    A chunk ends before a heading or a change of section, before a block that would
    lift it over ``most`` when it has ``least``, and once it has ``target`` and either
    a tenth more, nine tenths of ``most`` or little cohesion. The state is a fold over
    the blocks of one document, an ``aggregate`` inside the JVM.

    ``blocks``: doc_id, block_idx, text, tokens, is_heading, section_title, and, if there, category and
    piece (the place in a block that was split).
    """
    block = "struct<block_idx:int,piece:int,text:string,tokens:int,is_heading:boolean,section:string,category:string>"
    category = F.col("category") if "category" in blocks.columns else F.when(F.col("is_heading"), "Title").otherwise("NarrativeText")
    piece = F.col("piece") if "piece" in blocks.columns else F.lit(0)
    section = F.coalesce("section_title", F.lit(""))
    item = F.struct("block_idx", piece.alias("piece"), "text", "tokens", "is_heading", section.alias("section"), category.alias("category"))
    start = F.struct(
        F.array().cast(f"array<array<{block}>>").alias("out"),
        F.array().cast(f"array<{block}>").alias("buf"),
        F.lit(0).alias("n"),
        F.lit("").alias("last"),
    )

    def step(s, b):
        moved = (s["last"] != "") & (b["section"] != s["last"])
        full = (s["n"] + b["tokens"] > most) & (s["n"] >= least)
        before = (F.size(s["buf"]) > 0) & (moved | b["is_heading"] | full)
        buf = F.when(before, F.array(b)).otherwise(F.concat(s["buf"], F.array(b)))
        n = F.when(before, b["tokens"]).otherwise(s["n"] + b["tokens"])
        out = F.when(before, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])
        after = (n >= target) & ((n >= target * 1.1) | (n >= most * 0.9) | (cohesion_of(buf) < 0.3))
        return F.struct(
            F.when(after, F.concat(out, F.array(buf))).otherwise(out).alias("out"),
            F.when(after, F.slice(buf, 1, 0)).otherwise(buf).alias("buf"),
            F.when(after, 0).otherwise(n).alias("n"),
            b["section"].alias("last"),
        )

    def cohesion_of(c):
        return cohesion(F.transform(c, lambda b: b["section"]), F.transform(c, lambda b: b["category"]), F.transform(c, lambda b: b["is_heading"]))

    def finish(s):
        return F.when(F.size(s["buf"]) > 0, F.concat(s["out"], F.array(s["buf"]))).otherwise(s["out"])

    chunks = blocks.groupBy("doc_id").agg(F.aggregate(F.array_sort(F.collect_list(item)), start, step, finish).alias("chunks"))
    each = chunks.select("doc_id", F.posexplode("chunks").alias("chunk_id", "c"))
    heading = F.exists("c", lambda b: b["is_heading"])
    return each.select(
        "doc_id",
        "chunk_id",
        F.array_join(F.transform("c", lambda b: b["text"]), "\n\n").alias("content"),
        F.aggregate("c", F.lit(0), lambda a, b: a + b["tokens"]).alias("chunk_tokens"),
        heading.alias("is_heading_block"),
        cohesion_of(F.col("c")).alias("block_cohesion"),
        F.size("c").alias("source_blocks"),
        F.get("c", F.lit(0))["section"].alias("section_title"),
    )


def with_overlap(chunks: DataFrame, ratio: float = 0.18) -> DataFrame:
    """Each chunk with the last sentences of the one before it in front, within a share of its own tokens.

    The chunk before is taken as it is after its own overlap, so this is a fold over
    a document's chunks. At most the sentences that fit are carried.
    """
    item = F.struct("chunk_id", "content", "chunk_tokens")
    ordered = F.array_sort(F.collect_list(item))
    kind = "array<struct<chunk_id:int,content:string,chunk_tokens:int,overlap_applied:boolean>>"

    def step(out, c):
        before = F.try_element_at(out, F.lit(-1))["content"]
        room = (c["chunk_tokens"] * ratio).cast("int")
        start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(True).alias("on"))

        def take(s, x):
            def put(more):
                ok = F.coalesce(more <= room, F.lit(False))
                return F.struct(F.when(ok, F.concat_ws(" ", x, F.nullif(s["t"], F.lit("")))).otherwise(s["t"]).alias("t"), F.when(ok, more).otherwise(s["n"]).alias("n"), ok.alias("on"))

            return let(F.when(s["on"], s["n"] + token_estimate(x)), put)

        def added(tail):
            def row(text):
                return F.struct(c["chunk_id"].alias("chunk_id"), text.alias("content"), token_estimate(text).alias("chunk_tokens"), (tail != "").alias("overlap_applied"))

            return F.concat(out, F.array(let(F.when(tail != "", F.concat(tail, F.lit("\n\n"), c["content"])).otherwise(c["content"]), row)))

        # Nothing before, nothing to carry.
        return let(F.aggregate(F.reverse(sentences(F.coalesce(before, F.lit("")))), start, take)["t"], added)

    folded = chunks.groupBy("doc_id").agg(F.aggregate(ordered, F.array().cast(kind), step).alias("c"))
    return folded.select("doc_id", F.inline("c"))


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    """Counts, mean, median, deviation, quartiles and shares over all chunks."""
    t = F.col("chunk_tokens")
    q = lambda p: F.round(F.percentile(t, F.lit(p)), 4)
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.round(F.avg(t), 4).alias("mean_tokens"),
        q(0.5).alias("median_tokens"),
        F.round(F.stddev_pop(t), 4).alias("std_tokens"),
        F.min(t).alias("min_tokens"),
        F.max(t).alias("max_tokens"),
        q(0.25).alias("p25"),
        q(0.75).alias("p75"),
        q(0.9).alias("p90"),
        F.count_if("is_heading_block").alias("heading_blocks"),
        F.count_if(F.col("block_cohesion") > 0.7).alias("cohesive"),
    )


def window_words(words: list[str], size: int, step: int) -> list[tuple[int, int]]:
    """First and one past the last word of windows of at most ``size`` tokens (or one word), about ``step`` tokens apart.

    A word is estimated at half of 1.3 and a quarter of its letters and the blank: counted in fortieths, exactly.
    """
    cost = np.cumsum([26 + 5 * (len(w) + 1) for w in words])
    out, at = [], 0
    while at < len(words):
        base = int(cost[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(cost, base + 40 * size, side="right")))
        out.append((at, end))
        if end >= len(words):
            break
        at = max(at + 1, int(np.searchsorted(cost, base + 40 * step, side="right")))
    return out


def token_windows(docs: DataFrame, size: int = 150, step: int = 30) -> DataFrame:
    """Overlapping windows of about ``size`` tokens, about ``step`` apart: doc_id, window_id, start_word, end_word."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                rows += [(doc, k, a, b) for k, (a, b) in enumerate(window_words((text or "").split(), size, step))]
            yield pd.DataFrame(rows, columns=["doc_id", "window_id", "start_word", "end_word"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, window_id int, start_word int, end_word int")


def boundary_scores(vectors: DataFrame, group: str, order: str, width: int = 5) -> DataFrame:
    """Distance of consecutive vectors, its moving mean (zeros beyond the ends) and robust z-score.

    ``vectors``: group, order, v (array). The score is 0.6745 (x - median) / MAD, 0 where MAD is 0.
    """
    from ..functions.vectors import cosine

    w = Window.partitionBy(group).orderBy(order)
    d = vectors.withColumn("dist", 1 - cosine(F.col("v"), F.lead("v").over(w))).where("dist is not null").drop("v")
    half = width // 2
    d = d.withColumn("smooth", F.sum("dist").over(w.rowsBetween(-half, half)) / width)
    g = Window.partitionBy(group)
    d = d.withColumn("med", F.median("smooth").over(g)).withColumn("mad", F.median(F.abs(F.col("smooth") - F.col("med"))).over(g))
    z = F.when(F.col("mad") == 0, 0.0).otherwise((F.col("smooth") - F.col("med")) * 0.6745 / F.col("mad"))
    return d.withColumn("z", z).drop("med", "mad")


def spaced_peaks(candidates: list[tuple[int, float]], apart: int) -> list[int]:
    """Positions by falling score, each at least ``apart`` from those before it; sorted."""
    out: list[int] = []
    for at, _ in sorted(candidates, key=lambda c: (-c[1], c[0])):
        if all(abs(at - o) >= apart for o in out):
            out.append(at)
    return sorted(out)


def even_cuts(cuts: list[int], total: int, least: int = LEAST, most: int = MOST, target: int = TARGET) -> list[int]:
    """Cut positions such that no piece is over ``most``; pieces under ``least`` join the next.

    Always ends: each step takes one boundary.
    """
    edges, start = [], 0
    for end in [*sorted({c for c in cuts if 0 < c < total}), total]:
        if end - start < least and end < total:
            continue
        while end - start > most:
            start += target
            edges.append(start)
        if end < total:
            edges.append(end)
            start = end
    return edges


def text_at_cuts(text: str, cuts: list[int], total: int) -> list[str]:
    """The pieces of a text at token cuts, each moved right to the next white space."""
    spots, n = [0], len(text)
    for c in cuts:
        at = min(n, round(c / max(1, total) * n))
        while at < n and not text[at].isspace():
            at += 1
        spots.append(at)
    spots.append(n)
    return [p for a, b in zip(spots, spots[1:], strict=False) if (p := text[a:b].strip())]
