"""Blocks before packing and chunks after it: priorities, section paths, oversize splits, semantic refinement."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ChunkConfig
from ..functions.text import let, token_estimate
from .chunking import even_cuts, spaced_peaks, text_at_cuts, window_words
from .embedding import Model, hashed_model

# --- Fixed values: weights that decide results. -----------------------------------------------------------------
PENALTIES = {"code": 0.3, "table": 0.4, "figure": 0.5, "quote": 0.6}
BONUSES = {"heading": 1.4, "list_start": 1.1, "paragraph_end": 1.05}
#: White space as in the JVM's patterns: ASCII only.
WORD, SENTENCE = re.compile(r"\S+", re.ASCII), re.compile(r"(?<=[.!?])\s+", re.ASCII)
# --------------------------------------------------------------------------------------------------------------


def enriched(is_heading: Column, in_table: Column, in_code: Column) -> dict[str, Column]:
    """A block's category, its priority, and whether it may be split."""
    fixed = is_heading | in_table | in_code
    return {
        "category": F.when(is_heading, "Title").when(in_table, "Table").when(in_code, "Code").otherwise("NarrativeText"),
        "priority": F.when(is_heading, 2.0).when(in_table | in_code, 1.5).otherwise(1.0),
        "breakable": ~fixed,
    }


def section_paths(blocks: DataFrame) -> DataFrame:
    """Each heading with the path of open headings, itself last: doc_id, block_idx, level, section_path.

    A heading closes those of its own level or deeper. ``blocks``: doc_id, block_idx, text, is_heading, level.
    A fold over one document's headings, inside the JVM.
    """
    item = F.struct("block_idx", "level", "text")
    kind = "array<struct<block_idx:int,level:int,text:string>>"
    start = F.struct(F.array().cast(kind).alias("open"), F.array().cast("array<struct<block_idx:int,level:int,section_path:string>>").alias("out"))

    def step(s: Column, h: Column) -> Column:
        def pushed(open_: Column) -> Column:
            path = F.array_join(F.transform(open_, lambda x: x["text"]), " > ")
            row = F.struct(h["block_idx"].alias("block_idx"), h["level"].alias("level"), path.alias("section_path"))
            return F.struct(open_.alias("open"), F.concat(s["out"], F.array(row)).alias("out"))

        # What is open has rising levels, so those below the heading's are its first ones.
        return let(F.concat(F.filter(s["open"], lambda x: x["level"] < h["level"]), F.array(h)), pushed)

    heads = blocks.where("is_heading").groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("h"))
    return heads.select("doc_id", F.inline(F.aggregate("h", start, step, lambda s: s["out"])))


def estimate(text: str) -> int:
    """``functions.text.token_estimate`` of a string."""
    n = len(WORD.findall(text))
    return max(1, int((n * 1.3 + len(text) / 4) / 2)) if text else 0


def greedy(parts: list[str], by: str, most: int) -> list[str]:
    """Neighbouring parts joined while they have at most so many tokens."""
    out, cur, n, size = [], [], 0, 0
    for x in parts:
        # Parts meet at white space, so the words of what is joined add up.
        words, chars = n + len(WORD.findall(x)), size + len(by) * bool(cur) + len(x)
        if cur and max(1, int((words * 1.3 + chars / 4) / 2)) > most:
            out.append(by.join(cur))
            cur, words, chars = [], words - n, len(x)
        cur.append(x)
        n, size = words, chars
    return [*out, by.join(cur)] if cur else out


def oversize_pieces(text: str, most: int) -> list[str]:
    per = most // 4

    def cut(texts: list[str], how: Callable[[str], list[str]]) -> list[str]:
        return [p for t in texts for p in ([t] if estimate(t) <= most else how(t))]

    pieces = cut([text], lambda t: greedy([p for p in t.split("\n\n") if WORD.search(p)], "\n\n", most))
    pieces = cut(pieces, lambda t: greedy(SENTENCE.split(t), " ", most))
    pieces = cut(pieces, lambda t: [" ".join(w[i : i + per]) for w in [WORD.findall(t)] for i in range(0, len(w), per)])
    return cut(pieces, lambda t: greedy(WORD.findall(t), " ", most))


def split_oversize(blocks: DataFrame, most: int = ChunkConfig.most) -> DataFrame:
    """Blocks over ``most`` tokens cut at paragraphs, what is still over it at sentences, then after every ``most // 4`` words,
    and runs of words so long that even these are over it wherever the next word would lift a piece over it. A word is never cut.

    Adds ``piece`` (0 to n - 1 in a block), ``tokens`` and ``is_split``; other columns of ``blocks`` (text among them) stay.
    Only texts over the limit go through Python, in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else oversize_pieces(t, most))

    over = token_estimate(F.col("text")) > most
    pieces = F.coalesce(cut(F.when(over, F.col("text"))), F.array("text"))
    rest = [c for c in blocks.columns if c not in ("text", "tokens")]
    each = blocks.select(*rest, pieces.alias("_pieces")).select(*rest, F.size("_pieces").alias("n_pieces"), F.posexplode("_pieces").alias("piece", "text"))
    return each.withColumn("tokens", token_estimate(F.col("text"))).withColumn("is_split", F.col("n_pieces") > 1).drop("n_pieces")


def context_factor(context: str) -> float:
    """How much less, or more, a cut counts by what stands around it."""
    f = 1.0
    if "```" in context or re.search(r"^\s*(def|class|import)", context, re.MULTILINE):
        f *= PENALTIES["code"]
    if "│" in context or context.count("|") > 2:
        f *= PENALTIES["table"]
    if re.search(r"fig\w*\s*\d+", context, re.IGNORECASE):
        f *= PENALTIES["figure"]
    if '"' in context or "'" in context:
        f *= PENALTIES["quote"]
    if re.search(r"^#+\s", context, re.MULTILINE):
        f *= BONUSES["heading"]
    if "\n\n" in context:
        f *= BONUSES["paragraph_end"]
    if re.search(r"^\s*[-•*]\s", context, re.MULTILINE):
        f *= BONUSES["list_start"]
    return f


def token_count(text: str) -> int:
    n = len(text.split())
    return max(1, int((n * 1.3 + len(text) / 4) / 2)) if text else 0


def token_windows(text: str, size: int, step: int) -> list[str]:
    """Windows of words with about ``size`` tokens, about ``step`` tokens apart."""
    w = text.split()
    return [" ".join(w[a:b]) for a, b in window_words(w, size, step)]


def boundaries(text: str, model: Model, c: ChunkConfig, smooth: int = 5) -> list[int]:
    """Token positions where the meaning turns: peaks of the smoothed distance of neighbouring windows, weighed by their contexts."""
    w = text.split()
    spans = window_words(w, c.window, c.step)
    if len(spans) < 3:
        return []
    v = model.windows(w, spans) if hasattr(model, "windows") else model([" ".join(w[a:b]) for a, b in spans])
    length = np.linalg.norm(v, axis=1)
    dist = 1 - (v[:-1] * v[1:]).sum(1) / np.maximum(length[:-1] * length[1:], 1e-12)
    x = np.convolve(dist, np.ones(smooth) / smooth, "same") if len(dist) > smooth else dist
    mad = np.median(np.abs(x - np.median(x)))
    z = np.zeros(len(x)) if mad == 0 else 0.6745 * (x - np.median(x)) / mad
    total, every = token_count(text), max(1, c.step)
    found = []
    for i in np.flatnonzero(z > c.z).tolist():
        at = min(total, (i + 1) * every)
        spot = int(at / max(1, total) * len(text))
        found.append((at, float(z[i]) * context_factor(text[max(0, spot - 200) : spot + 200])))
    return spaced_peaks(found, c.window // 2)


def refined_texts(text: str, model: Model, c: ChunkConfig) -> list[str]:
    """A text over the target cut at its boundaries, and evenly where pieces would be over ``most``; no words are lost."""
    total = token_count(text)
    if total <= c.target:
        return [text] if text.strip() else []
    return text_at_cuts(text, even_cuts(boundaries(text, model, c), total, c.least, c.most, c.target), total)


def refined(blocks: DataFrame, key: str = "doc_id", config: ChunkConfig | None = None, make: Callable[[], Model] = hashed_model) -> DataFrame:
    """key, piece and text of every block's refined pieces; blocks that are not ``breakable`` (if that column is there) stay whole.

    The distances of a text follow from all of its windows, so this runs in Arrow batches, a text at a time.
    """
    c = config or ChunkConfig()
    kind = blocks.schema[key].dataType.simpleString()
    breakable = F.col("breakable") if "breakable" in blocks.columns else F.lit(True)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in it:
            rows = []
            for k, text, may in zip(b["k"], b["text"], b["may"], strict=True):
                pieces = refined_texts(text or "", model, c) if may else [text or ""]
                rows += [(k, i, p) for i, p in enumerate(pieces)]
            yield pd.DataFrame(rows, columns=[key, "piece", "text"])

    return blocks.select(F.col(key).alias("k"), "text", breakable.alias("may")).mapInPandas(run, f"{key} {kind}, piece int, text string")
