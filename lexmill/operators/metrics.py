"""Metrics of answers and extractions: BLEU, ROUGE-L, readability, similarity, chunk checks."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sentence_count, stripped, words


def bleu(reference: str, answer: str, most: int = 4) -> float:
    """BLEU with uniform weights and no smoothing: 0 if any order has no match."""
    r, a = reference.split(), answer.split()
    if not r or not a:
        return 0.0
    logs = 0.0
    for n in range(1, most + 1):
        x, y = (Counter(zip(*(w[i:] for i in range(n)), strict=False)) for w in (a, r))
        hits, total = sum((x & y).values()), sum(x.values())
        if not hits:
            return 0.0
        logs += math.log(hits / total) / most
    return math.exp(logs + min(0.0, 1 - len(r) / len(a)))


def rouge_l(reference: str, answer: str) -> float:
    """F1 of the longest common subsequence of lower-case words; words are not stemmed."""
    r, a = reference.lower().split(), answer.lower().split()
    if not r or not a:
        return 0.0
    row = [0] * (len(a) + 1)
    for x in r:
        last = 0
        for j, y in enumerate(a, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    n = row[-1]
    return 2 * n / (len(r) + len(a)) if n else 0.0


def similarity(a: str, b: str) -> float:
    """Ratio of matching characters, as difflib has it."""
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def answer_metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with bleu and rouge_l of each (reference, answer); nulls count as empty: 0."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.select(*keys).schema)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            out = b[keys].copy()
            both = [*zip(b["reference"].fillna(""), b["answer"].fillna(""), strict=True)]
            out["bleu"] = [bleu(x, y) for x, y in both]
            out["rouge_l"] = [rouge_l(x, y) for x, y in both]
            yield out

    return pairs.select(*keys, "reference", "answer").mapInPandas(run, f"{kinds}, bleu double, rouge_l double")


def syllables(word: Column) -> Column:
    """Groups of vowels, at least one."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(word), F.lit("[aeiouyáéíóúäöüèêàâîôû]+")))


def readability(text: Column) -> dict[str, Column]:
    """Flesch-Kincaid grade and Gunning fog index; 0 without words."""
    w = F.filter(words(text), lambda x: x.rlike(r"\p{L}"))
    n, s = F.size(w), F.greatest(F.lit(1), sentence_count(text))
    syl = F.aggregate(w, F.lit(0), lambda a, x: a + syllables(x))
    hard = F.size(F.filter(w, lambda x: syllables(x) >= 3))
    per = lambda a, b: F.coalesce(F.try_divide(a * 1.0, b), F.lit(0.0))
    grade = F.when(n > 0, per(n, s) * 0.39 + per(syl, n) * 11.8 - 15.59).otherwise(0.0)
    fog = (per(n, s) + per(hard, n) * 100) * 0.4
    return {"grade": grade, "fog": fog}


def extraction_status(score: Column, ok: float = 0.8, warn: float = 0.6) -> Column:
    return F.when(score >= ok, "OK").when(score >= warn, "WARN").otherwise("FAIL")


def chunk_flags(text: Column, stop: tuple[str, ...], least: int = 400, most: int = 1200) -> Column:
    """What is wrong with a chunk, as an array of names."""
    def of(c: Column) -> Column:
        t, w = c["t"], c["w"]
        n = F.size(w)
        stops = F.coalesce(F.try_divide(F.size(F.filter(w, lambda x: x.isin(*stop))), n), F.lit(1.0))
        alpha = F.coalesce(F.try_divide(F.length(F.regexp_replace(t, r"\P{L}+", "")), F.length(t)), F.lit(0.0))
        return F.array_compact(
            F.array(
                F.when(n == 0, "empty"),
                F.when(n < least, "too_short"),
                F.when(n > most, "too_long"),
                F.when((t != "") & ~t.rlike(r"^[\p{Lu}0-9]"), "start_mid_sentence"),
                F.when((t != "") & ~t.rlike(r"[.!?…:;]['\")\]]?$"), "end_mid_sentence"),
                F.when((n >= 12) & (stops > 0.88), "mostly_stopwords"),
                F.when((F.length(t) >= 40) & (alpha < 0.45), "low_alpha_ratio"),
            )
        )

    return let(stripped(F.coalesce(text, F.lit(""))), lambda t: let(F.struct(t.alias("t"), words(F.lower(t)).alias("w")), of))


def chunk_status(flags: Column, duplicate: Column) -> Column:
    """FAIL for empty or duplicate chunks, WARN for any other flag, else OK."""
    return F.when(duplicate | F.array_contains(flags, "empty"), "FAIL").when(F.size(flags) > 0, "WARN").otherwise("OK")


def weighted_perplexity(loss: Column, n: Column) -> Column:
    """exp of the token-weighted mean loss."""
    return F.exp(F.try_divide(F.sum(loss * n), F.sum(n)))


def judged(text: Column) -> dict[str, Column]:
    """Decision and the three scores of a judge's answer; the rule decides where it names none."""
    score = {k: F.nullif(F.regexp_extract(text, rf"(?i){k}\s*:\s*(\d+)", 1), F.lit("")).cast("int") for k in ("relevance", "groundedness", "completeness")}
    said = F.upper(F.regexp_extract(text, r"(?i)decision\s*:\s*([A-Za-z]+)", 1))
    least = F.least(*score.values())
    rule = F.when(least >= 7, "APPROVE").when(least <= 4, "REJECT").otherwise("REVISE")
    return {"decision": F.when(said != "", said).otherwise(rule), **score}
