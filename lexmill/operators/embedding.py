"""Vectors of texts: a replaceable interface with a deterministic default, and query expansion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

#: A model takes texts and returns a matrix with a row for each. It may have ``windows(words, spans)``, the same for overlapping runs of words.
Model = Callable[[list[str]], np.ndarray]


def hashed_model(dim: int = 384) -> Model:
    """Signed hashed counts of words and word pairs, of unit length: no model file, the same on every machine."""

    def places(xs: list[str]) -> np.ndarray:
        """Where words or pairs count: twice their column, plus one where they count negatively."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, xs), np.uint64, len(xs))
        return (h % np.uint64(dim) * np.uint64(2) + (np.uint64(1) - (h >> np.uint64(63)))).astype(np.int64)

    def pairs(w: list[str]) -> list[str]:
        return list(map(" ".join, zip(w, w[1:], strict=False)))

    def unit(at: np.ndarray, rows: int) -> np.ndarray:
        n = np.bincount(at, minlength=rows * 2 * dim).reshape(rows, dim, 2)
        out = (n[:, :, 0] - n[:, :, 1]).astype(np.float64)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)

    def encode(texts: list[str]) -> np.ndarray:
        found, sizes = [], []
        for t in texts:
            w = t.lower().split()
            found += w
            found += pairs(w)
            sizes.append(max(0, 2 * len(w) - 1))
        return unit(np.repeat(np.arange(len(texts)) * 2 * dim, sizes) + places(found), len(texts))

    def windows(words: list[str], spans: list[tuple[int, int]]) -> np.ndarray:
        """The same of runs of words (first, one past the last) that overlap: each word and pair is looked up once."""
        w = " ".join(words).lower().split()
        one, two = places(w), places(pairs(w))
        parts = [x for a, b in spans for x in (one[a:b], two[a : b - 1])]
        sizes = [2 * (b - a) - 1 for a, b in spans]
        return unit(np.repeat(np.arange(len(spans)) * 2 * dim, sizes) + np.concatenate(parts), len(spans))

    encode.windows = windows
    return encode


def embedded(df: DataFrame, key: str, text: str, make: Callable[[], Model] = hashed_model, batch: int = 256) -> DataFrame:
    """key and vector of every row; the model is made once a task and fed in batches. A null text is empty."""
    kind = df.schema[key].dataType.simpleString()

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in it:
            texts = b[text].fillna("").tolist()
            v = [row for i in range(0, len(texts), batch) for row in model(texts[i : i + batch]).astype(np.float32)]
            yield pd.DataFrame({key: b[key], "vector": v})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def vector_of(text: Column, make: Callable[[], Model] = hashed_model) -> Column:
    """The vector of a text as a column: not computed where it is not used."""

    @F.pandas_udf("array<float>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in it:
            yield pd.Series(list(model(texts.fillna("").tolist()).astype(np.float32)), index=texts.index, dtype=object)

    return run(text)


def expanded_terms(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """query_id and its terms with their synonyms, distinct and sorted. ``synonyms``: term, synonym."""
    terms = queries.select("query_id", F.explode("terms").alias("term"))
    more = terms.join(synonyms, "term").select("query_id", F.col("synonym").alias("term"))
    return terms.union(more).groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


def with_hypothetical(queries: DataFrame, template: str = "The answer to the question {} is as follows.") -> DataFrame:
    """Each query and, as a row of its own, a hypothetical answer to search with: query_id, text, hypothetical."""
    before, _, after = template.partition("{}")
    own = queries.select("query_id", "text", F.lit(False).alias("hypothetical"))
    return own.union(queries.select("query_id", F.concat(F.lit(before), F.col("text"), F.lit(after)), F.lit(True)))


def query_terms(text: Column, most_chars: int = 512) -> Column:
    """Sorted distinct lower-case words of a query, cut at so many characters."""
    return F.array_sort(F.array_distinct(words(F.lower(F.substring(text, 1, most_chars)))))
