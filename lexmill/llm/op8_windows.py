"""Substring dedup by Rabin-Karp hashes of every window of 13 words, counted in Spark.

1. Every window gets two rolling hashes of its words, of 61 and 32 bits, by
   independent values of the words and independent bases. So that not each window
   has to be shuffled, they are first told apart by the least hash of the five-word
   runs inside them: equal windows share it, so a window whose least run occurs in
   one document only has no equal elsewhere. These runs (about one for five words)
   are counted by document; those in two documents or more go into a bitmap.
2. The windows that pass it are counted by both hashes: the smallest document
   with each. Both counts are partial sums before any shuffle, so a passage in a
   third of all documents sends one row from each task. Of equal texts only the
   first takes part; all windows of the others start in it.
3. A window with a smaller document marks its words; marked windows merge into
   maximal intervals, and each text is cut by its intervals.

Windows count as equal if both hashes are: with 10**12 different windows the chance
that any two are taken as equal wrongly is about one in ten thousand.

Nulls and repeats: a null text has no words; neither has an empty one: nothing is
removed, the hash of no bytes. A null doc_id is neither smaller nor larger than
another: nothing is removed from such a row, or because of it. Rows with one doc_id
do not remove words from each other, whether their texts are equal or not; each is
judged on its own text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, stored, table, tuned, utf8
from ._hashes import Words, batches, window_minima
from ._repeats import Parts, bitmap, copies_of, has_ids, hashed_ids, ids_of, signed, with_marks

WINDOW, RUN = 13, 5


def inside(w: Words, n: int, k: int) -> np.ndarray:
    """Which of the first n windows of k words lie in one text."""
    return np.flatnonzero(w.of[:n] == w.of[k - 1 :][:n]) if n else np.zeros(0, np.int64)


def distinct_pairs(of: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each hash once a text."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (of[1:] != of[:-1]) | (h[1:] != h[:-1])
    return of[first], h[first]


def frame(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def repeated_windows(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """doc_id, part, the array of first words ``at`` of windows that a smaller doc_id has too, and
    ``copy``: whether the whole text is that of a smaller one, so that all its windows are.

    ``part`` is 0, or the hash of the text if rows with other texts may have the doc_id.
    ``docs``: doc_id, text, h.
    """
    copies = copies_of(docs.where("text is not null and doc_id is not null"))
    parts, firsts = Parts(copies), hashed_ids(copies.where("doc_id = first"), "doc_id")
    first_ids = bitmap(firsts)
    dropped(firsts)

    def batches_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Words]]:
        """Ids, parts and words of the first copies; that a few later ones may be among them changes nothing."""
        known, part_of = first_ids.open(), parts.reader()
        for b in it:
            b = b.filter(b.column("doc_id").is_valid())
            b = b.filter(pa.array(has_ids(known, ids_of(b.column("doc_id")))))
            ids = ids_of(b.column("doc_id"))
            part = part_of(ids, ids_of(b.column("h")))
            for first, texts in batches([utf8(t) for t in b.column("text").to_pylist()]):
                yield ids[first:], part[first:], Words(texts)

    def emit_runs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, w in batches_of(it):
            least = window_minima(w.windows(run), window - run + 1)
            at = inside(w, len(least), window)
            of, least = distinct_pairs(w.of[at], least[at])
            yield frame(hash=signed(least), doc_id=ids[of])

    found = docs.mapInArrow(emit_runs, "hash long, doc_id long")
    runs = stored(found.groupBy("hash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("hash"), "op8r")
    seen = bitmap(runs)
    dropped(runs)

    def emit_windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.open()
        for ids, part, w in batches_of(it):
            least = window_minima(w.windows(run), window - run + 1)
            at = inside(w, len(least), window)
            at = at[known.has(least[at])]
            of = w.of[at]
            check = (w.windows(window, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield frame(hash=signed(w.windows(window)[at]), check=check, doc_id=ids[of], part=part[of], at=(at - w.first[of]).astype(np.int32))

    windows = docs.mapInArrow(emit_windows, "hash long, check int, doc_id long, part long, at int")
    counts = windows.groupBy("hash", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    repeated = stored(counts.where("least < most").select("hash", "check", "least"), "op8w")
    hits = windows.join(repeated, ["hash", "check"]).where("least < doc_id").select("doc_id", "part", "at")
    hits = hits.groupBy("doc_id", "part").agg(F.collect_list("at").alias("at"), F.lit(False).alias("copy"))

    later = parts.of(copies.where("first < doc_id"))
    later = later.select("doc_id", "part", F.lit(None).cast("array<int>").alias("at"), F.lit(True).alias("copy"))
    out = hits.unionByName(later).groupBy("doc_id", "part").agg(F.max_by("at", F.size("at")).alias("at"), F.max("copy").alias("copy"))
    out = stored(out, "op8")
    dropped(copies, repeated)
    return out


def intervals(at: np.ndarray, length: int) -> np.ndarray:
    """Sorted window starts merged into maximal intervals [start, end)."""
    if not len(at):
        return np.zeros((0, 2), np.int64)
    at = np.unique(at).astype(np.int64)
    new = np.r_[True, at[1:] > at[:-1] + length]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
    return np.column_stack([at[new], at[last] + length])


def rows_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))


def kept_words(text: bytes, at, copy: bool, window: int) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept words joined by spaces."""
    words = text.split()
    keep = np.full(len(words), not copy or len(words) < window)
    if at is not None:
        for a, b in intervals(np.asarray(at), window):
            keep[a:b] = False
    removed = len(words) - int(keep.sum())
    return len(words), removed, b" ".join(words if not removed else [w for w, k in zip(words, keep.tolist(), strict=True) if k])


def window_digests(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    tuned(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text, at, copy in zip(b.column("text"), b.column("at"), b.column("copy"), strict=True):
                n, removed, kept = kept_words(utf8(text.as_py()), at.values if at.is_valid else None, copy.as_py() is True, window)
                rows.append((n, removed, hashlib.sha256(kept).hexdigest()))
            n, removed, kept = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = rows_of(docs)
    marked = with_marks(rows, repeated_windows(rows, window), F.col("doc_id"), F.col("h")).select("doc_id", "text", "at", "copy")
    return marked.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` with the repeated words cut out of ``text``; other columns stay.

    Texts without a repeated window stay as they are; a cut text is its kept
    words joined by spaces, and ``n_chars``, if there, is its new length.
    """
    tuned(docs.sparkSession)
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own = dict(zip(schema.names, b.column("row").flatten(), strict=True))
            text = []
            for t, at, copy in zip(own["text"].to_pylist(), b.column("at"), b.column("copy").to_pylist(), strict=True):
                if t is not None and (at.is_valid or copy):
                    t = kept_words(utf8(t), at.values if at.is_valid else None, bool(copy), window)[2].decode("utf-8", "replace")
                text.append(t)
            columns = [pa.array(text, pa.string()) if c == "text" else own[c] for c in schema.names]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    marks = repeated_windows(rows_of(docs), window)
    # The row as one struct: its columns may have any names.
    rows = docs.select(F.struct("*").alias("row"))
    marked = with_marks(rows, marks, F.col("row.doc_id").cast("long"), F.xxhash64("row.text")).select("row", "at", "copy")
    out = marked.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(schema["n_chars"].dataType))
    return out


def op8_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_digests(table(spark, sf_dir, "documents", "doc_id", "text"))
