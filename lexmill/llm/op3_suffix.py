"""Substring dedup at byte level by difference-cover suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it starts anywhere else too.

1. Every such string (window) has an anchor: the run of ``GRAM`` bytes in it with the
   least hash, the leftmost of equals. Equal windows have equal anchors at equal
   offsets, so the anchors deal all suffixes into independent classes. Windows whose
   anchor occurs once have no equal; anchors (about one for 69 bytes) are counted,
   and the repeated ones go into a bitmap.
2. Neighbouring windows with one anchor form a context. Equal contexts are one from
   the start: what occurs twice is repeated whole. Only classes with different
   contexts have to be sorted.
3. The contexts of some classes are one task's text. Its suffix array is built by the
   difference-cover method: the triples at positions 1 and 2 modulo 3 are sorted and
   named, the string of names is sorted by recursion, and the suffixes at positions 0
   modulo 3 are merged in by their first byte and the rank that follows. Adjacent
   window suffixes are then compared over ``LENGTH`` bytes.
4. Marks go back from contexts to all their occurrences, and merge into maximal spans.

A class with more than ``MOST_CONTEXTS`` different contexts (a line with very many
different surroundings) is not given to one task: each of its windows becomes a
context of its own, and counting alone decides, exactly.

Texts are UTF-8. A null text is empty; texts shorter than a window lose nothing.
Repeated rows are copies of one another and lose everything a window covers. Rows with
null ids, or with one id and different texts, are judged apart, as any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, mix64, stored, table, tuned, utf8
from ._hashes import batches, grams, window_minima
from ._repeats import NO_ID, Parts, bitmap, copies_of, has_ids, hashed_ids, ids_of, signed, with_marks

LENGTH, GRAM = 200, 64
MOST_CONTEXTS = 2_000
#: Bytes of contexts that one task sorts, about.
SORTED_BYTES = 1_500_000


def leftmost_minima(x: np.ndarray, w: int) -> np.ndarray:
    """The position of the least upper half of every w consecutive values, the leftmost of equals.

    The position stands in the lower half, so that one minimum gives both.
    """
    low = np.uint64(32)
    return (window_minima(x >> low << low | np.arange(len(x), dtype=np.uint64), w) & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Contexts:
    """The contexts of several texts: text, first window, number of windows, class and key of each."""

    def __init__(self, texts: list[bytes], length: int, gram: int) -> None:
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.length = length
        sizes = np.array([len(t) for t in texts])
        self.base = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
        of = np.repeat(np.arange(len(texts)), sizes)
        h = grams(self.data, gram)
        anchor = leftmost_minima(h, length - gram + 1)
        ok = of[: len(anchor)] == of[length - 1 :] if len(anchor) else np.zeros(0, bool)
        at = np.flatnonzero(ok)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (of[at[1:]] != of[at[:-1]])
        first = np.flatnonzero(new)
        self.start = at[first]
        self.windows = np.diff(np.r_[first, len(at)])
        self.of = of[self.start]
        self.h = h[anchor[self.start]]
        self.offset = (anchor[self.start] - self.start).astype(np.uint64)

    def only(self, keep: np.ndarray) -> None:
        for c in ("start", "windows", "of", "h", "offset"):
            setattr(self, c, getattr(self, c)[keep])

    def split(self, hot: np.ndarray) -> None:
        """Make every window of the contexts picked a context and a class of its own."""
        n = np.where(hot, self.windows, 1)
        row = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        own = hot[row]
        self.start, self.of, self.offset = self.start[row] + step, self.of[row], self.offset[row] - step.astype(np.uint64)
        self.windows = np.where(own, 1, self.windows[row])
        self.h = self.h[row]
        key = self.keys()
        self.h = np.where(own, mix64(key ^ np.uint64(0x5851F42D4C957F2D)), self.h)

    def keys(self) -> np.ndarray:
        """A hash of the whole context and of where the anchor is in it."""
        raw = memoryview(self.raw)
        ends = (self.start + self.windows + self.length - 1).tolist()
        seeds = (self.offset.astype(np.int64) << 10 | self.windows).tolist()
        hashes = (xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b, seed in zip(self.start.tolist(), ends, seeds, strict=True))
        return np.fromiter(hashes, np.uint64, len(ends))

    def text(self, k: int) -> bytes:
        return self.raw[self.start[k] : self.start[k] + self.windows[k] + self.length - 1]


def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """The suffix array of positive integers up to ``top``, by the difference cover {1, 2} modulo 3.

    Triples are sorted and named as numbers; the merge is done by counting, for each
    suffix of one kind, those of the other that come before it.
    """
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.zeros(n + 3, np.int64)
    t[:n] = s
    # With a first position beyond the end, if needed, so that every position 0 has a sampled one after it.
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.r_[one, two]
    pair = t[sample] * (top + 1) + t[sample + 1]
    if (top + 1) ** 3 < 1 << 62:
        order = np.argsort(pair * (top + 1) + t[sample + 2], kind="stable")
    else:
        order = np.lexsort((t[sample + 2], pair))
    a = sample[order]
    new = np.ones(len(a), bool)
    new[1:] = (t[a[1:]] != t[a[:-1]]) | (t[a[1:] + 1] != t[a[:-1] + 1]) | (t[a[1:] + 2] != t[a[:-1] + 2])
    names = np.cumsum(new)
    if names[-1] < len(sample):
        named = np.empty(len(sample), np.int64)
        named[order] = names
        a = sample[suffix_array(named, int(names[-1]))]
    rank = np.zeros(n + 3, np.int64)
    rank[a] = np.arange(1, len(a) + 1)
    a = a[a < n]
    wide = np.int64(n + 3)

    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(t[zero] * wide + rank[zero + 1], kind="stable")]
    a1, a2 = a[a % 3 == 1], a[a % 3 == 2]

    def with_one(i: np.ndarray) -> np.ndarray:
        return t[i] * wide + rank[i + 1]

    def with_two(i: np.ndarray) -> np.ndarray:
        return heads[i] * wide + rank[i + 2]

    heads = t[: n + 1] * (top + 1) + t[1 : n + 2]
    if int(top + 1) ** 2 * int(wide) >= 1 << 62:
        heads = np.unique(heads, return_inverse=True)[1].astype(np.int64)
    k0, k1, k2 = with_one(zero), with_one(a1), with_two(a2)
    z2 = with_two(zero)
    place = np.empty(n, np.int64)
    place[zero] = np.arange(len(zero)) + np.searchsorted(k1, k0) + np.searchsorted(k2, z2)
    own = np.arange(len(a))
    place[a1] = own[a % 3 == 1] + np.searchsorted(k0, k1)
    place[a2] = own[a % 3 == 2] + np.searchsorted(z2, k2)
    out = np.empty(n, np.int64)
    out[place] = np.arange(n)
    return out


def repeated_starts(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, which of its windows start in another place of these texts too."""
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    s = data.astype(np.int64) + 2
    sizes = np.array([len(t) + 1 for t in texts])
    stops = np.cumsum(sizes)
    s[stops - 1] = 1  # the ends of texts
    room = np.repeat(stops - 1, sizes) - np.arange(len(s))
    sa = suffix_array(s, 257)
    sa = sa[room[sa] >= length]
    hit = np.zeros(len(s), bool)
    for i in range(0, max(0, len(sa) - 1), 20_000):
        a, b = sa[i : i + 20_000], sa[i + 1 : i + 20_001]
        a = a[: len(b)]
        same = data[a + length - 1] == data[b + length - 1]
        a, b = a[same], b[same]
        if len(a):
            view = np.lib.stride_tricks.sliding_window_view(data, length)
            same = (view[a] == view[b]).all(axis=1)
            hit[a[same]] = hit[b[same]] = True
    return [hit[e - n : max(e - n, e - length)] for e, n in zip(stops.tolist(), sizes.tolist(), strict=True)]


def ranges(flags: np.ndarray) -> np.ndarray:
    """The runs of true values as flat pairs of start and end."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view(np.int8), 0]))
    return edge.astype(np.int32)


def frame(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, part, ``at`` (flat pairs: first and one past the last repeated window), and ``copied`` of rows that have any.

    ``docs``: doc_id, text, h, none null. A copied text has an equal one elsewhere.
    """
    long_enough = docs.where(F.octet_length("text") >= length)
    copies = copies_of(long_enough)
    parts, firsts = Parts(copies), hashed_ids(copies.where("doc_id = first"), "doc_id")
    first_ids = bitmap(firsts)
    dropped(firsts)

    def contexts_of(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, Contexts]]:
        """Ids, parts and contexts of the first copies; that a few later ones may be among them changes nothing."""
        known, part_of = first_ids.open(), parts.reader()
        for b in it:
            b = b.filter(pa.array(has_ids(known, ids_of(b.column("doc_id")))))
            ids = ids_of(b.column("doc_id"))
            part = part_of(ids, ids_of(b.column("h")))
            for first, texts in batches([utf8(t) for t in b.column("text").to_pylist()]):
                yield ids[first:], part[first:], Contexts(texts, length, gram)

    def emit_anchors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, c in contexts_of(it):
            h, n = np.unique(c.h, return_counts=True)
            yield frame(hash=signed(h), n=n)

    anchors = long_enough.mapInArrow(emit_anchors, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    anchors = stored(anchors, "op3a")
    seen = bitmap(anchors)
    dropped(anchors)

    def split_at(hot):
        """In a task: the contexts of repeated anchors, those of hot classes as single windows."""
        known, own = seen.open(), hot.open() if hot else None

        def run(c: Contexts) -> Contexts:
            c.only(known.has(c.h))
            if own is not None:
                c.split(own.has(mix64(c.h)))
            return c

        return run

    def occurrences(hot) -> DataFrame:
        def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            split = split_at(hot)
            for ids, part, c in contexts_of(it):
                c = split(c)
                yield frame(
                    h=signed(c.h), key=signed(c.keys()), doc_id=ids[c.of], part=part[c.of], start=(c.start - c.base[c.of]).astype(np.int32), windows=c.windows.astype(np.int32)
                )

        return stored(long_enough.mapInArrow(emit, "h long, key long, doc_id long, part long, start int, windows int"), "op3o")

    def distinct(occ: DataFrame) -> DataFrame:
        return stored(occ.groupBy("h", "key").agg(F.count("*").alias("n"), F.first("windows").alias("windows")), "op3d")

    hot = None
    occ = occurrences(None)
    ctx = distinct(occ)
    large = hashed_ids(ctx.groupBy("h").agg(F.count("*").alias("m")).where(F.col("m") > MOST_CONTEXTS), "h")
    if not large.isEmpty():
        hot = bitmap(large)
        dropped(occ, ctx)
        occ = occurrences(hot)
        ctx = distinct(occ)
    dropped(large)

    mixed = ctx.groupBy("h").agg(F.count("*").alias("m")).where("m > 1").select("h")
    need = stored(ctx.join(mixed, "h", "left_semi").select("h", "key", "windows"), "op3n")
    size = need.agg(F.coalesce(F.sum(F.col("windows") + length), F.lit(0))).first()[0]
    groups = max(1, -(-int(size) // SORTED_BYTES))
    keys = hashed_ids(need, "key")
    wanted = bitmap(keys)
    dropped(keys)

    def emit_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known = split_at(hot), wanted.open()
        for _, _, c in contexts_of(it):
            c = split(c)
            key = c.keys()
            # Only the first of equal contexts of these texts.
            pick = np.flatnonzero(has_ids(known, signed(key)))
            pick = pick[np.unique(key[pick], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(c.h[pick])), pa.array(signed(key[pick])), pa.array([c.text(k) for k in pick.tolist()], pa.binary())], ["h", "key", "text"]
            )

    found = long_enough.mapInArrow(emit_texts, "h long, key long, text binary")
    found = found.join(need.select("h", "key"), ["h", "key"], "left_semi").groupBy("h", "key").agg(F.min("text").alias("text"))

    def sort(pdf: pd.DataFrame) -> pd.DataFrame:
        marks = [ranges(f) for f in repeated_starts(pdf["text"].tolist(), length)]
        pdf = pdf.assign(at=marks)[["h", "key", "at"]]
        return pdf[[len(m) > 0 for m in marks]]

    marked = found.withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups))).groupBy("g").applyInPandas(sort, "h long, key long, at array<int>")
    marked = stored(marked, "op3m")
    dropped(need)
    whole = ctx.where("n > 1").select("h", "key", F.array(F.lit(0), F.col("windows")).alias("at"))
    partly = marked.join(whole, ["h", "key"], "left_anti").select("h", "key", "at")
    spans = stored(whole.unionByName(partly), "op3s")
    dropped(ctx, marked)
    hits = occ.join(spans, ["h", "key"]).select("doc_id", "part", F.transform("at", lambda x: x + F.col("start")).alias("at"))
    hits = hits.groupBy("doc_id", "part").agg(F.flatten(F.collect_list("at")).alias("at"), F.lit(False).alias("copied"))
    again = parts.of(copies.where("n > 1")).select("doc_id", "part", F.lit(None).cast("array<int>").alias("at"), F.lit(True).alias("copied"))
    out = stored(hits.unionByName(again).groupBy("doc_id", "part").agg(F.max_by("at", F.size("at")).alias("at"), F.max("copied").alias("copied")), "op3")
    dropped(occ, spans, copies)
    return out


def kept_bytes(text: bytes, at, copied: bool, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, removed spans, and what is left."""
    n = len(text)
    if copied and n >= length:
        return n, 1, b""
    if at is None or not len(at):
        return 0, 0, text
    pairs = np.asarray(at, np.int64).reshape(-1, 2)
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, np.minimum(pairs[:, 1] + length - 1, n), -1)
    gone = np.cumsum(step[:n]) > 0
    spans = int((np.diff(np.r_[0, gone.view(np.int8)]) == 1).sum())
    return int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()


def byte_dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    tuned(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("own"), F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for text, at, copied in zip(b.column("text"), b.column("at"), b.column("copied"), strict=True):
                raw = utf8(text.as_py())
                removed, spans, kept = kept_bytes(raw, at.values.to_numpy() if at.is_valid else None, copied.as_py() is True, length)
                out.append((len(raw), removed, spans, hashlib.sha256(kept).hexdigest()))
            n, removed, spans, kept = zip(*out, strict=True) if out else ((), (), (), ())
            columns = [b.column("own"), *(pa.array(c, pa.int64()) for c in (n, removed, spans)), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    marked = with_marks(rows, repeated_spans(rows.drop("own"), length), F.col("doc_id"), F.col("h")).select("own", "text", "at", "copied")
    return marked.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
