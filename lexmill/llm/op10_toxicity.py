"""Toxicity by compression distance: two trained zstandard dictionaries and calibrated windows.

Both dictionaries begin with the commonest words of ordinary text, so that what is
common costs the same under either. What follows is trained by zstandard (its COVER
trainer) on contrasting text: the toxic one on words that are in at least ``LIFT``
times as many toxic texts as their texts' lengths let expect, with so much evidence
that about ``CHANCE`` of all words have it by chance, each as often as toxic texts
have it; the ordinary one on as much of the words that are in significantly fewer.
Near copies, told by the least hash of their runs of words, count as one text: the
words of one toxic text with many near copies are not toxic words. The trainer
keeps the pieces that these words share, so it also knows forms of a word that it
has not seen. All labelled texts are counted, in Spark.

Every window of eight words (half overlapping) is compressed with each dictionary;
what the toxic one saves, in bytes, is the window's difference. The features are the
shares of a text's windows whose difference is beyond each of three thresholds, drawn
to the shares of ordinary texts as if ``PRIOR`` of their windows were added. Shares do
not rise with the length of a text, as its largest differences do. A logistic
model turns their logarithms into a score from 0 to 1. It is calibrated by
cross-fitting: the texts of each of ``FOLDS`` folds are measured with dictionaries
of the others, and so are new to them; near copies are in one fold. A score of 0.5 is not a probability but the
point where most toxic texts of these folds are at or above it while at most
``CLEAN_LOSS`` of the ordinary ones are.

The dictionaries learn from every distinct labelled text, of any length, except
rows whose crc32(doc_id) mod 5 is 0, which are never used; a text with both labels
is toxic, and one repeated in one doc_id counts as often as it is repeated. The
four weights are fitted on at most ``MAX_TRAIN`` of these texts, drawn by a hash.
All settings were chosen by the same cross-fitting, without the rows left out
(``op10_measure.py``). Every text is scored whole. Inputs are the texts alone.

A null or empty text has no windows and gets the score of ordinary shares. A null
doc_id is no held-out one, and has no label. Without labelled rows of both kinds every
score is 0. Repeated rows give repeated results; an empty table gives none.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let
from ._common import dropped, held_out_column, stored, table, trimmed, tuned
from ._repeats import bitmap, has_ids, hashed_ids, ids_of

MAX_TRAIN, FOLDS, CLEAN_LOSS = 6_000, 4, 0.02
WORDS, STEP, LEVEL = 8, 4, 9
#: Words both dictionaries share; words that may be the toxic one's own by chance; significance of the ordinary one's (in standard deviations); most own words.
COMMON, CHANCE, SELDOM, MOST_OWN = 1500, 10, -1.5, 1500
#: Own words are in so many times as many toxic texts as expected (the ordinary one's: so many times fewer), however many texts there are.
LIFT = 2
#: Words of a run whose least hash tells near copies; one word in so many begins runs.
RUN, BEGIN = 5, 8
#: Bytes of a trained dictionary, of its segments, of what the trainer counts; words it sees.
TRAINED, SEGMENT, UNIT, SAMPLES = 8192, 24, 6, 4_000
#: Weight of the texts a word must be in; in fewer it is never significant.
LEAST_TEXTS = 4
#: Differences whose shares count; windows of ordinary text added to each; least share told apart.
BEYOND, PRIOR, LEAST_SHARE = (1, 3, 5), 5, 1e-3


def sketch() -> F.Column:
    """The least hash of the text's runs of ``RUN`` words, of those that begin with one of a hashed part of all words; near copies nearly always share it."""
    words = F.split("text", r"(?U)\s+")
    runs = let(words, lambda w: F.transform(w, lambda x, i: F.when(F.pmod(F.hash(x), F.lit(BEGIN)) == 0, F.xxhash64(F.slice(w, i + 1, RUN)))))
    return F.coalesce(F.array_min(runs), F.xxhash64("text"))


def only(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id and text of the rows whose doc_id a bitmap of ``chosen`` has: all of these, and few others."""
    hashed = hashed_ids(chosen, "doc_id")
    ids = bitmap(hashed)
    dropped(hashed)

    def known(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ids.open()
        for b in it:
            yield b.filter(pa.array(has_ids(own, ids_of(b.column("doc_id")))))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return texts.mapInArrow(lambda it: trimmed(known(it)), "doc_id long, text string")


def training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h, toxic, stratum (of length), sketch and weight of every distinct labelled text: one row each, without the text. Texts of one sketch weigh one together."""
    known = labels.where(~held_out_column() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = stored(known, "op10k")
    texts = only(docs.where(F.length("text") >= 1), known)
    texts = texts.select("doc_id", F.xxhash64("text").alias("h"), F.floor(F.log2(F.length("text"))).cast("int").alias("stratum"), sketch().alias("sketch"))
    distinct = texts.join(known.hint("merge"), "doc_id").groupBy("h").agg(
        F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.max("toxic").alias("toxic"), F.min("stratum").alias("stratum"), F.min("sketch").alias("sketch")
    )
    distinct = stored(distinct, "op10d")
    alike = distinct.groupBy("sketch").agg((1 / F.count("*")).alias("weight"))
    out = stored(distinct.join(alike.hint("merge"), "sketch"), "op10t")
    dropped(known, distinct)
    return out


def with_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` with the texts; only rows whose doc_id a bitmap has are shuffled."""
    texts = only(docs, chosen).withColumn("h", F.xxhash64("text"))
    # The same join at every size.
    return texts.join(chosen.hint("merge"), ["doc_id", "h"])


def fold() -> F.Column:
    """Near copies are in one fold."""
    return F.pmod(F.col("sketch"), F.lit(FOLDS))


def word_counts(docs: DataFrame, chosen: DataFrame, rates: dict[int, float]) -> DataFrame:
    """Sums of each word, over the texts of each fold that have it: the weight of ordinary and toxic ones (``n``, ``t``), the difference of toxic and expected ones (``d``) and its variance (``v``)."""
    expected = F.element_at(F.create_map(*[F.lit(x) for r in rates.items() for x in r]), F.col("stratum"))
    rows = with_text(docs, chosen).select(fold().alias("fold"), "toxic", "weight", expected.alias("e"), F.explode(F.array_distinct(F.split("text", r"(?U)\s+"))).alias("word"))
    columns = (("d", F.col("toxic") - F.col("e")), ("v", F.col("e") * (1 - F.col("e"))), ("t", F.col("toxic")), ("n", 1 - F.col("toxic")))
    sums = [F.sum(F.when(F.col("fold") == k, x * F.col("weight"))).alias(f"{c}{k}") for k in range(FOLDS) for c, x in columns]
    counts = rows.where("word <> ''").groupBy("word").agg(F.sum("weight").alias("texts"), *sums).where(F.round("texts", 6) >= LEAST_TEXTS)
    return stored(counts.select("word", *(F.coalesce(f"{c}{k}", F.lit(0.0)).alias(f"{c}{k}") for k in range(FOLDS) for c, _ in columns)), "op10w")


def without_fold(words: DataFrame, left_out: int) -> DataFrame:
    """Of each word: the weight of ordinary and toxic texts that have it (``n``, ``t``), of the toxic ones expected (``e``), its significance ``z`` and evidence ``s``, without one fold (the last: in all).

    Significance and evidence are those of the toxic texts with the word against
    what the toxic shares of texts of their lengths let expect. By chance, about one word in
    exp(s) has evidence of s or more.
    """
    sums = words.select("word", *(F.round(sum((F.col(f"{c}{k}") for k in range(FOLDS) if k != left_out), F.lit(0.0)), 6).alias(c) for c in "dvtn"))
    t, e = F.col("t"), F.col("t") - F.col("d")
    evidence = F.when((t > 0) & (e > 0), t * F.log(t / e)).otherwise(0.0) - (t - e)
    # Rounded, so that the order of the sums does not matter.
    return sums.select("word", "n", "t", e.alias("e"), F.round(F.col("d") / F.sqrt(F.col("v") + 1), 6).alias("z"), F.round(evidence, 6).alias("s"))


def first_words(words: DataFrame, *order, most: int, count: str) -> list[tuple[str, int]]:
    """The first words in an order, each with a count; at most ``most``."""
    return [(r["word"], round(r[count])) for r in words.orderBy(*order, "word").limit(most).select("word", count).collect()]


def trained(words: list[tuple[str, int]], samples: int) -> bytes:
    """What zstandard's trainer makes of words, each as often as its count says of ``samples`` in all, in an order by hash."""
    total = sum(n for _, n in words) or 1
    seen = [(zlib.crc32(f"{w} {k}".encode("utf-8", "replace")), w) for w, n in words for k in range(max(1, round(n * samples / total)))]
    texts = [f" {w} ".encode("utf-8", "replace") for _, w in sorted(seen)]
    try:
        out = zstandard.train_dictionary(TRAINED, texts, k=SEGMENT, d=UNIT, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        out = b""
    # From a few words the trainer makes tables and no content: then all of them are the content.
    most = max(words, key=lambda w: w[1])[0].encode("utf-8", "replace")
    return out if most in out else b"".join(dict.fromkeys(texts))


def dictionaries(words: DataFrame, common: list[str], left_out: int, least: float, most: int = MOST_OWN) -> tuple[bytes, bytes, int]:
    """The contents of the ordinary and of the toxic dictionary, and how many words (of that evidence at least) the toxic one was trained on."""
    words = without_fold(words, left_out)
    own = first_words(words.where((F.col("s") >= least) & (F.col("t") >= LIFT * F.col("e"))), F.col("z").desc(), most=most, count="t")
    other = first_words(words.where((F.col("z") <= SELDOM) & (LIFT * F.col("t") <= F.col("e"))), F.col("z"), most=len(own), count="n") if own else []
    left = {w for w, _ in own}
    shared = [w for w in common if w not in left][:COMMON]
    # The best last: near the window, where matches cost least.
    start = (" " + " ".join(shared[::-1]) + " ").encode("utf-8", "replace")
    samples = min(SAMPLES, *(sum(n for _, n in x) for x in (other or own, own)))
    return *(start + trained(x, samples) if x else start for x in (other, own)), len(own)


def compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=level)
    return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False)


def windowing() -> tuple[int, int, int, tuple[int, ...]]:
    """The settings of windows, told to the tasks as they are in the driver."""
    return WORDS, STEP, LEVEL, BEYOND


class Distance:
    """The differences of a text under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes, how: tuple[int, int, int, tuple[int, ...]]) -> None:
        self.words, self.step, level, self.beyond = how
        self.ordinary, self.toxic = compressor(ordinary, level), compressor(toxic, level)

    def counts(self, text: str | None) -> tuple[int, ...]:
        """How many windows there are, and how many beyond each threshold."""
        w = (text or "").split()
        saved = []
        for i in range(0, max(1, len(w) - self.words + self.step) if w else 0, self.step):
            x = (" " + " ".join(w[i : i + self.words]) + " ").encode("utf-8", "replace")
            saved.append(len(self.ordinary.compress(x)) - len(self.toxic.compress(x)))
        return len(saved), *(sum(s >= least for s in saved) for least in self.beyond)


def base_shares(counts: np.ndarray) -> np.ndarray:
    """Shares of all windows of ordinary texts beyond each threshold."""
    total = counts.sum(axis=0)
    return total[1:] / max(1, total[0])


def features(counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    return np.log((counts[:, 1:] + PRIOR * base) / (counts[:, :1] + PRIOR) + LEAST_SHARE)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic model by Newton steps; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def operating_point(x: np.ndarray, y: np.ndarray) -> float:
    """Below the least toxic value that at most CLEAN_LOSS of the ordinary values reach, halfway to the next one."""
    clean = np.sort(x[y == 0])
    reached = len(clean) - np.searchsorted(clean, x, "left")
    good = x[(y == 1) & (reached <= CLEAN_LOSS * len(clean))]
    if not len(good):
        return float(x.max()) + 1
    least = good.min()
    below = x[x < least]
    return float(least + below.max()) / 2 if len(below) else float(least)


class Model:
    """What a fit needs and makes: the training texts, word counts, dictionaries of the folds; out-of-fold counts and labels."""

    def __init__(self, docs: DataFrame, labels: DataFrame) -> None:
        self.final = None
        chosen = training_texts(docs, labels)
        # One row for each power of two.
        strata = {r["stratum"]: (r["toxic"], r["n"]) for r in chosen.groupBy("stratum").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).collect()}
        toxic, total = (sum(x) for x in zip(*strata.values(), strict=True)) if strata else (0, 0)
        if not 0 < toxic < total:
            return
        rates = {k: (t + toxic / total) / (n + 1) for k, (t, n) in strata.items()}
        words = word_counts(docs, chosen, rates)
        common = [w for w, _ in first_words(without_fold(words, FOLDS), F.col("n").desc(), most=COMMON + MOST_OWN, count="n")]
        least = math.log(max(1, words.count() / CHANCE))
        parts = [dictionaries(words, common, k, least) for k in range(FOLDS)]
        # No larger than those that are calibrated: larger ones would save more on any text.
        self.final = dictionaries(words, common, FOLDS, least, max(m for _, _, m in parts))[:2]

        how = windowing()

        def measure(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            distances = [Distance(a, b, how) for a, b, _ in parts]
            for b in it:
                counts = [distances[k].counts(t) for k, t in zip(b["fold"], b["text"], strict=True)]
                yield pd.DataFrame({"h": b["h"], "toxic": b["toxic"], "counts": counts})

        drawn = stored(chosen.orderBy("h").limit(MAX_TRAIN), "op10s")
        sample = with_text(docs, drawn).select("h", "toxic", fold().cast("int").alias("fold"), "text")
        rows = sorted((r["h"], r["toxic"], r["counts"]) for r in sample.mapInPandas(lambda it: trimmed(measure(it)), "h long, toxic int, counts array<long>").collect())
        dropped(chosen, words, drawn)
        self.y = np.array([t for _, t, _ in rows], float)
        counts = np.array([c for _, _, c in rows], float)
        self.base = base_shares(counts[self.y == 0])
        self.x = features(counts, self.base)
        self.w = logistic(self.x, self.y)
        self.values = self.x @ self.w[:-1] + self.w[-1]


def fit(docs: DataFrame, labels: DataFrame) -> tuple | None:
    """Dictionaries, settings of windows, ordinary shares and weights; None without labelled texts of both kinds."""
    m = Model(docs, labels)
    if m.final is None:
        return None
    w = m.w.copy()
    w[-1] -= operating_point(m.values, m.y)
    return *m.final, windowing(), m.base.tolist(), w.tolist()


def score(model, texts: list[str | None]) -> np.ndarray:
    """The score of each text under a model as ``fit`` returns it."""
    if model is None:
        return np.zeros(len(texts))
    d, base, w = Distance(*model[:3]), np.array(model[3]), np.array(model[4])
    x = features(np.array([d.counts(t) for t in texts], float).reshape(-1, 1 + len(d.beyond)), base)
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    tuned(docs.sparkSession)
    model = fit(docs, labels)  # a few ten thousand bytes

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            s = score(model, b.column("text").to_pylist())
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(held_out_column(), F.lit(False)).alias("held_out")
    cols = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held)
    return cols.mapInArrow(lambda it: trimmed(run(it)), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text scores below 0.5; all columns stay as they are."""
    tuned(docs.sparkSession)
    model = fit(docs, labels)
    schema = docs.schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(score(model, b.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(lambda it: trimmed(run(it)), schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
