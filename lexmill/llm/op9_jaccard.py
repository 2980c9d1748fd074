"""Jaccard join of shingle sets by token-combination prefixes.

Tokens are 64-bit hashes of word shingles; their global order is that of the hashes.

1. Equal sets are one class, which one row stands for.
2. A set of n tokens may lack at most ``miss = n - ceil(t n)`` of them in a
   partner. Its prefix is its first ``miss + extra`` tokens, so that two linked
   sets share at least ``extra`` prefix tokens (all they can, if shorter). Tokens in
   two to ``RARE`` prefixes are rare, those in more are frequent.
3. Rare tokens are indexed on their own. A pair that shares some is a candidate if
   the rare tokens it shares and the frequent ones it may share can reach that number.
4. A linked pair that shares no rare token has as many frequent ones in both
   prefixes. For such sets the prefix is extended to ``k (h + 1)`` tokens, where
   h is the most by which two linked sets can differ, and every combination of k
   consecutive tokens in it is indexed: at most h tokens of either set break the
   shared tokens into h + 1 runs, one of which must be k long. Sets that
   share a combination meet over a star for each combination: no pairs are made.
5. What candidate pairs and stars connect is a block. A block of up to ``TILE`` sets
   is compared whole, in one task. Of a larger one first each candidate pair is
   verified, and each set with that centre of its stars with which it shares most
   combinations. Then only those sets of a star are left that are not yet with its
   most: they are compared with all others of the stars they are connected by, tile
   against tile. Every comparison is of whole sets; tasks return spanning forests.
6. Components of the links are the result.

Pairs are made only of at most ``RARE`` sets at a time; no task grows with a block.
The bitmaps that are broadcast have a fixed largest size and may only let too much
through.

Nulls and repeats: a null or empty text, or one without words, has no shingles and is
linked with nothing. A text with fewer words than a shingle has one shingle, all its
words. Repeated rows are equal sets; so are rows with one doc_id and equal texts, while
those with different texts are judged apart. A row with a null doc_id links as any
other, but is nobody's smallest doc_id: its component_id is that of the others, or null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, mix64, stored, table, trimmed, tuned, utf8
from ._components import components, forest
from ._hashes import Words, batches, windows
from ._repeats import Known, bitmap, has_ids, hashed_ids, ids_of, signed

EXTRA, RARE, TILE = 16, 32, 512
#: Bytes of sets that one task compares, about, and bytes of a tile.
TASK_BYTES, TILE_BYTES = 4 << 20, 2 << 20
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Limits:
    """The numbers that follow from the threshold, exact as fractions."""

    def __init__(self, percent: int) -> None:
        self.t, self.percent = Fraction(percent, 100), percent
        self.k = max(1, min(4, int(Fraction(9, 10) * self.t / (1 - self.t))))
        sizes = range(1, 200)
        short = [n for n in sizes if self.differ(n) >= 1 and self.k * (self.differ(n) + 1) > n]
        #: Up to this size a set, or a partner of it, may be too short for combinations of k.
        self.short = math.floor(max(short, default=0) / self.t)

    def miss(self, n: int) -> int:
        return n - math.ceil(self.t * n)

    def differ(self, n: int) -> int:
        """Most tokens that are in just one of two linked sets, one of which has n."""
        return math.floor((1 - self.t) * n / self.t)

    def extra(self, n: int) -> int:
        """By how many tokens the prefix is longer than what may be missing: in proportion, for long sets."""
        return max(EXTRA, self.miss(n) * min(10, 100 - self.percent) // max(1, 100 - self.percent))

    def prefix(self, n: int) -> int:
        return min(n, self.miss(n) + self.extra(n))

    def shared(self, n: int) -> int:
        """Least number of prefix tokens that a linked partner shares."""
        return self.prefix(n) - self.miss(n)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    for _, some in batches(texts):
        w = Words([t.translate(LOWER) for t in some])
        x = w.windows(k)
        inside = w.of[: len(x)] == w.of[k - 1 :] if len(x) else np.zeros(0, bool)
        of, x = w.of[: len(x)][inside], x[inside]
        short = np.flatnonzero((w.counts > 0) & (w.counts < k))
        if len(short):
            whole = [mix64(windows(w.values[0][w.first[i] : w.first[i + 1]], int(w.counts[i])) + np.uint64(w.counts[i])) for i in short]
            of, x = np.r_[of, short], np.concatenate([x, *whole])
        order = np.lexsort((x, of))
        of, x = of[order], x[order]
        first = np.ones(len(x), bool)
        first[1:] = (of[1:] != of[:-1]) | (x[1:] != x[:-1])
        yield from np.split(x[first], np.cumsum(np.bincount(of[first], minlength=len(some)))[:-1])


def digests(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, by two sums of bijections of its tokens."""
    d = signed(np.array([s.sum(dtype=np.uint64), mix64(s ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], np.uint64))
    return int(d[0]), int(d[1])


def batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names.split())


def sets_of(docs: DataFrame, words: int, limits: Limits) -> DataFrame:
    """doc_id, h, n, a 128-bit digest of the set, and its prefix, of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for s in shingle_sets([utf8(t) for t in b.column("text").to_pylist()], words):
                rows.append((len(s), *digests(s), s[: limits.prefix(len(s))].tobytes()))
            n, d1, d2, prefix = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield batch("doc_id h n d1 d2 prefix", b.column("doc_id"), b.column("h"), *(pa.array(c, pa.int64()) for c in (n, d1, d2)), pa.array(prefix, pa.binary()))

    return docs.mapInArrow(lambda it: trimmed(run(it)), "doc_id long, h long, n long, d1 long, d2 long, prefix binary")


def tokens_of(reps: DataFrame, seen: Known | None = None) -> DataFrame:
    """A row for each prefix token, if given only those in a bitmap."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seen.open() if seen else None
        for b in it:
            prefixes = b.column("prefix").to_pylist()
            sizes = np.array([len(p) // 8 for p in prefixes], np.int64)
            t = np.frombuffer(b"".join(prefixes), np.uint64)
            of, n = (np.repeat(ids_of(b.column(c)), sizes) for c in ("id", "n"))
            keep = known.has(t) if known else slice(None)
            yield batch("hash id n", signed(t[keep]), of[keep], n[keep])

    return reps.select("id", "n", "prefix").mapInArrow(lambda it: trimmed(run(it)), "hash long, id long, n long")


def whole_sets(docs: DataFrame, words: int, involved: DataFrame) -> DataFrame:
    """id, n and the whole set of the classes ``involved`` (id, rep, n, d1, d2; stored)."""
    ids = hashed_ids(involved, "rep")
    seen, wanted = bitmap(ids), bitmap(involved.select(F.col("d1").alias("hash")))
    dropped(ids)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own, sent = seen.open(), wanted.open(), set()
        for b in it:
            b = b.filter(pa.array(has_ids(known, ids_of(b.column("doc_id")))))
            rows = {}
            for s in shingle_sets([utf8(t) for t in b.column("text").to_pylist()], words):
                key = (len(s), *digests(s))
                if key not in sent and own.has(np.array([key[1]]).view(np.uint64))[0]:
                    rows[key] = s.tobytes()
                    sent.add(key)
            n, d1, d2 = zip(*rows, strict=True) if rows else ((), (), ())
            yield batch("n d1 d2 tokens", *(pa.array(c, pa.int64()) for c in (n, d1, d2)), pa.array([*rows.values()], pa.binary()))

    found = docs.mapInArrow(lambda it: trimmed(run(it)), "n long, d1 long, d2 long, tokens binary")
    # Dealt by what they are joined by, so that sets are moved once.
    found = found.groupBy("n", "d1", "d2").agg(F.first("tokens").alias("tokens"))
    return found.join(involved.select("id", "n", "d1", "d2"), ["n", "d1", "d2"]).select("id", "n", "tokens")


def combinations(sets: DataFrame, limits: Limits) -> DataFrame:
    """Every k consecutive tokens of the extended prefix, hashed; of short sets each token as well."""
    k, short = limits.k, limits.short

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sigs, sizes = [np.zeros(0, np.uint64)], []
            for tokens in b.column("tokens").to_pylist():
                s = np.frombuffer(tokens, np.uint64)
                own = windows(s[: k * (limits.differ(len(s)) + 1)], k)
                if len(s) <= short:
                    own = np.r_[own, mix64(s + np.uint64(1))]
                sigs.append(own)
                sizes.append(len(own))
            yield batch("sig id", signed(np.concatenate(sigs)), np.repeat(ids_of(b.column("id")), sizes))

    return sets.select("id", "tokens").mapInArrow(lambda it: trimmed(run(it)), "sig long, id long")


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """The size of the intersection of every set of a with every one of b, in column slices."""
    ta, tb = np.concatenate(a), np.concatenate(b)
    common = np.intersect1d(ta, tb)
    out = np.zeros((len(a), len(b)), np.float32)
    ra, rb = (np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (a, b))
    ca, cb = np.searchsorted(common, ta), np.searchsorted(common, tb)
    for r, c, t in ((0, ca, ta), (1, cb, tb)):
        c[c == len(common)] = 0
        ok = common[c] == t if len(common) else np.zeros(len(t), bool)
        if r == 0:
            ra, ca = ra[ok], c[ok]
        else:
            rb, cb = rb[ok], c[ok]
    oa, ob = np.argsort(ca, kind="stable"), np.argsort(cb, kind="stable")
    ra, ca, rb, cb = ra[oa], ca[oa], rb[ob], cb[ob]
    for start in range(0, len(common), columns):
        m = []
        for r, c, rows in ((ra, ca, len(a)), (rb, cb, len(b))):
            lo, hi = np.searchsorted(c, (start, start + columns))
            x = np.zeros((rows, columns), np.float32)
            x[r[lo:hi], c[lo:hi] - start] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    o = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * o >= percent * (len(a) + len(b) - o)


def verified(pairs: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Those of some pairs (a, b) that are links."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sides = zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True)
            yield b.select(["a", "b"]).filter(pa.array([linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in sides], pa.bool_()))

    ta, tb = (whole.select(F.col("id").alias(x), F.col("tokens").alias(f"t{x}")) for x in "ab")
    return pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInArrow(lambda it: trimmed(run(it)), "a long, b long")


def compared(narrow: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links between the two sides of each tile pair, as spanning forests.

    ``narrow``: block, i, j (which tile pair), side (0 and 1, or only 0: within the tile), id, n. It is
    small; the sets are joined to it once for each of its rows.
    """
    narrow = stored(narrow, "tiles")
    # Many tile pairs share a task group; their number follows the bytes.
    total = narrow.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    groups = max(1, -(-8 * int(total) // TASK_BYTES))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int]] = []
        for _, g in pdf.groupby(["block", "i", "j"], sort=False):
            side = [x for _, x in g.groupby("side")]
            sets = [[np.frombuffer(x, np.uint64) for x in s["tokens"]] for s in side]
            ids = [s["id"].to_numpy() for s in side]
            a, b = sets[0], sets[-1]
            na, nb = np.array([len(s) for s in a]), np.array([len(s) for s in b])
            o = overlaps(a, b).astype(np.int64)
            ok = (100 * o >= percent * (na[:, None] + nb[None, :] - o)) & (ids[0][:, None] != ids[-1][None, :])
            if len(side) == 1 and g["side"].iloc[0] == 0:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            found += forest(zip(ids[0][x].tolist(), ids[-1][y].tolist(), strict=True))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    t = narrow.drop("n").withColumn("g", F.pmod(F.xxhash64("block", "i", "j"), F.lit(groups))).join(whole.select("id", "tokens"), "id")
    return stored(t.groupBy("g").applyInPandas(run, "a long, b long"), "found")


def tiles(n_sets, n_tokens):
    """How many tiles so many sets with so many tokens in all make."""
    return F.greatest(F.lit(1), F.ceil(n_sets / TILE), F.ceil(8 * n_tokens / TILE_BYTES)).cast("int")


def tile_of(count):
    return F.pmod(F.xxhash64("id"), count).cast("int")


def links_in_blocks(pairs: DataFrame, stars: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links among what candidate pairs and stars connect, enough of them for the components to be right.

    ``pairs``: a, b; ``stars``: a, b (a set and a centre it shares combinations with), shared; both stored.
    """
    found = components(pairs.unionByName(stars.select("a", "b")))
    sizes = whole.select("id", "n")
    members = found.union(found.select("component", "component").distinct()).toDF("id", "block").join(sizes, "id")
    members = stored(members, "members")
    dropped(found)
    blocks = stored(members.groupBy("block").agg(F.count("*").alias("m"), F.sum("n").alias("tokens")), "blocks")
    small = members.join(blocks.where(F.col("m") <= TILE).select("block"), "block")
    small = compared(small.select("block", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "id", "n"), whole, percent)
    large = stored(members.join(blocks.where(F.col("m") > TILE).select("block"), "block").select("id", "block", "n"), "large")
    dropped(blocks, members)
    if large.isEmpty():
        return small

    # Large blocks: candidate pairs and the best centre of each set first.
    own = large.select(F.col("id").alias("a"))
    large_pairs = pairs.join(own, "a", "left_semi")
    large_stars = stored(stars.join(own, "a", "left_semi"), "stars")
    best = large_stars.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    sure = stored(verified(large_pairs.unionByName(best.select("a", "b")).distinct(), whole, percent), "sure")
    # The sets of a star that are not with most of it are compared with all of it.
    part, star = components(sure), components(large_stars.select("a", "b"))
    hot = star.union(star.select("component", "component").distinct()).toDF("id", "block")
    hot = hot.join(large.select("id", "n"), "id").join(part.toDF("id", "part"), "id", "left").withColumn("part", F.coalesce("part", "id"))
    hot = stored(hot, "hot")
    by_part = hot.groupBy("block", "part").agg(F.count("*").alias("m"))
    most = by_part.groupBy("block").agg(F.max_by("part", F.struct("m", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    hot_open = stored(hot.join(stored(most.select("block", "most"), "most"), "block").withColumn("rest", F.col("part") != F.col("most")), "open")
    rest = F.col("rest").cast("int")
    counts = hot_open.groupBy("block").agg(
        tiles(F.sum(rest), F.sum(rest * F.col("n"))).alias("ri"), tiles(F.count("*"), F.sum("n")).alias("rj")
    )
    dealt = hot_open.join(stored(counts, "counts"), "block")
    left = dealt.where("rest").select("block", tile_of(F.col("ri")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("rj") - 1)).alias("j"), F.lit(0).alias("side"), "id", "n")
    right = dealt.select("block", F.explode(F.sequence(F.lit(0), F.col("ri") - 1)).alias("i"), tile_of(F.col("rj")).alias("j"), F.lit(1).alias("side"), "id", "n")
    across = compared(left.unionByName(right), whole, percent)
    return small.unionByName(sure).unionByName(across)


def links(docs: DataFrame, reps: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) among the classes, enough of them for the components to be right.

    ``reps``: id, rep, n, d1, d2, prefix of the classes, stored.
    """
    limits = Limits(percent)
    counts = stored(tokens_of(reps).groupBy("hash").agg(F.count("*").alias("df")).where("df > 1"), "df")
    tokens = stored(tokens_of(reps, bitmap(counts)).join(counts, "hash").select("hash", "id", "n", "df"), "tokens")
    dropped(counts)
    ceil_t = F.ceil(F.col("n") * F.lit(percent) / 100)
    per_set = tokens.where(F.col("df") > RARE).groupBy("id", "n").agg(F.count("*").alias("frequent"))

    def shared(n):
        """Limits.shared as a column: exact, as n * percent is far below 2**53."""
        least = F.ceil(n * F.lit(percent) / 100)
        extra = F.floor((n - least) * min(10, 100 - percent) / max(1, 100 - percent))
        return F.least(least, F.greatest(extra, F.lit(EXTRA).cast("long")))

    rare = tokens.where(F.col("df") <= RARE).join(per_set.select("id", "frequent"), "id", "left").fillna(0, ["frequent"])
    # One row for each rare token: at most RARE sets have it.
    side = F.struct("id", "n", "frequent")
    held = rare.groupBy("hash").agg(F.array_sort(F.collect_list(side)).alias("s"))
    pairs = (
        held.select(F.posexplode("s").alias("i", "x"), "s")
        .select("x", F.explode(F.slice("s", F.col("i") + 2, F.lit(RARE))).alias("y"))
        .where((F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent))
        .groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .agg(
            F.count("*").alias("rare"),
            F.first(F.least("x.frequent", "y.frequent")).alias("frequent"),
            F.first(F.least(shared(F.col("x.n")), shared(F.col("y.n")))).alias("need"),
        )
        .where("rare + frequent >= need")
        .select("a", "b")
    )
    pairs = stored(pairs, "pairs")
    # A partner may be smaller, down to t n, and need fewer.
    hot = stored(per_set.where(F.col("frequent") >= shared(ceil_t)).select("id"), "hot")
    dropped(tokens)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(hot).distinct()
    involved = stored(reps.select("id", "rep", "n", "d1", "d2").join(ids, "id", "left_semi"), "involved")
    whole = stored(whole_sets(docs, words, involved), "whole")
    dropped(involved)

    sigs = combinations(whole.join(hot, "id", "left_semi"), limits)
    star = stored(sigs.groupBy("sig").agg(F.min("id").alias("b"), F.count("*").alias("m")).where("m > 1").select("sig", "b"), "star")
    stars = sigs.join(star, "sig").where("id <> b").groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"))
    stars = stored(stars, "stars")
    dropped(star, hot)
    return links_in_blocks(pairs, stars, whole, percent)


def classes_of(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, h, n, d1, d2; every class's n, d1, d2, root and component_id. Both stored.

    ``docs``: doc_id, text. ``h`` is a hash of the text; ``root`` names the component, even one without any doc_id.
    """
    sets = stored(sets_of(docs.withColumn("h", F.xxhash64("text")), words, Limits(percent)), "sets")
    classes = sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"))
    reps = stored(classes.withColumn("id", F.monotonically_increasing_id()), "reps")
    found = components(links(docs, reps, words, percent))
    named = stored(reps.drop("prefix").join(found.toDF("id", "root"), "id", "left").withColumn("root", F.coalesce("root", "id")), "named")
    dropped(reps, found)
    # Minima of the components: a row for each task and component.
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id")), "roots")
    out = stored(named.join(least, "root").select("n", "d1", "d2", "root", "component_id"), "classes")
    dropped(named, least)
    return sets.drop("prefix"), out


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; links are pairs with 100 * intersection >= percent * union."""
    tuned(docs.sparkSession)
    rows, classes = classes_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, percent)
    out = rows.join(classes, ["n", "d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay: of each near-duplicate group one with its smallest doc_id.

    Rows without shingles all stay. Of rows with the same doc_id in one group, and of repeated
    rows, one stays; a group in which all ids are null keeps one of its rows.
    """
    tuned(docs.sparkSession)
    rows, classes = classes_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words, percent)
    counted = rows.groupBy("n", "d1", "d2", "doc_id", "h").agg(F.count("*").alias("rows"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    keep = counted.join(classes, ["n", "d1", "d2"]).groupBy("root").agg(F.min(first).alias("k"), F.min_by("rows", first).alias("rows"))
    keep = stored(keep.select("k.doc_id", "k.h", "rows").unionByName(rows.where("n = 0").select("doc_id", "h", F.lit(1).alias("rows")).distinct()), "keep")

    def picked(keys: DataFrame) -> DataFrame:
        # The row as one struct: its columns may have any names.
        all_rows = docs.select(F.struct("*").alias("row"))
        k = keys.select(F.col("doc_id").alias("_of"), F.col("h").alias("_h"))
        return all_rows.join(k, (F.xxhash64("row.text") == k["_h"]) & F.col("row.doc_id").cast("long").eqNullSafe(k["_of"]), "left_semi")

    several = stored(keep.where("rows > 1"), "several")
    one = picked(several).groupBy(F.col("row.doc_id").alias("_of"), F.xxhash64("row.text").alias("_h")).agg(F.first("row").alias("row"))
    return picked(keep.where("rows = 1")).unionByName(one.select("row")).select("row.*")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"), words=3, percent=90)
