"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors u, v have cosine >= t exactly if their squared distance is at most
2 - 2t. All vectors are rotated by one fixed random orthogonal matrix, which
spreads the distance evenly, and cut into blocks of ``WIDTH`` components. If the
whole distance is within the budget, some block's is within that block's share,
proportional to its width. So each block is range-joined on its own under its
share, and the candidates are verified on the whole vectors in double precision.

Rows are dealt by a hash into tiles, and every pair of tiles meets in one task, so
that each pair of rows meets once, whatever the number of blocks. There each block is
range-joined in memory: both sides are sorted by a grid over the first two components
of the block, and only runs of rows whose boxes come within the share are compared. A
pair is verified where it meets; it belongs to the first block whose share it keeps,
so it is counted once without any table of pairs. A task returns how many links each
of its vectors has, and a forest with the components of the links.

Pairs of tiles come in rounds: in a round each row is in at most ``COPIES`` of them
(more, while that is below ``ROUND_BYTES``), and the files of a round are deleted
before the next. So the disk that the join takes does not grow with the number of
tiles. The number of compared pairs still grows with the square of the rows where
vectors are spread evenly.

Equal vectors (told by their SHA-256) are one row from the start; a common vector costs nothing. Vectors that
are null, empty, zero, or hold null or non-finite components link with nothing: no
links, a component of their own. Vectors of different length are never linked.
Every vector is scaled by its largest component before its norm is taken, so that no
square overflows or underflows. Repeated vec_ids are that vector's copies, or other
vectors under that id, and count each; a null vec_id links as any other, but is
nobody's component_id unless all ids it reaches are null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, stored, stored_parts, table, tuned
from ._components import components, forest
from ._repeats import digest

WIDTH, TILE, AT_ONCE = 8, 8192, 512
#: Copies of a row in a round of pairs of tiles, at least; bytes of a round that are small enough for more.
COPIES, ROUND_BYTES = 2, 256 << 20
#: Added to every share: far above the rounding errors of double precision, far below any distance that matters; the same for single precision.
SLACK, COARSE = 1e-9, 1e-5
#: A row's side in a pair of tiles: the first one, the second one, or the same tile twice.
FIRST, SECOND, BOTH = 0, 1, 2


def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(4).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def unpack(column, kind: type = np.float64) -> np.ndarray:
    """Packed numbers, as many in each, as the rows of a matrix of doubles."""
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)


def packed(vectors: DataFrame, kind: type) -> DataFrame:
    """id and the vector as packed numbers; null if it links with nothing."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for v in b.column("v").to_pylist():
                x = None if v is None else np.array([np.nan if c is None else c for c in v], kind)
                ok = x is not None and len(x) and np.isfinite(x).all() and x.any()
                out.append((x + 0.0).tobytes() if ok else None)  # no negative zeros: equal vectors have equal bytes
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.binary())], ["id", "v"])

    return vectors.mapInArrow(run, "id long, v binary")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def shares(d: int, t: float) -> list[tuple[int, int, float]]:
    """First and last component of each block, and its share of the budget."""
    return [(lo, min(lo + WIDTH, d), (2 - 2 * t) * (min(lo + WIDTH, d) - lo) / d + SLACK) for lo in range(0, d, WIDTH)]


def within(x: np.ndarray, p: np.ndarray, q: np.ndarray, share: float) -> np.ndarray:
    """Whether rows p and q of a block are within its share: the same for a pair in any task and order."""
    total, x, y = np.zeros(len(p)), x[p], x[q]
    for c in range(x.shape[1]):
        total += (x[:, c] - y[:, c]) ** 2
    return total <= share


def runs_of(y: np.ndarray, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``rows`` in runs of close ones, by a grid over the first two components of y; least and largest components of each run."""
    slabs = max(1, round(math.sqrt(len(rows) / AT_ONCE)))
    slab = np.empty(len(rows), np.int64)
    slab[np.argsort(y[rows, 0], kind="stable")] = np.arange(len(rows)) * slabs // max(1, len(rows))
    rows = rows[np.lexsort((y[rows, min(1, y.shape[1] - 1)], slab))]
    runs = [rows[i : i + AT_ONCE] for i in range(0, len(rows), AT_ONCE)]
    return runs, np.array([y[r].min(0) for r in runs]), np.array([y[r].max(0) for r in runs])


def joined(p: np.ndarray, q: np.ndarray, up: np.ndarray) -> list[tuple[int, int]]:
    """Edges between roots that join what the links p, q join and ``up`` (the root of each row) had not joined before; ``up`` learns them."""
    out = []
    while True:
        apart = up[p] != up[q]
        p, q = p[apart], q[apart]
        if not len(p):
            return out
        # One link of each row and root at a time, few even where all are linked.
        some = np.unique(np.r_[np.unique(p, return_index=True)[1], np.unique(q, return_index=True)[1]])
        for x, y in forest(zip(up[p[some]].tolist(), up[q[some]].tolist(), strict=True)):
            out.append((x, y))
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            up[max(x, y)] = min(x, y)
        while (up[up] != up).any():
            up[:] = up[up]


def links_of_tile(g: pd.DataFrame, t: float, kind: type = np.float64) -> pd.DataFrame:
    """Links of one pair of tiles: (node, null, links) for each vector, and (a, b, 0) of a forest with the components of the links."""
    side = g["side"].to_numpy()
    u, node, copies = unit(unpack(g["v"], kind)), g["node"].to_numpy(), g["copies"].to_numpy()
    x = u @ rotation(u.shape[1])
    twice = bool((side == BOTH).any())
    first, second = np.flatnonzero(side != SECOND), np.flatnonzero(side != FIRST)
    parts = shares(u.shape[1], t)
    n_links, up, edges = np.zeros(len(g), np.int64), np.arange(len(g)), []
    blocks = [np.ascontiguousarray(x[:, lo:hi]) for lo, hi, _ in parts]
    for block, y in enumerate(blocks if len(first) and len(second) else []):
        share = parts[block][2]
        runs, least, most = runs_of(y, first)
        others, least2, most2 = (runs, least, most) if twice else runs_of(y, second)
        square, one = (y * y).sum(1)[:, None], np.ones((len(y), 1))
        # Their product is the squared distance in the block.
        left, right = np.hstack([-2 * y, square, one]).astype(np.float32), np.hstack([y, one, square]).astype(np.float32)
        lefts, rights = [left[r] for r in runs], [np.ascontiguousarray(right[r].T) for r in others]
        for i, a in enumerate(runs):
            gap = np.maximum(0, np.maximum(least[i] - most2, least2 - most[i]))
            near = np.flatnonzero((gap * gap).sum(1) <= share + SLACK)
            for j in near[near >= i] if twice else near:
                b = others[j]
                p, q = np.divmod(np.flatnonzero(lefts[i] @ rights[j] <= share + COARSE), len(b))
                if twice and i == j:
                    p, q = p[p < q], q[p < q]
                # In its share, and in that of no block before.
                for k in range(block + 1):
                    mine = within(blocks[k], a[p], b[q], parts[k][2]) == (k == block)
                    p, q = p[mine], q[mine]
                # Few pairs are compared one by one, many by a product of all.
                cosine = (u[a[p]] * u[b[q]]).sum(1) if 16 * len(p) < len(a) * len(b) else (u[a] @ u[b].T)[p, q]
                p, q = p[cosine >= t], q[cosine >= t]
                if len(p):
                    n_links[a] += np.bincount(p, copies[b[q]], len(a)).astype(np.int64)
                    n_links[b] += np.bincount(q, copies[a[p]], len(b)).astype(np.int64)
                    edges += joined(a[p], b[q], up)
    some = np.flatnonzero(n_links)
    counts = pd.DataFrame({"a": node[some], "b": pd.array([None] * len(some), "Int64"), "links": n_links[some]})
    return pd.concat([counts, pd.DataFrame({"a": [node[a] for a, _ in edges], "b": pd.array([node[b] for _, b in edges], "Int64"), "links": 0})]).astype({"a": "int64", "links": "int64"})


def rounds(reps: DataFrame) -> Iterator[DataFrame]:
    """Rows of the pairs of tiles (d, i, j) of one round after the other; in all rounds, each pair of tiles of vectors of one length once."""
    d = F.length("v").alias("d")
    tiles = stored(reps.groupBy(d).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"), F.sum(F.length("v")).alias("bytes")), "op4t")
    most, size = tiles.agg(F.max("tiles"), F.sum("bytes")).first()
    at_once = max(COPIES, ROUND_BYTES // max(1, size or 0))
    # A row of tile k meets tile m in the pair whose sum is k + m, modulo the number of tiles.
    rows = reps.select("node", "copies", "v", d).join(tiles, "d").withColumn("k", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    for start in range(0, most or 1, at_once):
        sums = F.sequence(F.lit(start), F.least(F.col("tiles"), F.lit(start + at_once)) - 1)
        pairs = rows.where(F.col("tiles") > start).withColumn("m", F.explode(F.transform(sums, lambda s: F.pmod(s - F.col("k"), F.col("tiles")))))
        side = F.when(F.col("k") == F.col("m"), BOTH).when(F.col("k") < F.col("m"), FIRST).otherwise(SECOND)
        yield pairs.select("d", F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), side.alias("side"), "node", "copies", "v")
    dropped(tiles)


def links(reps: DataFrame, t: float, kind: type = np.float64) -> DataFrame:
    """Parts of the number of links of each node, and a graph with the components of the links; see ``links_of_tile``. Stored."""
    schema = "a long, b long, links long"
    return stored_parts(reps.sparkSession, (r.groupBy("d", "i", "j").applyInPandas(lambda g: links_of_tile(g, t, kind), schema) for r in rounds(reps)), "op4")


def near_duplicates(vectors: DataFrame, t: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    tuned(vectors.sparkSession)
    # Floats stay floats on disk; all that is computed is doubles.
    kind = np.float32 if dict(vectors.dtypes)[vec_col] == "array<float>" else np.float64
    rows = packed(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")), kind)
    rows = stored(rows.withColumn("digest", digest(F.col("v"))), "op4v")
    classes = rows.where("v is not null").groupBy("digest").agg(F.first("v").alias("v"), F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "op4c")
    # From here on vectors are moved only to their pairs of tiles.
    ids = stored(rows.select("id", "digest").join(classes.select("digest", "node"), "digest", "left").select("id", "node"), "op4i")
    dropped(rows)
    found = links(classes, t, kind)
    n_links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("more"))
    root = components(found.where("b is not null").select("a", "b")).withColumnsRenamed({"component": "root"})
    named = classes.select("node", "rep", "copies").join(root, "node", "left").join(n_links, "node", "left")
    named = stored(named.withColumn("root", F.coalesce("root", "node")), "op4n")
    dropped(classes, found)
    least = stored(named.groupBy("root").agg(F.min("rep").alias("component_id")), "op4r")
    more = (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).cast("long").alias("n_links")
    of_class = stored(named.join(least, "root").select("node", more, "component_id"), "op4d")
    dropped(named, least)
    out = ids.join(of_class, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def op4_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
