"""Exact top-k inner products by block-at-a-time pruning.

Vectors are quantised to integers. A component is a term, its value the weight.
Rows are put into blocks of at most ``BLOCK`` close ones: a tree of two-means splits,
fitted on at most ``SAMPLE`` rows, deals all rows into leaves, and each leaf is split
on in the same way. A block keeps the largest and the least value of every term, and
its rows as a forward index. For a query a block's bound is the sum over the terms of
its weight times the largest value (the least, for a negative weight).

The index is a stored table; queries are answered in chunks of about ``CHUNK`` rows,
one after another, each chunk sent to all tasks:

1. The bounds of all blocks are summed; the ``SEEDS`` blocks with the highest bound of
   each query, over all tasks, are scored. Their k-th score is the query's threshold.
2. Every task takes its blocks in the order of their bounds, scores them through their
   forward index, and leaves off as soon as the bound falls below the k-th score, its
   own or the threshold. It returns at most k rows a query, which a window reduces to k.

Ties go to the smaller id; a bound equal to the k-th score is still scored, so ties are
exact. How much is pruned depends on the vectors: of clustered ones most blocks, of
directions spread evenly in many dimensions hardly any, whatever the blocks.

Vectors that are null, or hold null or non-finite components, and rows without an id
take no part; the zero vector does. Integers are held to +-2**27, so that scores of up
to 512 components fit a long and are exact; components beyond +-131072 count as that. A
row is no candidate of its own; other rows are, with an equal vector or even the same
id. With fewer candidates than k all are returned. Vectors of different length are
compared over the components that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import dropped, stored, stored_parts, table, tuned
from ._repeats import ids_of

BLOCK, CHUNK, SCALE, SEEDS = 64, 20_000, 1024, 4
#: Rows the tree is fitted on, rows of a leaf of theirs, rows that one task splits on.
SAMPLE, LEAF, GROUP = 8192, 32, 8192
MOST = 1 << 27
#: Below this, sums of products are exact in double precision, which is faster.
EXACT = 1 << 21
#: Less than any score.
NONE = -(1 << 63) + 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id and the integers floor(scale * x) of all vectors that take part."""
    v = F.col(vec_col)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    held = F.transform(v, lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), x.cast("double") * scale)))
    ints = F.transform(held, lambda x: F.floor(x).cast("int"))
    return vectors.where(v.isNotNull() & fine & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), ints.alias("q"))


def matrix(rows: pa.Array, width: int | None = None) -> np.ndarray:
    """Arrow lists as a matrix, shorter ones filled up with zeros."""
    sizes = np.diff(rows.offsets.to_numpy())
    values = rows.values.to_numpy(zero_copy_only=False)[rows.offsets[0].as_py() if len(rows) else 0 :]
    width = int(sizes.max(initial=0)) if width is None else width
    out = np.zeros((len(sizes), width), np.int32)
    at = np.arange(width)[None, :] < sizes[:, None]
    out[at] = values[: int(sizes.sum())][np.concatenate([np.arange(n) < width for n in sizes]) if len(sizes) else slice(0)]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact inner products of integer rows."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def two_means(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction and a threshold on it that part rows into two close groups, if any differ."""
    far = ((x - x[0]) ** 2).sum(1).argmax()
    a, b = x[0], x[far]
    for _ in range(5):
        direction, middle = b - a, (a + b) @ (b - a) / 2
        right = x @ direction > middle
        if right.all() or not right.any():
            break
        a, b = x[~right].mean(0), x[right].mean(0)
    return direction, middle


def parts_of(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Rows parted on and on until no part has more than so many."""
    out, left = [], [np.arange(len(x))]
    while left:
        at = left.pop()
        if len(at) <= most:
            out.append(at)
            continue
        direction, middle = two_means(x[at])
        right = x[at] @ direction > middle
        if right.all() or not right.any():  # equal rows
            right = np.arange(len(at)) >= len(at) // 2
        left += [at[right], at[~right]]
    return [at for at in out if len(at)]


class Tree:
    """Two-means splits of a sample; deals other rows into its leaves."""

    def __init__(self, x: np.ndarray, leaf: int) -> None:
        self.width, self.nodes, self.leaves = x.shape[1], [], 0
        self.root = self.grow(x, leaf)

    def grow(self, x: np.ndarray, leaf: int) -> int:
        """The number of a node, or minus one less the number of a leaf."""
        if len(x) > leaf:
            direction, middle = two_means(x)
            right = x @ direction > middle
            if right.any() and not right.all():
                k = len(self.nodes)
                self.nodes.append(None)
                self.nodes[k] = (direction, middle, self.grow(x[~right], leaf), self.grow(x[right], leaf))
                return k
        self.leaves += 1
        return -self.leaves

    def deal(self, x: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(x), np.int32), [(self.root, np.arange(len(x)))]
        while left:
            k, at = left.pop()
            if k < 0:
                out[at] = -k - 1
                continue
            direction, middle, no, yes = self.nodes[k]
            right = x[at] @ direction > middle
            left += [(no, at[~right]), (yes, at[right])]
        return out


def blocks_of(ints: DataFrame, block: int = BLOCK) -> DataFrame:
    """The block index: ids, rows, forward matrix, and term maxima and minima of each block. ``ints``: id, row, q; stored."""
    sample = ints.orderBy(F.xxhash64("row")).limit(SAMPLE).select("q").toArrow()
    tree = Tree(matrix(sample.column("q").combine_chunks()).astype(float), LEAF)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            leaf = tree.deal(matrix(b.column("q"), tree.width).astype(float))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], ["id", "row", "q", "leaf"])

    def build(t: pa.Table) -> pa.Table:
        x = matrix(t.column("q").combine_chunks())
        ids, row = (t.column(c).to_numpy() for c in ("id", "row"))
        out = []
        for at in parts_of(x.astype(float), block):
            m = x[at]
            out.append({"ids": ids[at].tobytes(), "rows": row[at].tobytes(), "width": m.shape[1], "forward": m.tobytes(), "most": m.max(0).tobytes(), "least": m.min(0).tobytes()})
        kinds = [("ids", pa.binary()), ("rows", pa.binary()), ("width", pa.int32()), ("forward", pa.binary()), ("most", pa.binary()), ("least", pa.binary())]
        return pa.Table.from_pylist(out, pa.schema(kinds))

    dealt = stored(ints.mapInArrow(deal, "id long, row long, q array<int>, leaf int"), "op6l")
    # A leaf with very many rows, as of one common vector, is dealt into groups; there are at most SAMPLE leaves.
    sizes = dealt.groupBy("leaf").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("groups"))
    grouped = dealt.join(stored(sizes, "op6g"), "leaf").withColumn("g", F.pmod(F.xxhash64("row"), F.col("groups")))
    schema = "ids binary, rows binary, width int, forward binary, most binary, least binary"
    index = stored(grouped.groupBy("leaf", "g").applyInArrow(build, schema).withColumn("block", F.monotonically_increasing_id()), "op6")
    dropped(dealt)
    return index


class Best:
    """The k best (score, id) of every query so far."""

    def __init__(self, queries: int, k: int, least: np.ndarray | None = None) -> None:
        self.k = k
        self.score = np.full((queries, k), NONE)
        self.id = np.full((queries, k), np.iinfo(np.int64).max)
        #: What the k-th score is known to reach.
        self.least = np.full(queries, NONE) if least is None else least

    def kth(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.least)

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates with their ids, for some of the queries."""
        s = np.concatenate([self.score[rows], score], axis=1)
        i = np.concatenate([self.id[rows], np.broadcast_to(ids, score.shape)], axis=1)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[rows] = np.take_along_axis(s, order, 1)
        self.id[rows] = np.take_along_axis(i, order, 1)


class Queries:
    """One chunk of queries in a task."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, q: np.ndarray) -> None:
        self.ids, self.rows, self.q = ids, rows, q

    def fitted(self, packed: list[bytes], widths: list[int]) -> np.ndarray:
        """Rows of term values, as wide as the queries."""
        w = self.q.shape[1]
        out = np.zeros((len(packed), w), np.int32)
        for k, (x, n) in enumerate(zip(packed, widths, strict=True)):
            out[k, : min(n, w)] = np.frombuffer(x, np.int32)[: min(n, w)]
        return out

    def bounds(self, b: pa.RecordBatch) -> np.ndarray:
        most, least = (self.fitted(b.column(c).to_pylist(), b.column("width").to_pylist()) for c in ("most", "least"))
        return products(np.maximum(self.q, 0), most) + products(np.minimum(self.q, 0), least)

    def score(self, best: Best, at: np.ndarray, block: dict) -> None:
        """Score a block's rows for the queries ``at``."""
        ids, rows = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["rows"], np.int64)
        w = min(block["width"], self.q.shape[1])
        score = products(self.q[at, :w], np.frombuffer(block["forward"], np.int32).reshape(-1, block["width"])[:, :w])
        score[self.rows[at][:, None] == rows[None, :]] = NONE
        best.add(at, score, ids)


def thresholds(index: DataFrame, sent, k: int) -> np.ndarray:
    """A score that each query's k-th one reaches: that of its blocks with the highest bounds."""

    def seeds(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*sent.value)
        n = len(queries.ids)
        bound, block = np.full((n, SEEDS), NONE), np.full((n, SEEDS), -1)
        for b in it:
            own = np.broadcast_to(ids_of(b.column("block")), (n, b.num_rows))
            s, i = np.concatenate([bound, queries.bounds(b)], axis=1), np.concatenate([block, own], axis=1)
            order = np.argsort(-s, axis=1, kind="stable")[:, :SEEDS]
            bound, block = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        q, c = np.nonzero(block >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bound[q, c]), pa.array(block[q, c])], ["query", "bound", "block"])

    def score(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*sent.value)
        best, used = Best(len(queries.ids), k), set()
        for b in it:
            for x in b.to_pylist():
                at = np.array(x["queries"])
                queries.score(best, at, x)
                used.update(x["queries"])
        q, c = np.nonzero(best.score > NONE)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best.score[q, c])], ["query", "score"])

    narrow = index.select("block", "width", "most", "least")
    found = narrow.mapInArrow(seeds, "query long, bound long, block long")
    # At most SEEDS rows a task and query.
    order = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    chosen = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SEEDS).groupBy("block").agg(F.collect_list("query").alias("queries"))
    scored = index.select("block", "ids", "rows", "width", "forward").join(chosen, "block").mapInArrow(score, "query long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"))
    kth = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
    out = np.full(len(sent.value[0]), NONE)
    for r in kth.select("query", "score").collect():  # at most one row a query of the chunk
        out[r["query"]] = r["score"]
    return out


def answered(index: DataFrame, sent, least: np.ndarray, k: int) -> DataFrame:
    """The k best rows of every query in every task's blocks; and from each task, without a query, how many blocks were scored and might have been."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(*sent.value)
        best, scored, total = Best(len(queries.ids), k, least), 0, 0
        for b in it:
            bound, blocks = queries.bounds(b), b.to_pylist()
            total += bound.size
            order = np.argsort(-bound, axis=1, kind="stable")
            for step in range(len(blocks)):
                at = order[:, step]
                going = np.flatnonzero(bound[np.arange(len(at)), at] >= best.kth())
                if not len(going):
                    break
                scored += len(going)
                by = np.argsort(at[going], kind="stable")
                for rows in np.split(going[by], np.flatnonzero(np.diff(at[going][by])) + 1):
                    queries.score(best, rows, blocks[at[rows[0]]])
        q, c = np.nonzero(best.score > NONE)
        columns = (np.r_[queries.ids[q], 0], np.r_[queries.rows[q], -1], np.r_[best.id[q, c], total], np.r_[best.score[q, c], scored])
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in columns], ["query_id", "query_row", "vec_id", "score"])

    return index.mapInArrow(run, "query_id long, query_row long, vec_id long, score long")


def searched(vectors: DataFrame, queries, k: int, id_col: str, vec_col: str, chunk: int) -> DataFrame | None:
    """What ``answered`` returns for all queries, chunk by chunk; stored."""
    spark = vectors.sparkSession
    ints = stored(quantised(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()).select("id", "row", "q"), "op6v")
    index = blocks_of(ints)
    asked = ints.where(queries)
    chunks = -(-asked.count() // chunk)

    def answers() -> Iterator[DataFrame]:
        for c in range(chunks):
            rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(chunks)) == c).toArrow()  # about CHUNK rows
            if rows.num_rows:
                q = matrix(rows.column("q").combine_chunks())
                sent = spark.sparkContext.broadcast((rows.column("id").to_numpy(), rows.column("row").to_numpy(), q))
                yield answered(index, sent, thresholds(index, sent, k), k)
                sent.unpersist()

    out = stored_parts(spark, answers(), "op6a") if chunks else None
    dropped(ints, index)
    return out


def top_k(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows.

    ``queries``: a condition on the column ``id`` that picks the queries.
    """
    tuned(vectors.sparkSession)
    found = searched(vectors, queries, k, id_col, vec_col, chunk)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.where("query_row >= 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def scored_share(vectors: DataFrame, queries, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of all pairs of a query and a block that were scored."""
    found = searched(vectors, queries, k, id_col, vec_col, CHUNK)
    scored, total = found.where("query_row < 0").agg(F.sum("score"), F.sum("vec_id")).first()
    return scored / total


def op6_block_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 100 == 0)
