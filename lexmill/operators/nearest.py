"""Nearest vectors by products of matrices: blocks of queries against tiles of rows, the best k kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows of a tile; with a block of queries its products take a few MB.
TILE = 1_024
#: Cosines are compared by nine digits, as in the SQL.
DIGITS = 1e9
#: A product of matrices adds up in another order than a sum over the components; cosines differ by less than this.
SLACK = 2e-11
LAST_ID = np.iinfo(np.int64).max


def key_of(semantic: np.ndarray) -> np.ndarray:
    """What cosines are ordered by: rounded half away from zero. NaN (which sorts first) is infinity; null is given as minus infinity."""
    with np.errstate(invalid="ignore"):
        key = np.copysign(np.floor(np.abs(semantic) * DIGITS + 0.5), semantic) + 0.0
    return np.where(np.isnan(semantic), np.inf, key)


class Vectors:
    """A column of vectors in double precision, by length: a vector that is null or has null components is in none of them."""

    def __init__(self, column: pa.ChunkedArray | pa.Array):
        a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = pc.list_flatten(a)
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        if flat.null_count:
            size[np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64)
        self.n = len(size)
        self.of: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(size[size >= 0]).tolist():
            at = np.flatnonzero(size == n)
            m = x[start[at][:, None] + np.arange(n)]
            length = np.sqrt(in_order(m, m))
            self.of[n] = at, m, length


def in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components."""
    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


class Products:
    """Cosines of a tile of rows with queries."""

    def __init__(self, rows: Vectors, queries: Vectors, who: np.ndarray):
        self.parts = []
        self.rough = np.full((rows.n, len(who)), -np.inf)
        place = np.full(queries.n, -1)
        place[who] = np.arange(len(who))
        for n, (at, m, length) in rows.of.items():
            if n in queries.of:
                q_at, q, q_length = queries.of[n]
                mine = place[q_at] >= 0
                q_at, q, q_length = (q_at, q, q_length) if mine.all() else (q_at[mine], q[mine], q_length[mine])
                with np.errstate(all="ignore"):
                    s = (m / length[:, None]) @ (q / q_length[:, None]).T
                    none = (length == 0)[:, None] | (q_length == 0)[None]
                    lost = ~(np.isfinite(length)[:, None] & np.isfinite(q_length)[None])
                s[none] = -np.inf
                s[lost] = np.inf
                if len(at) == rows.n and len(q_at) == len(who):
                    self.rough = s
                else:
                    self.rough[np.ix_(at, place[q_at])] = s
                self.parts.append((at, m, length, place[q_at], q, q_length))

    def exact(self, at: np.ndarray, who: np.ndarray) -> np.ndarray:
        """The cosines of pairs (row, place of the query), like ``functions.vectors.cosine``; minus infinity for none."""
        out = np.where(np.isposinf(self.rough[at, who]), np.nan, -np.inf)
        finite = np.isfinite(self.rough[at, who])
        for rows, m, length, asked, q, q_length in self.parts:
            row_of, ask_of = np.full(self.rough.shape[0], -1), np.full(self.rough.shape[1], -1)
            row_of[rows], ask_of[asked] = np.arange(len(rows)), np.arange(len(asked))
            mine = np.flatnonzero(finite & (row_of[at] >= 0) & (ask_of[who] >= 0))
            for i in range(0, len(mine), 8_192):
                p = mine[i : i + 8_192]
                a, b = row_of[at[p]], ask_of[who[p]]
                out[p] = in_order(m[a], q[b]) / (length[a] * q_length[b])
        return out


class Best:
    """The best k pairs of each slot (a query and a value of ``by``) so far: highest key, then smaller id; rows are kept with them."""

    def __init__(self, k: int):
        self.k, self.rows = k, None
        self.slot, self.key, self.id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least, self.last = np.empty(0), np.empty(0, np.int64)

    def room(self, slots: int) -> None:
        """Slots that are not full take anything."""
        more = slots - len(self.least)
        if more > 0:
            self.least, self.last = np.append(self.least, np.full(more, -np.inf)), np.append(self.last, np.full(more, LAST_ID))

    def enters(self, slot: np.ndarray, key: np.ndarray, row_id: np.ndarray) -> np.ndarray:
        return (key > self.least[slot]) | ((key == self.least[slot]) & ((row_id < self.last[slot]) | (self.last[slot] == LAST_ID)))

    def add(self, slot: np.ndarray, key: np.ndarray, row_id: np.ndarray, rows: pa.Table) -> None:
        slot, key, row_id = np.append(self.slot, slot), np.append(self.key, key), np.append(self.id, row_id)
        order = np.lexsort((row_id, -key, slot))
        rank = np.arange(len(order)) - np.searchsorted(slot[order], np.arange(len(self.least)))[slot[order]]
        kept, full = order[rank < self.k], order[rank == self.k - 1]
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        self.rows = rows.take(pa.array(kept)).combine_chunks()
        self.slot, self.key, self.id = slot[kept], key[kept], row_id[kept]
        self.least[slot[full]], self.last[slot[full]] = key[full], row_id[full]


def best_of(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, by: tuple[str, ...], split: tuple[str, ...], may: Callable[[tuple], np.ndarray]) -> pa.Table | None:
    """The best k rows of each query (and value of ``by``) among the batches, with ``semantic`` and ``_key``.

    Rows are taken in groups of equal ``by`` and ``split``; ``may`` tells which queries ask the rows of a group.
    """
    queries, others = Vectors(asked["qv"]), asked.drop_columns(["qv"])
    # An id of a query that comes twice is one query.
    whose = asked["query_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
    best, codes = Best(k), {}
    for batch in batches:
        table = pa.Table.from_batches([batch])
        names = (*by, *split)
        groups: dict[tuple, list[int]] = {}
        for i, g in enumerate(zip(*(table[c].to_pylist() for c in names), strict=True) if names else ((),) * len(table)):
            groups.setdefault(g, []).append(i)
        for g, own in groups.items():
            who = may(g)
            if not len(who):
                continue
            base = codes.setdefault(g[: len(by)], len(codes)) * len(asked)
            best.room(base + len(asked))
            slot_of = base + whose[who]
            for i in range(0, len(own), TILE):
                add_tile(best, table.take(pa.array(own[i : i + TILE])), queries, others, who, slot_of)
    return best.rows


def add_tile(best: Best, tile: pa.Table, queries: Vectors, others: pa.Table, who: np.ndarray, slot_of: np.ndarray) -> None:
    ids = pc.fill_null(tile["id"], LAST_ID).to_numpy().astype(np.int64)
    p = Products(Vectors(tile["v"]), queries, who)
    least = best.least[slot_of]
    if len(ids) > best.k and np.isneginf(least).any():
        # k rows of the tile are as good as this, so these bounds hold in slots that are not full yet.
        within = key_of(np.partition(p.rough, len(ids) - best.k, axis=0)[len(ids) - best.k]) - 1
        least = np.maximum(least, within)
    at, w = np.nonzero(p.rough >= ((least - 0.5) / DIGITS - SLACK)[None])
    slot = slot_of[w]
    with np.errstate(invalid="ignore"):
        fit = best.enters(slot, np.floor(p.rough[at, w] * DIGITS + 0.5 + SLACK * DIGITS), ids[at])
    at, w, slot = at[fit], w[fit], slot[fit]
    semantic = p.exact(at, w)
    key = key_of(semantic)
    fit = best.enters(slot, key, ids[at])
    at, w, slot, semantic, key = at[fit], w[fit], slot[fit], semantic[fit], key[fit]
    if len(at):
        rows, asks = tile.drop_columns(["v"]).take(pa.array(at)), others.take(pa.array(who[w]))
        for c in asks.column_names:
            rows = rows.append_column(c, asks[c])
        rows = rows.append_column("semantic", pa.array(semantic, mask=np.isneginf(semantic))).append_column("_key", pa.array(key))
        best.add(slot, key, ids[at], rows)
