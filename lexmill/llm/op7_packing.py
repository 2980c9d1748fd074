"""Packing token sequences: first-fit decreasing with a tournament tree of bin capacities.

Every document is encoded, ended with id 0, and cut at multiples of the sequence
length. The documents are dealt into randomised groups of about ``GROUP_DOCS`` by a
hash of their places in the table, and each group is packed on its own: pieces from
long to short, each into the first sequence with room for it. A tournament tree over
the free space finds that sequence in log n steps: every inner node holds the most
room below it. The number of groups follows the input; pieces as long as a sequence
are sequences of their own, so that they take no part in a group's search.

Nulls: a null text is the empty text, a single id 0; a null doc_id stays null.
Repeated rows, and rows that share a doc_id, are documents of their own. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import mix64, stored, table, tuned

SPACE = "\t-\r \x85\xa0  -     　"
#: White space with what follows it: no word of the tokenizer has anything before its white space.
RUNS = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+$")
#: Runs remembered at a time; a bound on memory, not on results.
KEEP_RUNS = 1_000_000
GROUP_DOCS = 2048
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
ROWS = PIECES + ", row long"
PACKED = PIECES + ", sequence_id long, offset long"


class ByteBPE:
    """The ids of texts, packed, with a memory for runs. Two libraries share the vocabulary:
    the faster one encodes runs of Latin letters, the other those with special tokens or other scripts."""

    def __init__(self, tokenizer: str, ranks: str) -> None:
        self.library = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        with open(public_tokenizers.path(ranks), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.plain = re.compile("[\x00-\x1b\x20-ɏ]*")
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        runs = RUNS.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, runs))
        except KeyError:
            if len(self.known) > KEEP_RUNS:
                self.known = {}
            for r in runs:
                if r not in self.known:
                    if "<|" in r or not (r.isascii() or self.plain.fullmatch(r)):
                        ids = self.library.encode(r, add_special_tokens=False).ids
                    else:
                        ids = self.fast.encode_ordinary(r)
                    self.known[r] = struct.pack(f"<{len(ids)}I", *ids)
            return b"".join(map(self.known.__getitem__, runs))


_made: dict[str, ByteBPE] = {}


def encoder(tokenizer: str, ranks: str) -> ByteBPE:
    if tokenizer not in _made:
        _made[tokenizer] = ByteBPE(tokenizer, ranks)
    return _made[tokenizer]


def columns_of(names: str) -> list[str]:
    return [c.split()[0] for c in names.split(", ")]


def pieces_of(docs: DataFrame, length: int = 1024, tokenizer: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """A row for each piece of each document: where it starts, its length and checksum; and ``row``, a hash of the document's place.

    The place is the task and a count; to be stored, as another run may read rows in another order.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, done = encoder(tokenizer, ranks), TaskContext.get().partitionId() << 40
        for b in it:
            start, size, crc, total, of = [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                ids = bpe.encode(text or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for at in range(0, n, length):
                    start.append(at)
                    size.append(min(length, n - at))
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    total.append(n)
                    of.append(k)
            of = np.array(of, np.int64)
            row = mix64((of + done).astype(np.uint64)).view(np.int64)
            done += b.num_rows
            columns = [b.column("doc_id").take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (start, size, crc, total)), pa.array(row)]
            yield pa.RecordBatch.from_arrays(columns, columns_of(ROWS))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


class Tournament:
    """Free space of ``n`` bins; finds the first bin with enough room."""

    def __init__(self, n: int, room: int) -> None:
        self.leaves = 1 << max(0, n - 1).bit_length()
        self.most = [room] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Take ``size`` from the first bin that has it; the bin and its room before."""
        most, i = self.most, 1
        while i < self.leaves:
            i *= 2
            if most[i] < size:
                i += 1
        bin_, room = i - self.leaves, most[i]
        most[i] = room - size
        while i > 1:
            i //= 2
            most[i] = max(most[2 * i], most[2 * i + 1])
        return bin_, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset in it of every size; the sizes come from long to short."""
    full = int((sizes >= capacity).sum())
    bins, offsets = np.arange(len(sizes), dtype=np.int64), np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes) - full), capacity)
    for k, size in enumerate(sizes[full:].tolist(), full):
        b, room = tree.place(size)
        bins[k], offsets[k] = full + b, capacity - room
    return bins, offsets


def pack(docs: DataFrame, length: int = 1024, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Each piece with its sequence and its offset there."""
    tuned(docs.sparkSession)
    pieces = stored(pieces_of(docs, length), "op7")
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_numpy(), length)
        group = t.column("pack_group").to_numpy().astype(np.int64)
        own = [t.column(c) for c in columns_of(PIECES)]
        return pa.Table.from_arrays([*own, pa.array((group << 32) + bins), pa.array(offsets)], columns_of(PACKED))

    grouped = pieces.withColumn("pack_group", F.pmod(F.col("row"), F.lit(groups)).cast("int")).groupBy("pack_group")
    return grouped.applyInArrow(run, PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents", "doc_id", "text"))
