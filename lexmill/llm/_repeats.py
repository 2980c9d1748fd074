"""Which hashes occur in more than one place: counted in Spark, told to the tasks as a bitmap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import dropped, mix64, stored
from ._hashes import Bitmap

#: Slices of the bitmap. Its size follows the number of hashes, between these powers of two (16 kB and 32 MB).
SLICE_BITS = 8
LEAST_BITS, MOST_BITS = 17, 28
#: Stands for a null id where ids are hashed; that a real id may equal it lets one more row through.
NO_ID = -(1 << 63)


class Known:
    """A bitmap on its way to the tasks."""

    def __init__(self, bits: int, sent: Broadcast) -> None:
        self.bits, self.sent = bits, sent

    def open(self) -> Bitmap:
        return Bitmap(self.bits, self.sent.value)


def bitmap(hashes: DataFrame) -> Known:
    """A broadcast bitmap of the ``hash`` column of a stored table, with eight to sixteen bits for each row.

    Past the upper bound more hashes seem to be in it that are not, which makes the
    exact step after it longer but changes no result. Every slice of it is put
    together by one task, from places that were made distinct on the way.
    """
    spark = hashes.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, (8 * hashes.count()).bit_length()))
    own = bits - SLICE_BITS

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << own, np.uint8)
        flags[pdf["place"].to_numpy() & ((1 << own) - 1)] = 1
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "data": [np.packbits(flags, bitorder="little").tobytes()]})

    places = hashes.select(F.col("hash").bitwiseAND((1 << bits) - 1).alias("place")).distinct().withColumn("slice", F.shiftright("place", own).cast("int"))
    data = bytearray(1 << (bits - 3))
    # At most 2**SLICE_BITS rows and the size of the bitmap in all.
    for row in places.groupBy("slice").applyInPandas(build, "slice int, data binary").collect():
        at = row["slice"] << (own - 3)
        data[at : at + len(row["data"])] = row["data"]
    return Known(bits, spark.sparkContext.broadcast(bytes(data)))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)


def ids_of(column) -> np.ndarray:
    """An Arrow column of ids as integers, whatever is null in it."""
    return (column.fill_null(NO_ID) if column.null_count else column).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def hashed_ids(ids: DataFrame, column: str) -> DataFrame:
    """A stored ``hash`` column of ids, for a bitmap of them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([pa.array(signed(mix64(ids_of(b.column(0)).view(np.uint64))))], ["hash"])

    return stored(ids.select(F.col(column).cast("long")).mapInArrow(run, "hash long"), "ids")


def has_ids(known: Bitmap, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in a bitmap of hashed ids."""
    return known.has(mix64(ids.view(np.uint64)))


def digest(text: Column) -> Column:
    """A text's SHA-256, as bytes."""
    return F.unhex(F.sha2(text, 256))


def copies_of(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), ``first`` (the smallest doc_id with that text) and n (rows with it) of every row; stored."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), digest(F.col("text")).alias("digest"))
    groups = stored(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"), "groups")
    # Only what is repeated is told to the rows; a text in a third of them is one key whose partition Spark can split.
    first, n = F.coalesce("first", "doc_id").alias("first"), F.coalesce("n", F.lit(1)).alias("n")
    out = stored(rows.join(groups, "digest", "left").select("doc_id", "h", first, n), "copies")
    dropped(groups)
    return out


class Parts:
    """Tells rows with one doc_id apart: a row's part is 0, or its text's hash if rows with other texts may have its doc_id."""

    def __init__(self, copies: DataFrame) -> None:
        ids = copies.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b")
        self.shared = bitmap(hashed_ids(ids, "doc_id"))

    def reader(self):
        """In a task: a function from ids and hashes of texts to parts."""
        known = self.shared.open()
        return lambda ids, h: np.where(has_ids(known, ids), h, 0)

    def of(self, rows: DataFrame) -> DataFrame:
        """The distinct doc_id and part of rows with doc_id and h."""

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = self.reader()
            for b in it:
                ids = ids_of(b.column("doc_id"))
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part(ids, ids_of(b.column("h"))))], ["doc_id", "part"])

        return rows.select("doc_id", "h").mapInArrow(run, "doc_id long, part long").distinct()


def with_marks(rows: DataFrame, marks: DataFrame, doc_id: Column, h: Column) -> DataFrame:
    """``rows`` with what ``marks`` (one row for each doc_id and part) has for them, else null."""
    m = marks.withColumnsRenamed({"doc_id": "_of", "part": "_part"})
    return rows.join(m, (doc_id == m["_of"]) & ((m["_part"] == 0) | (m["_part"] == h)), "left").drop("_of", "_part")
