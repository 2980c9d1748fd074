"""What the operators of this package share: tables, the shared folder, stable hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that a Python step gets at a time, about.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table under ``sf_dir``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (as in tests) gets a temporary folder that is
    deleted at exit; on a cluster that is an error, as executors would not find it.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="lexmill-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def tuned(spark: SparkSession) -> None:
    """Set, for the session, what these operators need: small Arrow batches, as texts may
    be long, and shuffle files that are deleted when the query that wrote them has ended."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts lineage: what follows no longer depends on any executor's
    shuffle files, and a nondeterministic recomputation is impossible.
    """
    return stored_parts(df.sparkSession, [df], name)


def stored_parts(spark: SparkSession, parts: Iterable[DataFrame], name: str) -> DataFrame:
    """As ``stored``, of one or more frames of one schema, each made when the one before has been written."""
    tuned(spark)
    path = os.path.join(shared_dir(spark), "lexmill", f"{name}-{uuid.uuid4().hex}")
    for df in parts:
        df.write.mode("append").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def trimmed(batches: Iterator) -> Iterator:
    """The same batches; at their end, memory that this Python worker has freed goes back to the system, as it waits for its next task."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the SplitMix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(doc_id: int) -> bool:
    """Whether a document's label is never learned from: crc32 of the decimal id, mod 5, is 0."""
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def held_out_column(doc_id="doc_id"):
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5) == 0
