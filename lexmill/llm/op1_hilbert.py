"""Sharding along a Hilbert curve, with DataFrame functions only.

Four metadata dimensions (language, source, byte size, document id) are quantised
into eight classes each at their quantiles (texts by the rank of their distinct
values, weighted by their rows), the class vector becomes an index on
a four-dimensional Hilbert curve, and the documents, ordered by that index, are
cut into runs of equal row counts. Neighbours on the curve share ranges in every
dimension, so min/max statistics of the shards' files prune on any of them.

The global rank needs no global sort: a row's rank is the number of rows in
earlier cells (at most 4096), plus those in earlier hash slices of its own cell,
plus its place in its slice. A cell that holds a third of all rows is thus split
over ``SLICES`` tasks.

Nulls: a null text counts no bytes (size 1, crc32 0); null metadata sort first, as
empty ones do; a null doc_id sorts as -1 and stays null. Empty tables give no rows;
repeated rows are kept and take places of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import dropped, stored, table, tuned

DIMS, BITS = 4, 3
SLICES = 1024
#: Partitions that distinct values are ranged over.
RANGES = 64


def classes(docs: DataFrame, column: str) -> DataFrame:
    """value and class (0 to 2**BITS - 1) of every distinct value of a text column, in order and of about equal row counts; stored.

    Values are counted, ranged over partitions by their order, and ranked by the counts of
    earlier partitions and of earlier values in their own.
    """
    counts = docs.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(RANGES, "value").withColumn("p", F.spark_partition_id()), "op1v")
    before = (Window.unboundedPreceding, -1)
    # A row for each of at most RANGES partitions, or as many as the session makes of them.
    starts = ranged.groupBy("p").agg(F.sum("n").alias("n"))
    starts = starts.select(
        "p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(*before)), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("total")
    )
    own = F.coalesce(F.sum("n").over(Window.partitionBy("p").orderBy("value").rowsBetween(*before)), F.lit(0))
    ranked = ranged.withColumn("own", own).join(F.broadcast(starts), "p")
    middle = (F.col("start") + F.col("own")) * 2 + F.col("n")
    # A value in the middle of its rows, in parts of all rows.
    return stored(ranked.select("value", F.floor(middle * 2**BITS / (F.col("total") * 2)).cast("int").alias("class")), "op1k")


def hilbert_index(axes: Column, dims: int = DIMS, bits: int = BITS) -> Column:
    """Index on the Hilbert curve of an ``array<int>`` of ``dims`` coordinates below ``2**bits``.

    The coordinates are untangled from the highest bit to the lowest (exchange or
    invert the low bits of the first axis), Gray-coded, and their bits interleaved.
    """
    last = dims - 1

    def put(x: Column, i: Column, at_0: Column, at_i: Column) -> Column:
        return F.transform(x, lambda v, k: F.when(k == 0, at_0).when(k == i, at_i).otherwise(v))

    def untangle(x: Column, bit: Column) -> Column:
        low = F.shiftleft(F.lit(1), 0) * F.pow(F.lit(2), bit).cast("int") - 1

        def step(y: Column, i: Column) -> Column:
            first, own = F.get(y, F.lit(0)), F.get(y, i)
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            is_set = own.bitwiseAND(low + 1) != 0
            flipped = first.bitwiseXOR(low)
            return F.when(is_set, put(y, i, flipped, F.when(i == 0, flipped).otherwise(own))).otherwise(
                put(y, i, first.bitwiseXOR(swap), own.bitwiseXOR(swap))
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(last)), x, step)

    x = axes
    for bit in range(bits - 1, 0, -1):
        x = untangle(x, F.lit(bit))
    gray = F.aggregate(
        F.sequence(F.lit(1), F.lit(last)),
        x,
        lambda y, i: F.transform(y, lambda v, k: F.when(k == i, v.bitwiseXOR(F.get(y, i - 1))).otherwise(v)),
    )

    def finish(y: Column) -> Column:
        end, t = F.get(y, F.lit(last)), F.lit(0)
        for bit in range(bits - 1, 0, -1):
            t = t.bitwiseXOR(F.when(end.bitwiseAND(1 << bit) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
        return F.transform(y, lambda v: v.bitwiseXOR(t))

    return F.aggregate(
        F.get(F.transform(F.array(gray), finish), F.lit(0)),
        F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("i")),
        lambda s, v: F.struct((s["h"] + sum_bits(v, s["i"], dims, bits)).alias("h"), (s["i"] + 1).alias("i")),
        lambda s: s["h"],
    )


def sum_bits(v: Column, axis: Column, dims: int, bits: int) -> Column:
    """The bits of one axis at their places in the interleaved index."""
    out = F.lit(0).cast("long")
    for bit in range(bits):
        place = bit * dims + (dims - 1)
        out = out + F.when(v.bitwiseAND(1 << bit) != 0, F.pow(F.lit(2.0), F.lit(place) - axis).cast("long")).otherwise(0)
    return out


def quantised(value: Column, cuts: list[int]) -> Column:
    """How many of the cut points lie below the value."""
    out = F.lit(0)
    for cut in cuts:
        out = out + (value > F.lit(cut).cast("long")).cast("int")
    return out


def shard_by_hilbert(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, and the curve index, of every row.

    Row counts of the shards are at most one apart (law ``rows``).
    """
    tuned(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    narrow = stored(rows, "op1")
    named = {c: classes(narrow, c).toDF(c, f"{c}_class") for c in ("lang", "source")}
    ids = F.coalesce(F.col("doc_id"), F.lit(-1).cast("long"))
    levels = F.array(*[F.lit(i / 2**BITS) for i in range(1, 2**BITS)])
    total, *cuts = narrow.agg(F.count("*"), *[F.percentile_approx(c, levels, F.lit(10000)) for c in ("size", ids)]).first()
    total, cuts = int(total), [c or [] for c in cuts]

    code = F.lit(0)
    for c in (F.col("lang_class"), F.col("source_class"), quantised(F.col("size"), cuts[0]), quantised(ids, cuts[1])):
        code = code * 2**BITS + c
    order = F.xxhash64("doc_id", "text_crc32", "size")
    # A value in a third of all rows is one key of plain rows on either side, which Spark can split.
    coded = narrow.join(named["lang"], "lang").join(named["source"], "source")
    coded = coded.select("doc_id", "size", "text_crc32", code.alias("code"), F.pmod(order, F.lit(SLICES)).cast("int").alias("slice"))
    coded = stored(coded, "op1c")
    dropped(narrow)
    slices = coded.groupBy("code", "slice").agg(F.count("*").alias("n"))
    unbounded = (Window.unboundedPreceding, -1)
    cells = slices.groupBy("code").agg(F.sum("n").alias("n"))
    axes = F.array(*[F.shiftright(F.col("code"), BITS * (DIMS - 1 - i)).bitwiseAND(2**BITS - 1) for i in range(DIMS)])
    cells = cells.withColumn("curve", hilbert_index(axes))
    # At most 2**(DIMS * BITS) = 4096 rows, whatever the input.
    cells = cells.select(
        "code",
        "curve",
        F.coalesce(F.sum("n").over(Window.orderBy("curve").rowsBetween(*unbounded)), F.lit(0)).alias("cell_start"),
    )
    starts = slices.select(
        "code",
        "slice",
        F.coalesce(F.sum("n").over(Window.partitionBy("code").orderBy("slice").rowsBetween(*unbounded)), F.lit(0)).alias("slice_start"),
    ).join(F.broadcast(cells), "code")
    placed = coded.join(starts, ["code", "slice"]).withColumn(
        "place", F.row_number().over(Window.partitionBy("code", "slice").orderBy(order, "doc_id", "text_crc32", "size"))
    )
    rank = F.col("cell_start") + F.col("slice_start") + F.col("place") - 1
    ranked = placed.withColumn("rank", rank).withColumn("shard", F.expr(f"cast((rank * {shards}) div {max(total, 1)} as int)"))
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return ranked.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - first).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op1_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_hilbert(table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"))
