"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import dropped, stored


def forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what was not joined before."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for a, b in pairs:
        if (x := root(a)) != (y := root(b)):
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def components(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` of any direction to ``(node, component)`` of every node but the smallest of each component; stored.

    Large star: a node links its larger neighbours to its smallest one. Small star:
    it links its smaller neighbours, and itself, to the smallest. Repeated until
    nothing changes, all links lead to the component's smallest node; the number of
    rounds is logarithmic. Minima are partial sums before the shuffle, and stored, so
    that Spark can split a skewed partition of the join back to the links. Nothing
    but a count and a checksum comes to the driver.
    """
    e = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"
    )
    before = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            out.stored_at = e.stored_at
            return out
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        dropped(e, least)
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        dropped(large, least)
