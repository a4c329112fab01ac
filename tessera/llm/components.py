"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._shared import discard, stash


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (u, v), longs. Returns (u, v) with v the smallest vertex of u's component, for every u other than v.

    Large-star then small-star until nothing changes: each round links every vertex to the smallest of its neighbourhood, which
    takes a number of rounds logarithmic in the longest path. Each round is written to the shared folder, so lineage stays
    short and nothing is gathered on the driver but a count and a checksum. Minimums are aggregated before the shuffle and
    joined back, so a vertex with a third of all edges is no single task's work.
    """
    own = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    own = stash(own, "links")
    before = _signature(own)
    for _ in range(most_rounds):
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _signature(after)
        discard(own)
        own = after
        if now == before:
            return own
        before = now
    raise RuntimeError("the components have not settled")
