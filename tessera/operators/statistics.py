"""Distributions of columns, selectivity of ranges, and reports of a benchmark's latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int = 64) -> DataFrame:
    """bin, low, high, n, share (of all rows with a value up to high) for equally wide bins that hold rows. Two aggregates; only
    the bins are ordered. Nulls take no part; a column with one value has one bin."""
    x = F.col(column).cast("double")
    ends = df.agg(F.min(x).alias("__low"), F.max(x).alias("__high"))
    width = (F.col("__high") - F.col("__low")) / bins
    own = df.where(F.col(column).isNotNull()).select(x.alias("__x")).crossJoin(F.broadcast(ends))  # one row
    place = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("__x") - F.col("__low")) / width))).otherwise(0).cast("int")
    counts = own.groupBy(place.alias("bin"), (F.col("__low") + place * width).alias("low"), (F.col("__low") + (place + 1) * width).alias("high")).agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(W.orderBy("bin")) / F.sum("n").over(W.partitionBy())
    return counts.select("bin", "low", "high", "n", so_far.alias("share"))


def selectivity(df: DataFrame, column: str, low: float | None = None, high: float | None = None, accuracy: int = 1000) -> float:
    """About the share of rows with low <= value <= high, from approximate quantiles: one aggregate of `accuracy` numbers."""
    steps = [i / 100 for i in range(101)]
    cuts = df.agg(F.percentile_approx(F.col(column).cast("double"), steps, accuracy)).first()[0]
    if not cuts:
        return 0.0
    return sum((low is None or c >= low) and (high is None or c <= high) for c in cuts) / len(cuts)


def latency_report(df: DataFrame, seconds: str = "seconds", threads: int = 1) -> DataFrame:
    """One row: number of queries, average, percentiles, and queries a second for so many threads."""
    p = [0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    out = df.agg(F.count("*").alias("queries"), F.avg(seconds).alias("average"), F.percentile(seconds, F.array(*map(F.lit, p))).alias("p"), (F.count("*") * threads / F.sum(seconds)).alias("qps"))
    return out.select("queries", "average", *[F.get("p", i).alias(f"p{round(100 * x)}") for i, x in enumerate(p)], "qps")
