"""Quantizers as Columns: each has a form to store and one to compute with again."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.metrics import let, norm_l2, normalize


def fp16(v: Column) -> Column:
    """Values rounded to half precision. Spark has no such type, so this is an Arrow-batched UDF: a batch is cast at once."""

    @F.pandas_udf("array<float>")
    def half(v: pd.Series) -> pd.Series:
        there = v.notna().to_numpy()
        rows = [np.asarray(x, np.float32) for x in v[there]]
        flat = np.concatenate(rows).astype(np.float16).astype(np.float32) if rows else np.zeros(0, np.float32)
        out = np.full(len(v), None, object)
        parts = np.split(flat, np.cumsum([len(x) for x in rows])[:-1]) if rows else []
        for i, x in zip(np.flatnonzero(there), parts, strict=True):
            out[i] = x
        return pd.Series(out)

    return half(v)


def _record(v: Column, steps: int, least: int) -> Column:
    """A record's own scale and bias: struct(codes, scale, bias); the value is codes * scale + bias."""

    def coded(x: Column) -> Column:
        low, high = F.array_min(x), F.array_max(x)
        grid = F.struct(low.alias("low"), F.when(high > low, F.lit(float(steps)) / (high - low)).otherwise(F.lit(1.0)).alias("scale"))

        def on_grid(g: Column) -> Column:
            codes = F.transform(x, lambda y: F.round((y - g["low"]) * g["scale"] + least).cast("tinyint"))
            return F.struct(codes.alias("codes"), (1 / g["scale"]).alias("scale"), (g["low"] - least / g["scale"]).alias("bias"))

        return let(grid, on_grid)

    return let(v.cast("array<double>"), coded)


def int8(v: Column) -> Column:
    return _record(v, 254, -127)


def int4(v: Column) -> Column:
    """Codes -8 to 7, two to a byte by pack_int4()."""
    return _record(v, 15, -8)


def pack_int4(codes: Column) -> Column:
    """Pairs of codes -8..7 in one byte, the first in the low half; an odd last one stands alone."""

    def packed(c: Column) -> Column:
        at = lambda i: F.coalesce(F.get(c, i), F.lit(0).cast("tinyint")).cast("int").bitwiseAND(F.lit(15))
        last = F.greatest(F.lit(0), F.floor((F.size(c) - 1) / 2).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: at(2 * i) + at(2 * i + 1) * 16)

    return let(codes, packed)


def unpack_int4(packed: Column, dimension: Column | int) -> Column:
    def unpacked(p: Column) -> Column:
        def code(i: Column) -> Column:
            b = F.get(p, F.floor(i / 2).cast("int"))
            half = F.when(i % 2 == 0, b.bitwiseAND(F.lit(15))).otherwise(F.floor(b / 16).cast("int"))
            return F.when(half > 7, half - 16).otherwise(half).cast("tinyint")

        return F.transform(F.sequence(F.lit(0), (F.lit(dimension) if isinstance(dimension, int) else dimension) - 1), code)

    return let(packed, unpacked)


def dequantize(q: Column) -> Column:
    return let(q, lambda s: F.transform(s["codes"], lambda c: c.cast("double") * s["scale"] + s["bias"]))


def cosine_normalized(v: Column) -> Column:
    """struct(unit, norm): the unit vector for search, the norm to get the vector back."""
    return let(v, lambda x: F.struct(normalize(x).alias("unit"), norm_l2(x).alias("norm")))


def revert_normalized(q: Column) -> Column:
    return let(q, lambda s: F.transform(s["unit"], lambda x: x * s["norm"]))


def binary(v: Column, threshold: float = 0.0, width: int = 32) -> Column:
    """Bits x >= threshold, `width` to a long, the first lowest."""
    bits = F.transform(v.cast("array<double>"), lambda x: (x >= threshold).cast("long"))

    def words(b: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(b) / width).cast("int") - 1))
        return F.transform(places, lambda w: F.aggregate(F.reverse(F.slice(b, w * width + 1, F.lit(width))), F.lit(0).cast("long"), lambda s, x: s * 2 + x))

    return let(bits, words)


def unbinary(words: Column, dimension: int, width: int = 32) -> Column:
    """1 or -1 for each bit."""
    i = F.sequence(F.lit(0), F.lit(dimension - 1))
    bit = lambda w, k: F.get(w, F.floor(k / width).cast("int")).bitwiseAND(F.pow(F.lit(2.0), k % width).cast("long")) != 0
    return let(words, lambda w: F.transform(i, lambda k: F.when(bit(w, k), F.lit(1.0)).otherwise(F.lit(-1.0))))


def mips_inject(v: Column, eta: Column | float, injection: str = "spherical", m: int = 3) -> Column:
    """Stored vectors scaled by eta to norms of at most 1, with the values that make nearest mean greatest product."""

    def injected(x: Column) -> Column:
        n2 = F.aggregate(x, F.lit(0.0), lambda s, y: s + y * y)
        if injection == "spherical":
            return F.concat(x, F.array(F.sqrt(F.greatest(F.lit(0.0), 1 - n2))))
        return let(n2, lambda n: F.concat(x, F.array(*[0.5 - F.pow(n, F.lit(2**i)) for i in range(m)])))

    return let(F.transform(v.cast("array<double>"), lambda y: y * eta), injected)


def train_global(df: DataFrame, column: str, bits: int = 8, bins: int = 2048, error: float = 1e-3) -> tuple[float, float]:
    """Scale and bias for one integer grid over all values of a column.

    The clipping range is that whose histogram, rounded to the grid, is nearest to the true one by relative entropy. One pass
    for the extremes, one for a histogram of `bins` counts, which is all that reaches the driver.
    """
    x = df.select(F.explode(F.col(column).cast("array<double>")).alias("x"))
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None or high == low:
        return 1.0, -float(low or 0)
    width = (high - low) / bins
    counts = np.zeros(bins)
    for r in x.groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("b")).count().collect():
        counts[int(r.b)] = r["count"]
    levels, best = 2**bits - 1, (np.inf, low, high)
    for cut in range(0, bins // 4, max(1, bins // 64)):
        kept = counts[cut : bins - cut].copy()
        kept[0] += counts[:cut].sum()
        kept[-1] += counts[bins - cut :].sum()
        cell = np.minimum(np.arange(len(kept)) * levels // len(kept), levels - 1)
        total, there = np.bincount(cell, kept, levels), np.bincount(cell, kept > 0, levels)
        rough = np.where(kept > 0, (total / np.maximum(there, 1))[cell], 0)
        p, q = kept / kept.sum(), rough / max(rough.sum(), 1)
        on = p > 0
        divergence = float((p[on] * np.log(p[on] / np.maximum(q[on], 1e-12))).sum()) + error * cut / bins
        if divergence < best[0]:
            best = (divergence, low + cut * width, high - cut * width)
    return levels / (best[2] - best[1]), -best[1] * levels / (best[2] - best[1]) - 2 ** (bits - 1)


def global_int(v: Column, scale: float, bias: float, bits: int = 8) -> Column:
    """Codes of one grid for all records, clipped."""
    low, high = -(2 ** (bits - 1)), 2 ** (bits - 1) - 1
    return F.transform(v.cast("array<double>"), lambda x: F.least(F.lit(high), F.greatest(F.lit(low), F.round(x * scale + bias))).cast("tinyint"))


def from_global_int(codes: Column, scale: float, bias: float) -> Column:
    return F.transform(codes, lambda c: (c.cast("double") - bias) / scale)


RABITQ = "struct<cluster:int,codes:binary,norm:double,factor:double>"


def _rabitq_of(x: np.ndarray, rotation: np.ndarray, centroids: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """Cluster, codes, norm and factor of each row."""
    cluster = ((x[:, None, :] - centroids[None]) ** 2).sum(2).argmin(1) if len(centroids) > 1 else np.zeros(len(x), int)
    r = x - centroids[cluster]
    norm = np.sqrt((r * r).sum(1))
    y = (r / np.where(norm > 0, norm, 1.0)[:, None]) @ rotation.T
    top = np.abs(y).max(1, initial=0.0)
    codes = np.clip(np.floor((y / np.where(top > 0, top, 1.0)[:, None] + 1) * 2 ** (bits - 1)), 0, 2**bits - 1)
    factor = ((codes - (2**bits - 1) / 2) * y).sum(1)
    return cluster.astype(np.int32), codes.astype(np.uint8), norm, np.where(factor > 0, factor, 1.0)


def rabitq(v: Column, rotation: np.ndarray, centroids: np.ndarray, bits: int = 7) -> Column:
    """RaBitQ codes: the residual to the nearest centroid, its direction randomly rotated and put on a grid of 1 (signs alone) to 8
    bits a value, with its length and the product of grid point and direction, by which products are estimated without bias:
    struct(cluster, codes, norm, factor). Null stays null."""
    centroids = np.atleast_2d(np.asarray(centroids, np.float64))

    @F.pandas_udf(RABITQ)
    def encode(s: pd.Series) -> pd.DataFrame:
        there = s.notna().to_numpy()
        out = pd.DataFrame({"cluster": pd.array([None] * len(s), "Int32"), "codes": None, "norm": np.nan, "factor": np.nan}, index=s.index)
        if there.any():
            x = np.array([np.asarray(a, np.float64) for a in s[there]])
            cluster, codes, norm, factor = _rabitq_of(np.nan_to_num(x), rotation, centroids, bits)
            out.loc[there, "cluster"], out.loc[there, "norm"], out.loc[there, "factor"] = cluster, norm, factor
            out.loc[there, "codes"] = pd.Series([c.tobytes() for c in codes], index=out.index[there], dtype=object)
        return out

    return F.when(v.isNotNull(), encode(v))


def from_rabitq(code: Column, rotation: np.ndarray, centroids: np.ndarray, bits: int = 7) -> Column:
    """The vector whose products with others are the estimates. Null stays null."""
    centroids = np.atleast_2d(np.asarray(centroids, np.float64))

    @F.pandas_udf("array<double>")
    def decode(d: pd.DataFrame) -> pd.Series:
        there = d["codes"].notna().to_numpy()
        out = np.full(len(d), None, object)
        if there.any():
            own = d[there]
            grid = np.array([np.frombuffer(c, np.uint8) for c in own["codes"]]) - (2**bits - 1) / 2
            y = grid * (own["norm"] / own["factor"]).to_numpy()[:, None]
            x = y @ rotation + centroids[own["cluster"].to_numpy(int)]
            for i, row in zip(np.flatnonzero(there), x, strict=True):
                out[i] = row
        return pd.Series(out)

    return decode(code)


def rabitq_score(code: Column, query: np.ndarray, rotation: np.ndarray, centroids: np.ndarray, metric: str = "L2", bits: int = 7) -> Column:
    """Estimated score from codes alone, which are never turned back: the products of integer codes with the rotated query. For L2 and IP;
    for COSINE of unit vectors, 1 - IP. Null for null."""
    query, centroids = np.asarray(query, np.float64), np.atleast_2d(np.asarray(centroids, np.float64))

    @F.pandas_udf("double")
    def estimate(d: pd.DataFrame) -> pd.Series:
        there = d["codes"].notna().to_numpy()
        out = np.full(len(d), np.nan)
        if there.any():
            own = d[there]
            codes = np.array([np.frombuffer(c, np.uint8) for c in own["codes"]])
            cluster, norm, factor = own["cluster"].to_numpy(int), own["norm"].to_numpy(), own["factor"].to_numpy()
            to = query - centroids if metric == "L2" else np.broadcast_to(query, centroids.shape)
            turned = to @ rotation.T
            product = np.einsum("ij,ij->i", codes, turned[cluster]) - (2**bits - 1) / 2 * turned.sum(1)[cluster]
            product *= norm / factor
            if metric == "L2":
                out[there] = norm**2 + (to**2).sum(1)[cluster] - 2 * product
            else:
                ip = (centroids @ query)[cluster] + product
                out[there] = ip if metric == "IP" else 1 - ip
        return pd.Series(out)

    return F.when(code.isNotNull(), estimate(code))


# --- codes of an index ------------------------------------------------------------------------------------------------------


def with_norm(q: Column) -> Column:
    """Codes of int8() or int4() with the squared length of the vector that they stand for, so that a search needs products alone."""
    square = lambda s: F.aggregate(dequantize(s), F.lit(0.0), lambda t, x: t + x * x)
    return let(q, lambda s: F.struct(s["codes"].alias("codes"), s["scale"].alias("scale"), s["bias"].alias("bias"), square(s).alias("norm2")))


def record_score(q: Column, query, metric: str) -> Column:
    """Score of codes with their norms, without turning them back: integer codes are multiplied with the query and added up, and the
    record's scale and bias come in once a row."""
    query = [float(x) for x in query]
    total, square = sum(query), sum(x * x for x in query)

    def of(s: Column) -> Column:
        dot = F.aggregate(F.zip_with(s["codes"], F.array(*[F.lit(x) for x in query]), lambda c, x: c * x), F.lit(0.0), lambda t, x: t + x)
        product = s["scale"] * dot + s["bias"] * total
        if metric == "IP":
            return product
        if metric == "L2":
            return s["norm2"] - 2 * product + square
        return F.when((s["norm2"] <= 0) | F.lit(square == 0), F.lit(1.0)).otherwise(1 - product / F.sqrt(s["norm2"] * square))

    return F.when(F.size(q["codes"]) == len(query), let(q, of))


def coded_score(q: Column, code: dict, query, metric: str) -> Column | None:
    """Score of what encoded() stores, from the codes themselves; None where only decoded vectors will do."""
    if metric not in ("L2", "IP", "COSINE"):
        return None
    if code["kind"] == "INT8":
        return record_score(q, query, metric)
    if code["kind"] == "INT4":
        whole = lambda s: F.struct(F.slice(unpack_int4(s["codes"], 2 * F.size(s["codes"])), 1, s["n"]).alias("codes"), s["scale"].alias("scale"), s["bias"].alias("bias"), s["norm2"].alias("norm2"))
        return let(q, lambda s: record_score(whole(s), query, metric))
    if code["kind"] == "RABITQ" and metric != "COSINE":
        return rabitq_score(q, np.array(query, np.float64), random_rotation(code["dimension"], code["seed"]), np.array(code["centroids"]), metric, code["bits"])
    return None


def encoded(v: Column, code: dict) -> Column:
    """A vector as an index stores it. code: its kind (FP16, INT8, INT4, RABITQ) and what that needs."""
    if code["kind"] == "FP16":
        return fp16(v)
    if code["kind"] == "INT8":
        return with_norm(int8(v))
    if code["kind"] == "INT4":
        own = F.struct(with_norm(int4(v)).alias("q"), F.size(v).alias("n"))
        return let(own, lambda s: F.struct(pack_int4(s["q"]["codes"]).alias("codes"), s["q"]["scale"].alias("scale"), s["q"]["bias"].alias("bias"), s["q"]["norm2"].alias("norm2"), s["n"].alias("n")))
    return rabitq(v, random_rotation(code["dimension"], code["seed"]), np.array(code["centroids"]), code["bits"])


def decoded(q: Column, code: dict) -> Column:
    """The vector that encoded() stands for."""
    if code["kind"] == "FP16":
        return q
    if code["kind"] == "INT8":
        return dequantize(q)
    if code["kind"] == "INT4":
        whole = lambda s: dequantize(F.struct(F.slice(unpack_int4(s["codes"], 2 * F.size(s["codes"])), 1, s["n"]).alias("codes"), s["scale"].alias("scale"), s["bias"].alias("bias")))
        return let(q, whole)
    return from_rabitq(q, random_rotation(code["dimension"], code["seed"]), np.array(code["centroids"]), code["bits"])


def random_rotation(dimension: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))
