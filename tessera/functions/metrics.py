"""Distances and products of vectors as Columns, and the same for many queries at once in numpy.

Scores are doubles. L2 is the squared distance and COSINE is 1 - cos (1 if a vector is zero), smaller is better; IP is the
product, greater is better.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument

#: Whether greater scores are better.
DESCENDING = {"L2": False, "IP": True, "COSINE": False, "MIPSL2": False, "HAMMING": False, "EUCLIDEAN": False}


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x with x evaluated once. Whatever a function for array elements takes from outside is evaluated for every element,
    and Spark may put a column's expression there; bound like this it is a value."""
    return F.get(F.transform(F.array(x), f), 0)


def vector_lit(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def inner_product(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm_l2(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def norm_l1(a: Column) -> Column:
    return _sum(F.transform(_doubles(a), F.abs))


def normalize(a: Column, p: int = 2) -> Column:
    """a divided by its norm; a zero vector stays."""

    def divided(v: Column) -> Column:
        norm = norm_l2(v) if p == 2 else norm_l1(v)
        return let(norm, lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n)))

    return let(_doubles(a), divided)


def cosine_distance(a: Column, b: Column) -> Column:
    n = norm_l2(a) * norm_l2(b)
    return F.when(n == 0, F.lit(1.0)).otherwise(1 - inner_product(a, b) / n)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which arrays of integers differ."""
    return _sum(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("double")))


def mips_l2(a: Column, b: Column, eta: Column | float, injection: str = "spherical", m: int = 3) -> Column:
    """Squared distance after the injection that turns a search for the greatest product into one for the nearest vector. eta
    scales a (all stored vectors) to norms of at most 1; b is normalised. spherical: one more value, sqrt(1 - |a|^2);
    quadratic: m more values, 0.5 - |a|^(2^i)."""
    y = normalize(b)

    def distance(x: Column) -> Column:
        n2, plain = _sum(F.transform(x, lambda v: v * v)), squared_l2(x, y)
        if injection == "spherical":
            return plain + F.greatest(F.lit(0.0), 1 - n2)
        gaps = let(n2, lambda n: sum(((0.5 - F.pow(n, F.lit(2**i))) * (0.5 - F.pow(n, F.lit(2**i))) for i in range(m)), F.lit(0.0)))
        return plain + gaps

    return let(F.transform(_doubles(a), lambda v: v * eta), distance)


def sparse_ip(indices: Column, values: Column, query: dict[int, float]) -> Column:
    """Product of a sparse column with a sparse query over the indices that both have."""
    if not query:
        return F.lit(0.0)
    known = F.create_map(*[F.lit(x) for k in sorted(query) for x in (int(k), float(query[k]))])
    return _sum(F.zip_with(indices, values, lambda i, v: F.coalesce(F.try_element_at(known, i.cast("int")), F.lit(0.0)) * v.cast("double")))


def sparse_squared_l2(indices: Column, values: Column, query: dict[int, float]) -> Column:
    mine = _sum(F.transform(values, lambda v: v.cast("double") * v.cast("double")))
    return mine + sum(float(x) ** 2 for x in query.values()) - 2 * sparse_ip(indices, values, query)


def score(metric: str, column: Column, query: Sequence[float]) -> Column:
    """Score of a dense column against a query; null where the vector is null or has another length."""
    q = vector_lit(query)
    by = {"L2": squared_l2, "IP": inner_product, "COSINE": cosine_distance, "EUCLIDEAN": euclidean}
    if metric not in by:
        raise InvalidArgument(f"metric {metric}")
    return F.when(F.size(column) == len(query), by[metric](column, q))


def score_matrix(metric: str, base: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Scores of rows of base (down) against rows of queries (across)."""
    a, b = base.astype(np.float64), queries.astype(np.float64)
    if metric == "IP":
        return a @ b.T
    if metric == "L2":
        return np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T))
    if metric == "COSINE":
        n = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(n == 0, 1.0, 1 - (a @ b.T) / n)
    raise InvalidArgument(f"metric {metric}")


def normalized_score(metric: str, s: Column) -> Column:
    """A score between 0 and 1, greater is better, for fusion with others."""
    if metric == "L2":
        return 1 - 2 * F.atan(s) / math.pi
    if metric == "IP":
        return 0.5 + F.atan(s) / math.pi
    if metric == "COSINE":
        return 1 - s / 2
    raise InvalidArgument(f"metric {metric}")


def arrow_matrix(column: pa.Array, dimension: int, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of an Arrow list column that are vectors of a dimension without nulls, and these as a matrix."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    places = np.flatnonzero(lengths == dimension)
    own = column.take(pa.array(places)) if len(places) < len(column) else column
    flat = pc.cast(own.flatten(), pa.from_numpy_dtype(kind))
    x = (flat.to_numpy(zero_copy_only=False) if not flat.null_count else pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)).reshape(len(places), dimension)
    if flat.null_count:
        gaps = np.asarray(flat.is_null().to_numpy(zero_copy_only=False)).reshape(len(places), dimension).any(1)
        return places[~gaps], x[~gaps]
    return places, x
