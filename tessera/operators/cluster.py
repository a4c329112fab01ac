"""k-means cells, two-level clustering, and the cell-partitioned index that prunes a search to the nearest cells."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructType

from tessera.functions import metrics as M
from tessera.functions import quantize as Q
from tessera.operators.search import QUERY_BLOCK_BYTES, knn, scored
from tessera.sources.files import read_text, write_text


@dataclass
class Centroids:
    points: np.ndarray
    cosine: bool = False

    def distances(self, x: np.ndarray) -> np.ndarray:
        return M.score_matrix("COSINE" if self.cosine else "L2", x, self.points)

    def nearest(self, query: Sequence[float], n: int) -> list[int]:
        d = self.distances(np.asarray(query, np.float64)[None, :])[0]
        return sorted(range(len(d)), key=lambda i: (d[i], i))[:n]


def _assigned(df: DataFrame, centroids, vector: str, cell: str) -> DataFrame:
    """df with the number of the nearest centroid; -1 where there is no vector. A map over the rows."""
    where = df.sparkSession.sparkContext.broadcast(centroids)  # n_list points of fixed dimension
    schema = df.withColumn(cell, F.lit(0)).schema
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = where.value
        for batch in batches:
            cells = np.full(batch.num_rows, -1, np.int32)
            good, x = M.arrow_matrix(batch.column(at), c.points.shape[1])
            if len(good):
                cells[good] = c.distances(x).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], names=[*batch.schema.names, cell])

    return df.mapInArrow(run, schema)


#: Bytes of vectors near the border of two cells that the driver takes at once.
NEAR_BYTES = 16 << 20
#: Margins of vectors are counted by these steps.
MARGINS = 2.0 ** (np.arange(-80, 1) / 4)


def kmeans(df: DataFrame, vector: str, k: int, key: str, iterations: int | None = 10, seed: int = 7, cosine: bool = False, sample: int = 100_000) -> Centroids:
    """Lloyd's algorithm; vectors of another length or with nulls take no part. Starting points are spread out over a sample of at most `sample` rows (the smallest hashes of the key);
    each round sums and counts the vectors of each cell inside the tasks, so k sums a task travel. Empty cells keep their place.
    iterations None: until the points stay (to 1e-5). Fewer distinct vectors than k: fewer cells."""
    own = df.select(key, vector).where(F.col(vector).isNotNull())
    rows = own.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(min(sample, 50 * k)).select(vector).collect()
    size = max((len(r[0]) for r in rows), default=1)
    x = np.array([r[0] for r in rows if len(r[0]) == size and None not in r[0]], np.float64).reshape(-1, size)
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    points = _spread_out(x, min(k, len(x)), rng)
    return Centroids(_lloyd(own.select(F.lit(0).alias("group"), vector), points, np.zeros(len(points), int), iterations, cosine).reshape(-1, points.shape[1]), cosine)


def _lloyd(own: DataFrame, points: np.ndarray, groups: np.ndarray, iterations: int | None, cosine: bool) -> np.ndarray:
    """Points moved to the means of their cells until they stay. own: group, vector; a row belongs to the nearest point of its group.
    A round is one pass for all groups: tasks add up the vectors of each cell, so a sum for each point and task travels.
    iterations: rounds at most. With None, which can take hundreds, a round over all rows is followed by rounds in which only
    the vectors nearest to a border change cells: a second pass brings them, counted to be NEAR_BYTES at most. These rounds lower
    the same sum of distances, and it is always a round over all rows that finds that the points stay."""
    left = np.inf if iterations is None else iterations
    while len(points) and left > 0:
        total, count, margins = _sums(own, points, groups, cosine, iterations is None)
        new = _means(total, count, points)
        if np.allclose(new, points, atol=1e-8 * np.abs(points[np.isfinite(points)]).max(initial=0), equal_nan=True):
            break
        few = np.flatnonzero(np.cumsum(margins) * points.shape[1] * 8 <= NEAR_BYTES)
        if iterations is None and len(few):
            new = _near_rounds(points, new, total, count, groups, cosine, *_near(own, points, groups, cosine, MARGINS[few[-1]]))
        points, left = new, left - 1
    return points


def _means(total: np.ndarray, count: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.where(count[:, None] > 0, total / np.maximum(1, count)[:, None], points)


def _cells(points: np.ndarray, groups: np.ndarray, cosine: bool, group: np.ndarray, x: np.ndarray, margins: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector the nearest point of its group (-1 if that has none); with margins, by what part of both distances' sum the next
    point is farther, else infinity."""
    cell, margin = np.full(len(x), -1), np.full(len(x), np.inf)
    for g in np.unique(group):
        at, mine = np.flatnonzero(groups == g), np.flatnonzero(group == g)
        if len(at):
            d, row = Centroids(points[at], cosine).distances(x[mine]), np.arange(len(mine))
            best = d.argmin(1)
            cell[mine] = at[best]
            if margins and len(at) > 1:
                first = d[row, best]
                d[row, best] = np.inf
                second = d.min(1)
                margin[mine] = (second - first) / np.maximum(1e-300, second + first)
    return cell, margin


def _members(batch: pa.RecordBatch, points: np.ndarray, groups: np.ndarray, cosine: bool, margins: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups, vectors (of length 1 for cosine), cells and margins of the rows that have a cell."""
    good, x = M.arrow_matrix(batch.column(1), points.shape[1])
    group = batch.column(0).to_numpy(zero_copy_only=False)[good]
    cell, margin = _cells(points, groups, cosine, group, x, margins)
    if cosine:
        x = x / np.maximum(1e-12, np.sqrt((x * x).sum(1)))[:, None]
    own = cell >= 0
    return group[own], x[own], cell[own], margin[own]


def _sums(own: DataFrame, points: np.ndarray, groups: np.ndarray, cosine: bool, margins: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum and count of the vectors of each cell, and with margins for each of MARGINS how many lie at or below it and above the one before."""
    now = own.sparkSession.sparkContext.broadcast((points, groups))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, groups = now.value
        total, count, found = np.zeros_like(points), np.zeros(len(points), np.int64), np.zeros(len(MARGINS) + 1)
        for batch in batches:
            _, x, cell, margin = _members(batch, points, groups, cosine, margins)
            np.add.at(total, cell, x)
            count += np.bincount(cell, minlength=len(count))
            if margins:
                found += np.bincount(np.searchsorted(MARGINS, margin), minlength=len(found))
        used = np.flatnonzero(count)
        cells, rows, n = list(used), list(total[used]), list(count[used])
        if margins:  # as cell -1
            cells, rows, n = [*cells, -1], [*rows, found[:-1]], [*n, 0]
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), pa.array(rows, pa.list_(pa.float64())), pa.array(n, pa.int64())], names=["cell", "total", "n"])

    parts = own.mapInArrow(sums, "cell int, total array<double>, n long")
    added = parts.select("cell", "n", F.posexplode("total").alias("i", "x")).groupBy("cell", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    total, count, found = np.zeros_like(points), np.zeros(len(points), np.int64), np.zeros(len(MARGINS))
    for r in added.collect():  # points x dimension numbers
        if r.cell < 0:
            found[r.i] = r.x
        else:
            total[r.cell, r.i], count[r.cell] = r.x, r.n
    return total, count, found


def _near(own: DataFrame, points: np.ndarray, groups: np.ndarray, cosine: bool, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Groups and vectors of the rows with a margin of `most` or less."""
    now = own.sparkSession.sparkContext.broadcast((points, groups))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, groups = now.value
        for batch in batches:
            group, x, _, margin = _members(batch, points, groups, cosine, True)
            at = margin <= most
            if at.any():
                yield pa.RecordBatch.from_arrays([pa.array([group[at].astype(np.int64).tobytes()]), pa.array([x[at].tobytes()])], names=["group", "x"])

    rows = own.mapInArrow(near, "group binary, x binary").collect()  # NEAR_BYTES, as the margins were counted
    return np.frombuffer(b"".join(r.group for r in rows), np.int64), np.frombuffer(b"".join(r.x for r in rows), np.float64).reshape(-1, points.shape[1])


def _near_rounds(before: np.ndarray, points: np.ndarray, total: np.ndarray, count: np.ndarray, groups: np.ndarray, cosine: bool, group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Points after rounds in which only these vectors change cells, until none does. total, count: of all vectors, by the points before."""
    cell = _cells(before, groups, cosine, group, x)[0]
    while True:
        now = _cells(points, groups, cosine, group, x)[0]
        other = np.flatnonzero(now != cell)
        if not len(other):
            return points
        np.subtract.at(total, cell[other], x[other])
        np.add.at(total, now[other], x[other])
        count += np.bincount(now[other], minlength=len(count)) - np.bincount(cell[other], minlength=len(count))
        points, cell = _means(total, count, points), now


def _spread_out(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starting points."""
    if not k:
        return np.zeros((0, x.shape[1]))
    chosen = [x[rng.integers(len(x))]]
    d = ((x - chosen[0]) ** 2).sum(1)
    while len(chosen) < k:
        total = d.sum()
        nxt = x[rng.choice(len(x), p=d / total)] if total > 0 else x[len(chosen)]
        chosen.append(nxt)
        d = np.minimum(d, ((x - nxt) ** 2).sum(1))
    return np.array(chosen)


def assign_cells(df: DataFrame, centroids: Centroids, vector: str, cell: str = "cell_id") -> DataFrame:
    return _assigned(df, centroids, vector, cell)


def two_level(df: DataFrame, vector: str, key: str, outer: int, inner: int, iterations: int = 10, seed: int = 7) -> Centroids:
    """Stratified clustering: outer cells, then the outer centroids' own cells, as one list of centroids. Each outer cell is
    clustered by itself, all of them in the same passes; their starting points are spread out over at most 50 x inner rows of each."""
    first = kmeans(df, vector, outer, key, iterations, seed)
    own = assign_cells(df.select(key, vector), first, vector, "group").where("group >= 0")
    order = W.partitionBy("group").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    few = own.withColumn("at", F.row_number().over(order)).where(F.col("at") <= 50 * inner).orderBy("group", "at").select("group", vector).collect()
    rng, points, groups = np.random.default_rng(seed), [], []
    for g in sorted({r.group for r in few}):
        x = np.unique(np.array([r[1] for r in few if r.group == g], np.float64), axis=0)
        points.append(_spread_out(x, min(inner, len(x)), rng))
        groups += [g] * len(points[-1])
    if not points:
        return Centroids(first.points)
    return Centroids(_lloyd(own.select("group", vector), np.concatenate(points), np.array(groups), iterations, False))


def centroid_means(df: DataFrame, vector: str, cell: str) -> DataFrame:
    """Mean vector and size of each cell, in columns only."""
    flat = df.where(F.col(vector).isNotNull()).select(cell, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = flat.groupBy(cell, "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "x")))  # a dimension's worth of pairs
    return means.groupBy(cell).agg(F.transform(pairs, lambda p: p["x"]).alias("mean"), F.max("n").alias("n"))


class IvfIndex:
    """Rows written by cell: a search reads the folders of the nearest cells only."""

    def __init__(self, spark: SparkSession, path: str, vector: str, key: str, metric: str, centroids: Centroids, code: dict | None = None) -> None:
        self.spark, self.path, self.vector, self.key, self.metric, self.centroids, self.code = spark, path, vector, key, metric, centroids, code

    @classmethod
    def build(cls, df: DataFrame, path: str, vector: str, key: str, metric: str = "L2", n_list: int = 1024, n_iters: int = 10, seed: int = 7, max_records: int = 1_000_000, quantize: str | None = None, bits: int = 7, clusters: int = 16) -> IvfIndex:
        """Fit on all rows, assign every row, write by cell (n_list 0: all in one), with a quantizer as codes. Adaptive execution splits
        a cell that is too large for one task and joins small ones."""
        if n_list:
            centroids = kmeans(df, vector, n_list, key, n_iters, seed, metric in ("COSINE", "IP"))
            celled = assign_cells(df, centroids, vector).hint("rebalance", "cell_id")
        else:
            centroids = Centroids(np.zeros((0, 0)), metric in ("COSINE", "IP"))
            celled = df.withColumn("cell_id", F.lit(0))
        code = {"kind": quantize} if quantize else None
        if quantize == "RABITQ":
            near = kmeans(df, vector, clusters, key, 5, seed).points
            code |= {"bits": bits, "seed": seed, "dimension": near.shape[1], "centroids": near.tolist() or [[0.0] * near.shape[1]]}
        if quantize:
            celled = celled.withColumn(vector, Q.encoded(F.col(vector), code))
        celled.write.mode("overwrite").option("maxRecordsPerFile", max_records).partitionBy("cell_id").parquet(f"{path}/cells")
        meta = {"vector": vector, "key": key, "metric": metric, "cosine": centroids.cosine, "points": centroids.points.tolist(), "code": code}
        write_text(df.sparkSession, f"{path}/centroids.json", json.dumps(meta), overwrite=True)
        return cls(df.sparkSession, path, vector, key, metric, centroids, code)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IvfIndex:
        x = json.loads(read_text(spark, f"{path}/centroids.json"))
        return cls(spark, path, x["vector"], x["key"], x["metric"], Centroids(np.array(x["points"], np.float64), x["cosine"]), x.get("code"))

    def _stored(self, query: Sequence[float] | None = None, nprobe: int = 0) -> DataFrame:
        """Rows as they lie, for a query those of its nprobe nearest cells: of no other cell a file is read."""
        rows = self.spark.read.parquet(f"{self.path}/cells")
        if query is None or not len(self.centroids.points):
            return rows
        return rows.where(F.col("cell_id").isin(self.centroids.nearest(query, nprobe)))

    def _read(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.vector, Q.decoded(F.col(self.vector), self.code)) if self.code else rows

    def rows(self) -> DataFrame:
        """key, vector (as its code says it), cell_id."""
        return self._read(self._stored())

    def near(self, query: Sequence[float], nprobe: int) -> DataFrame:
        """Rows of the nprobe cells nearest to a query."""
        return self._read(self._stored(query, nprobe))

    def scored(self, query: Sequence[float], nprobe: int) -> DataFrame:
        """key, score of the rows of the nprobe cells nearest to a query; by the codes themselves if there are such."""
        score = Q.coded_score(F.col(self.vector), self.code, query, self.metric) if self.code else None
        if score is None:
            return scored(self.near(query, nprobe), query, self.vector, self.metric).select(self.key, "score")
        return self._stored(query, nprobe).select(self.key, score.alias("score")).where("score is not null")

    def search(self, query: Sequence[float], k: int, nprobe: int = 10, where: Column | None = None, radius: float | None = None) -> DataFrame:
        """The k best rows of the nprobe nearest cells; as many cells as there are makes it exact."""
        return knn(self.near(query, nprobe), query, k, self.key, self.vector, self.metric, where, radius).drop("cell_id")

    def search_batch(self, queries: DataFrame, k: int, nprobe: int, query_key: str, query_vector: str, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
        """query_id, key, score, rank (from 1) of the k best rows of the nprobe cells nearest to each query. As knn_batch: queries
        are broadcast in blocks whose size is counted, tasks keep k rows a query, and read only cells that a query probes."""
        base, dim = self.rows().select(self.key, self.vector, "cell_id"), self.centroids.points.shape[1]
        own = queries.select(query_key, query_vector).where(F.size(query_vector) == dim)
        blocks = max(1, -(-(own.count() * (dim * 8 + 64)) // block_bytes))
        schema = StructType().add("query_id", own.schema[query_key].dataType).add("key", base.schema[self.key].dataType).add("score", DoubleType())
        out = None
        for b in range(blocks):
            part = own.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b) if blocks > 1 else own
            rows = [r for r in part.collect() if None not in r[1]]  # block_bytes at most, but for the hash's unevenness
            points = np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)
            by_cell: dict[int, list[int]] = {}
            for i, order in enumerate(np.argsort(self.centroids.distances(points), 1, kind="stable")[:, :nprobe] if len(rows) and dim else []):
                for c in order.tolist():
                    by_cell.setdefault(c, []).append(i)
            shared = self.spark.sparkContext.broadcast(([r[0] for r in rows], points, by_cell))
            found = base.where(F.col("cell_id").isin(list(by_cell))).mapInArrow(_probe(shared, k, self.metric, to_arrow_schema(schema)), schema)
            out = found if out is None else out.unionByName(found)
        better = F.col("score").desc() if M.DESCENDING[self.metric] else F.col("score").asc()
        ranked = out.where(~F.col("score").isin(float("inf"), float("-inf"))).withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(better, "key")))
        return ranked.where(F.col("rank") <= k).select("query_id", F.col("key").alias(self.key), "score", "rank")


def _probe(shared, k: int, metric: str, schema: pa.Schema):
    """Of (key, vector, cell) rows the k best for each query among those in cells it probes."""
    sign = -1.0 if M.DESCENDING[metric] else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, by_cell = shared.value
        best: list[list[tuple[float, object]]] = [[] for _ in ids]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys, cells = part.column(0).to_pylist(), part.column(2).to_numpy(zero_copy_only=False)
                good, x = M.arrow_matrix(part.column(1), points.shape[1])
                for c in np.unique(cells[good]).tolist():
                    if c not in by_cell:
                        continue
                    mine = cells[good] == c
                    at_rows = good[mine]
                    s = sign * M.score_matrix(metric, x[mine], points[by_cell[c]])
                    for j, q in enumerate(by_cell[c]):
                        near = s[:, j]
                        limit = np.partition(near, k - 1)[k - 1] if len(near) > k else np.inf
                        best[q] = sorted(best[q] + [(near[i], keys[at_rows[i]]) for i in np.flatnonzero(near <= limit)])[:k]
        for q, rows in zip(ids, best, strict=True):
            if rows:
                columns = [[q] * len(rows), [key for _, key in rows], [sign * float(x) for x, _ in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    return run
