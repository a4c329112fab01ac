"""Fusion of ranked lists and reranking by models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol, runtime_checkable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.functions.metrics import DESCENDING, normalized_score
from tessera.sources.files import scratch


@runtime_checkable
class Reranker(Protocol):
    topn: int

    def rerank(self, results: dict[str, DataFrame], key: str) -> DataFrame: ...


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ranked(df: DataFrame, metric: str, key: str) -> DataFrame:
    """A result list with its ranks from 0. Lists are a query's top k, so one task may order them."""
    better = F.col("score").desc() if DESCENDING.get(metric, True) else F.col("score").asc()
    return df.withColumn("rank", F.row_number().over(W.orderBy(better, key)) - 1)


@dataclass
class RrfReranker:
    """Reciprocal rank fusion: a document's score is the sum of 1 / (rank_constant + rank + 1) over the lists that hold it."""

    topn: int = 10
    rank_constant: int = 60
    rerank_field: str | None = None
    metrics: dict[str, str] = field(default_factory=dict)

    def rerank(self, results: dict[str, DataFrame], key: str = "pk") -> DataFrame:
        if not results:
            raise InvalidArgument("nothing to rerank")
        lists = [ranked(df, self.metrics.get(name, "BM25"), key).select(key, (1.0 / (self.rank_constant + F.col("rank") + 1)).alias("part")) for name, df in sorted(results.items())]
        fused = _united(lists).groupBy(key).agg(F.sum("part").alias("score"))
        return fused.orderBy(F.col("score").desc(), key).limit(self.topn)


@dataclass
class WeightedReranker:
    """Scores, brought to 0..1 by each list's metric, times the list's weight (1 if none is given), added up."""

    metrics: dict[str, str]
    topn: int = 10
    weights: dict[str, float] = field(default_factory=dict)
    rerank_field: str | None = None

    def rerank(self, results: dict[str, DataFrame], key: str = "pk") -> DataFrame:
        if not results:
            raise InvalidArgument("nothing to rerank")
        parts = []
        for name, df in sorted(results.items()):
            if name not in self.metrics:
                raise InvalidArgument(f"no metric for {name}")
            parts.append(df.select(key, (normalized_score(self.metrics[name], F.col("score")) * float(self.weights.get(name, 1.0))).alias("part")))
        fused = _united(parts).groupBy(key).agg(F.sum("part").alias("score"))
        return fused.orderBy(F.col("score").desc(), key).limit(self.topn)


@dataclass
class CallbackReranker:
    """Whatever the callback makes of the lists (DataFrames by name): a DataFrame with key and score."""

    callback: Callable[[dict[str, DataFrame]], DataFrame]
    topn: int = 10
    rerank_field: str | None = None

    def rerank(self, results: dict[str, DataFrame], key: str = "pk") -> DataFrame:
        return self.callback(results).orderBy(F.col("score").desc(), key).limit(self.topn)


@dataclass
class ModelReranker:
    """A scoring model for (query, text) pairs over the distinct documents of all lists; documents without text are left out.

    model: takes a list of pairs, returns as many scores; it runs in the executors, a batch at a time.
    """

    query: str
    model: Callable[[list[tuple[str, str]]], list[float]]
    rerank_field: str
    topn: int = 10

    def rerank(self, results: dict[str, DataFrame], key: str = "pk") -> DataFrame:
        if not self.query:
            raise InvalidArgument("no query to rerank by")
        if not results:
            raise InvalidArgument("nothing to rerank")
        model, query = self.model, self.query

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series(model([(query, t) for t in texts]), dtype="float64")

        docs = _united([df.select(key, self.rerank_field) for _, df in sorted(results.items())]).dropDuplicates([key])
        docs = docs.where(F.length(F.trim(self.rerank_field)) > 0)
        return docs.withColumn("score", scores(self.rerank_field)).orderBy(F.col("score").desc(), key).limit(self.topn)


# --- embeddings ---------------------------------------------------------------------------------------------------------------


@runtime_checkable
class DenseEmbedding(Protocol):
    """A model from a value to a dense vector; embed_all is optional and takes a list."""

    dimension: int

    def embed(self, value: Any) -> list[float]: ...


@runtime_checkable
class SparseEmbedding(Protocol):
    """A model from a value to weights by dimension."""

    def embed(self, value: Any) -> dict[int, float]: ...


def embed_column(df: DataFrame, column: str, model: DenseEmbedding, out: str = "embedding") -> DataFrame:
    """df with the model's vectors; null stays null. The model is sent to the executors and sees a batch at a time."""
    many = getattr(model, "embed_all", None) or (lambda values: [model.embed(v) for v in values])

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            known = values[values.notna()]
            vectors = iter([[float(x) for x in v] for v in many(list(known))])
            yield values.map(lambda v: None if v is None else next(vectors))

    return df.withColumn(out, run(column))


def embed_sparse_column(df: DataFrame, column: str, model: SparseEmbedding, out: str = "embedding") -> DataFrame:
    """df with struct(indices, values): positive weights only, by rising index."""

    @F.pandas_udf("struct<indices:array<long>,values:array<float>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            found = [sorted((int(k), float(w)) for k, w in model.embed(v).items() if w > 0) if v is not None else [] for v in values]
            yield pd.DataFrame({"indices": [[k for k, _ in x] for x in found], "values": [[w for _, w in x] for x in found]})

    return df.withColumn(out, run(column))


def bm25_vectors(docs: DataFrame, key: str, text: str, analyzer=None, query: bool = False, dimensions: int = 1 << 24) -> DataFrame:
    """key, vector: documents as sparse vectors of BM25 term weights (query: of idf), dimensions by a hash of the term. The
    product of a document's vector with a query's 0/1 vector is its BM25 score."""
    from tessera.operators import fulltext as X

    analyzer = analyzer or X.Analyzer()
    at = scratch(docs.sparkSession, "bm25")
    X.postings(docs, key, text, analyzer).drop("positions").write.parquet(at)  # texts are split into terms once
    p = docs.sparkSession.read.parquet(at)
    stats = X.corpus_stats(docs, text, analyzer)
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    own = p.join(df, "term").crossJoin(F.broadcast(stats))
    idf = X.idf(F.col("total_docs").cast("double"), F.col("df").cast("double"))
    average = F.col("total_tokens") / F.col("total_docs")
    weight = idf if query else idf * X.term_weight(F.col("tf").cast("double"), F.col("length").cast("double"), average)
    slot = F.pmod(F.xxhash64("term"), F.lit(dimensions))
    own = own.select("key", slot.alias("i"), weight.alias("w")).where("w > 0").groupBy("key", "i").agg(F.sum("w").alias("w"))
    pairs = F.array_sort(F.collect_list(F.struct("i", "w")))  # a document's own terms
    return own.groupBy("key").agg(F.struct(F.transform(pairs, lambda x: x["i"]).alias("indices"), F.transform(pairs, lambda x: x["w"].cast("float")).alias("values")).alias("vector")).withColumnRenamed("key", key)
