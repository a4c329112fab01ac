"""Quality classifier on supervised subword embeddings, trained by stochastic gradient descent in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import pieces, texts_of


@dataclass(frozen=True)
class Settings:
    """train_rows labelled texts at most, of at most train_bytes together, taken whole in the order of a hash of their ids, are collected
    for training; scoring takes whole texts of any length, block characters at a time."""

    buckets: int = 1 << 16
    dim: int = 12
    sizes: tuple[int, ...] = (2, 3, 4)
    epochs: int = 12
    rate: float = 0.8
    train_rows: int = 4000
    train_bytes: int = 48 << 20
    block: int = 1 << 17
    seed: int = 7


MIX = np.uint64(0x9E3779B97F4A7C15)
def _spread(h: np.ndarray, s: Settings) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX
    return ((h ^ (h >> np.uint64(32))) % np.uint64(s.buckets)).astype(np.int32)


def features(text: str, s: Settings) -> Iterator[np.ndarray]:
    """Buckets of the character n-grams (sizes s.sizes), the words and the word pairs of a text, block by block. n-grams that cross the
    edge of a block belong to the block before; a word that crosses it is two."""
    reach = max(s.sizes) - 1
    for at in range(0, len(text), s.block):
        end = min(len(text), at + s.block)
        b = np.frombuffer(text[at : end + reach].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        own = end - at
        h = np.zeros(len(b), np.uint64)
        for n in range(1, reach + 2):
            h = (h[: len(b) - n + 1] if n > 1 else h) * MIX + b[n - 1 :] + np.uint64(1) if len(b) >= n else h[:0]
            if n in s.sizes and len(h):
                yield _spread(h[:own] + np.uint64(n), s)
        b = b[:own]
        inside = (b != 32) & ((b < 9) | (b > 13))
        starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
        if len(starts):
            yield from _word_buckets(b, inside, starts, s)


def _word_buckets(b: np.ndarray, inside: np.ndarray, starts: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """Buckets of words and of word pairs. A word's hash is the sum over its characters of (character, place in the word), mixed; a pair's
    is the exclusive or of both, so that all repeated words share a bucket."""
    place = np.arange(len(b), dtype=np.uint64)
    first = np.zeros(len(b), np.uint64)
    first[starts] = starts.astype(np.uint64)
    place -= np.maximum.accumulate(first)
    x = (b + place * np.uint64(1114117) + np.uint64(3)) * MIX
    x = (x ^ (x >> np.uint64(31))) * MIX
    x[~inside] = 0
    h = np.add.reduceat(x, starts)
    yield _spread(h + np.uint64(0x5151), s)
    yield _spread((h[1:] ^ h[:-1]) + np.uint64(0x7272), s)


@dataclass
class Model:
    """Softmax over the mean of a text's feature vectors. With two classes, its log odds are a mean of one weight a feature, so
    that scoring needs only that table."""

    vectors: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    settings: Settings

    def weights(self) -> np.ndarray:
        return (self.vectors @ (self.out[:, 1] - self.out[:, 0])).astype(np.float64)

    def margin(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], s: Settings = Settings()) -> Model:  # noqa: B008
    """Learned by plain SGD, one text a step, with a rate that falls to 0. No texts: a model that scores 0.5."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out, bias = np.zeros((s.dim, 2), np.float32), np.zeros(2, np.float32)
    rows = []
    for t in texts:
        f = list(features(t, s))
        u, n = np.unique(np.concatenate(f), return_counts=True) if f else (np.zeros(0, np.int64), np.zeros(0))
        rows.append((u, (n / max(1, n.sum())).astype(np.float32)))
    steps, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            rate = s.rate * (1 - done / steps)
            done += 1
            u, share = rows[i]
            mean = share @ vectors[u] if len(u) else np.zeros(s.dim, np.float32)
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            if len(u):
                # share is spread over thousands of features: scaling by their concentration keeps the step of the mean even
                vectors[u] -= rate * np.outer(share / max(1e-6, float(share @ share)), back) * 0.05
    return Model(vectors, out, bias, s)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:  # noqa: B008
    """Learn from a bounded sample of the labelled documents that aren't held out: in the order of a hash of their ids, whoever still
    fits into train_rows and train_bytes, whatever its length. Rows with null ids, texts or labels are left out, repeated ones count
    once, of two labels the higher counts. No rows: a model that scores 0.5."""
    known = (
        labels.where("doc_id is not null and quality in (0, 1)").where(~held_out())
        .groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("id"), "id").limit(s.train_rows)
    )
    texts = docs.select(F.col("doc_id").alias("id"), "text").where("text is not null").withColumn("mark", F.xxhash64("text"))
    rows = texts.join(F.broadcast(known), "id").select("id", "mark", F.octet_length("text").alias("size"), "quality").distinct()  # train_rows ids at most
    left, chosen = s.train_bytes, []
    for r in rows.orderBy(F.xxhash64("id"), "id", "mark").limit(2 * s.train_rows).collect():
        if r.size <= left and len(chosen) < s.train_rows:
            left -= r.size
            chosen.append((r.id, r.mark, int(r.quality)))
    if not chosen:
        return train([], [], s)
    wanted = docs.sparkSession.createDataFrame(chosen, "id long, mark long, quality int")
    found = texts.join(F.broadcast(wanted), ["id", "mark"]).groupBy("id", "mark").agg(F.first("text").alias("text"), F.first("quality").alias("quality"))
    found = found.orderBy("id", "mark").collect()
    return train([r.text for r in found], [r.quality for r in found], s)


def scorer(docs: DataFrame, model: Model):
    """Function from a list of texts to their scores. Null and empty texts, which have no features, score by the bias alone."""
    weights, margin, s = docs.sparkSession.sparkContext.broadcast(model.weights()), model.margin(), model.settings

    def score(texts: list[str | None]) -> np.ndarray:
        table, odds = weights.value, []
        for text in texts:
            total, n = 0.0, 0
            for f in features(text or "", s):
                total += float(table[f].sum())
                n += len(f)
            odds.append(margin + total / max(1, n))
        return 1 / (1 + np.exp(-np.clip(np.array(odds, np.float64), -50, 50)))

    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted (score >= threshold). A map over the rows, no shuffle.

    Null and empty texts score by the bias alone; repeated rows are rows of their own with the same score; null ids are never held
    out; an empty table has an empty result; a text of any length is scored whole. Other columns are left behind."""
    score = scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            x = score(texts_of(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x), pa.array((x >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """docs, all columns, whatever their names, without the rows that score below threshold; null and empty texts score by the bias alone."""
    score = scorer(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield batch.filter(pa.array(score(texts_of(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
