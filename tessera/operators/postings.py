"""The full-text index of a collection: postings by segment and term, written with the rows, merged and purged with them.

Layout: <root>/segment=<name>/bucket=<b>/*.parquet, rows (term, doc_id, tf, positions, length) in order of term and doc_id. Bucket
-1 has a row for each document with a text (term null, its length): what statistics and deletes need.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import InvalidArgument
from tessera.operators import fulltext as X
from tessera.schema import MAX_TOPK

#: Bytes of text for each bucket of a segment and for each file.
BUCKET_BYTES, FILE_BYTES = 256 << 20, 4 << 20
MOST_BUCKETS = 4096
#: Postings of a query from which on it pays to find out which of them matter.
PRUNE_FROM = 1_000_000
SCHEMA = "term string, doc_id long, tf int, positions array<int>, length int, segment string, bucket int"


@dataclass(frozen=True)
class Postings:
    """The postings of one field: its folder, and the number of buckets of each segment."""

    spark: SparkSession
    root: str
    buckets: dict[str, int]

    def read(self, segments: Sequence[str] | None = None) -> DataFrame:
        names = [s for s in self.buckets if segments is None or s in segments]
        if not names:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).option("basePath", self.root).parquet(*[f"{self.root}/segment={s}" for s in names])

    def of_terms(self, terms: Sequence[str]) -> DataFrame:
        """Postings of some terms: only their buckets are read, and in these only pages that may hold the terms."""
        if not terms:
            return self.read([])
        counts = sorted(set(self.buckets.values()))
        rows = self.spark.createDataFrame([(t,) for t in terms], "t string").select(*[F.pmod(F.xxhash64("t"), F.lit(n)).cast("int") for n in counts]).collect()
        wanted = F.lit(False)
        for k, n in enumerate(counts):
            mine = F.col("bucket").isin(sorted({r[k] for r in rows}))
            wanted = wanted | (mine if len(counts) == 1 else mine & F.col("segment").isin([s for s, b in self.buckets.items() if b == n]))
        return self.read().where((wanted if len(counts) > 1 else mine) & F.col("term").isin(list(terms)))

    def lengths(self, segments: Sequence[str] | None = None) -> DataFrame:
        """doc_id, length of each document with a text."""
        return self.read(segments).where("bucket = -1").select("doc_id", "length")


def _store(p: DataFrame, at: str, text_bytes: int) -> int:
    """Write postings of a segment; returns the number of buckets."""
    buckets = min(MOST_BUCKETS, 1 << max(0, (ceil(text_bytes / BUCKET_BYTES) - 1).bit_length()))
    files = max(1, ceil(text_bytes / FILE_BYTES))
    own = p.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(buckets))).cast("int"))
    own = own.coalesce(1) if files == 1 else own.repartitionByRange(files, "bucket", "term", "doc_id")
    # small pages within a file tell by their least and greatest terms which of them a search needs
    own.sortWithinPartitions("bucket", "term", "doc_id").write.option("parquet.page.row.count.limit", "2000").partitionBy("bucket").parquet(at)
    return buckets


def write(docs: DataFrame, root: str, segment: str, text: str, analyzer: X.Analyzer) -> int:
    """Postings of a new segment's rows (doc_id and the text column); returns the number of buckets."""
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    own = docs.select("doc_id", F.col(f"`{text}`").alias("text"))
    p = X.postings(own, "doc_id", "text", analyzer, lengths=True).withColumnRenamed("key", "doc_id")
    return _store(p, f"{root}/segment={segment}", size)


def merge(old: Postings, segment: str, gone: DataFrame | None) -> int:
    """The postings of old segments as those of one new segment, without deleted documents: no text is read again."""
    p = old.read().drop("segment", "bucket")
    if gone is not None:
        p = p.join(gone, "doc_id", "left_anti")
    # about what the texts were: a posting stands for some ten bytes of text
    size = 10 * sum(old.read([s]).count() for s in old.buckets)
    return _store(p, f"{old.root}/segment={segment}", size)


def search(index: Postings, node, k: int | None, docs: int, tokens: int, gone: DataFrame | None = None, among: DataFrame | None = None, prune_from: int = PRUNE_FROM) -> DataFrame:
    """doc_id and score > 0, the k best first (all, unordered, for None).

    BM25 from postings alone. docs and tokens count all live documents with a text; a term's document frequency is that of
    its live postings. Only postings of the query's terms are read, without positions unless there is a phrase; what is
    shuffled is a row for each of them, less those that can't decide the k best once there are prune_from of them. gone: documents that are deleted; among: those that may be found.
    """
    node = X.simplify(node)
    empty = index.spark.createDataFrame([], "doc_id long, score double")
    if isinstance(node, X.Empty) or k == 0 or not index.buckets:
        return empty
    if k is not None and not 0 < k <= MAX_TOPK:
        raise InvalidArgument(f"topk {k}")
    needed = X.terms_of(node)
    phrased = sorted({t for p in X.phrases_of(node) for t in p.terms})
    own = index.of_terms(needed)
    if gone is not None:
        own = own.join(gone, "doc_id", "left_anti")
    frequency = {r.term: r["count"] for r in own.groupBy("term").count().collect()}  # a row for each term of the query
    if not any(frequency.values()):
        return empty
    if among is not None:
        own = own.join(among, "doc_id", "left_semi")
    average = float(tokens / docs) if docs and tokens else 1.0
    flat = node.parts if isinstance(node, X.Or) and all(isinstance(p, X.Term) for p in node.parts) else ()
    if k is not None and len(flat) > 1 and sum(frequency.values()) >= prune_from:
        own = _promising(own, {p.text: p.boost for p in flat}, frequency, docs, average, k)
    scored = _scored(own, node, needed, phrased, frequency, docs, average)
    return scored if k is None else scored.orderBy(F.col("score").desc(), "doc_id").limit(k)


def _scored(own: DataFrame, node, needed: Sequence[str], phrased: Sequence[str], frequency: dict[str, int], docs: int, average: float) -> DataFrame:
    """doc_id and score > 0 of the documents that match, from their postings."""
    at = {t: i for i, t in enumerate(needed)}
    mine = lambda t, c: F.when(F.col("term") == t, F.col(c))
    rows = own.groupBy("doc_id").agg(
        F.max("length").cast("double").alias("length"),
        *[F.coalesce(F.max(mine(t, "tf")), F.lit(0)).cast("double").alias(f"tf{i}") for t, i in at.items()],
        *[F.first(mine(t, "positions"), ignorenulls=True).alias(f"at{at[t]}") for t in phrased],
    )

    def weight(t: str) -> Column:
        rarity = X.idf(F.lit(float(docs)), F.lit(float(frequency.get(t, 0))))
        return rarity * X.term_weight(F.col(f"tf{at[t]}"), F.col("length"), F.lit(average))

    def side_by_side(terms: Sequence[str]) -> Column:
        """Whether some position of the first term is followed by positions of the others."""
        following = lambda p: reduce(lambda a, b: a & b, [F.array_contains(f"at{at[t]}", p + i) for i, t in enumerate(terms[1:], 1)], F.lit(True))
        return F.exists(f"at{at[terms[0]]}", following)

    hit, total = X.points(node, lambda t: F.col(f"tf{at[t]}"), weight, side_by_side)
    return rows.where(hit).select("doc_id", total.alias("score")).where("score > 0")


def _promising(own: DataFrame, boosts: dict[str, float], frequency: dict[str, int], docs: int, average: float, k: int) -> DataFrame:
    """Postings of an OR of terms without those that can't decide its k best.

    The k-th best score by the rarest terms alone is a limit that the answer can't fall below. Frequent terms that even together
    can't reach it (a term adds less than its idf times K1 + 1) decide nothing alone: of their postings only those of documents
    with another term are kept, so that the long lists of frequent words aren't shuffled.
    """
    most = {t: boost * max(0.0, log((docs - frequency.get(t, 0) + 0.5) / (frequency.get(t, 0) + 0.5) + 1)) * (X.K1 + 1) for t, boost in boosts.items()}
    rare, held = [], 0
    for t in sorted(boosts, key=lambda t: (frequency.get(t, 0), t)):
        if held < k:
            rare.append(t)
            held += frequency.get(t, 0)
    if len(rare) == len(boosts):
        return own
    part = X.Or(tuple(X.Term(t, boosts[t]) for t in rare))
    best = _scored(own.where(F.col("term").isin(rare)), part, rare, [], frequency, docs, average).orderBy(F.col("score").desc()).limit(k).agg(F.count("*"), F.min("score")).first()
    if best[0] < k:
        return own
    idle, total = [], 0.0
    for t in sorted(set(boosts) - set(rare), key=lambda t: (most[t], t)):
        if total + most[t] >= best[1] * (1 - 1e-9):
            break
        total += most[t]
        idle.append(t)
    if not idle:
        return own
    deciding = own.where(~F.col("term").isin(idle))
    return deciding.unionByName(own.where(F.col("term").isin(idle)).join(deciding.select("doc_id").distinct(), "doc_id", "left_semi"))
