"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import IN_ORDER, LOWER_ASCII, discard, free_name, pieces, stash, stash_sorted, texts_of, unsorted

#: White space stripped from a line to get its key, and code points that a key needs to count.
BLANK, LEAST = b" \t\n\x0b\x0c\r", 10


def line_hash(line: str) -> bytes | None:
    """128 bits of a line's key, None for a key that is too short."""
    key = line.encode("utf-8", "surrogatepass").strip(BLANK)
    if len(key) < LEAST or len(key) < 4 * LEAST and len(key.decode("utf-8", "surrogatepass")) < LEAST:
        return None
    return hashlib.blake2b(key.translate(LOWER_ASCII), digest_size=16).digest()


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a checksum of the text) and the hash of each line key in it, once a row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            rows, hashes = [], []
            for k, text in enumerate(texts_of(batch)):
                own = {h for line in (text or "").split("\n") if (h := line_hash(line))}
                rows += [k] * len(own)
                hashes += own
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(hashes, pa.binary())], names=["doc_id", "mark", "hash"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    return own.mapInArrow(run, "doc_id long, mark long, hash binary")


class LineRuns:
    """What is known of line keys: runs of (hash, owner), each a table of buckets by hash, sorted by hash, in levels.

    A batch's new hashes become a run of level 0. When a level has `fan_out` runs they are merged into one run of the next
    level, so that after n batches a hash has been rewritten log(n) times and a batch meets few runs. Runs are disjoint, so
    merging needs no aggregation. Batches must come in ascending order of doc_id: then the owner is the smallest doc_id that
    holds the key. Null ids are one document that comes last.

    A batch's hashes are dealt and sorted once; against that each run is merged as it lies on disk, without exchange or sort.
    """

    def __init__(self, spark: SparkSession, fan_out: int = 3) -> None:
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unknown(self, occurrences: DataFrame) -> DataFrame:
        """Hashes of a batch that no run has, with their owners."""
        first = occurrences.groupBy("hash").agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            first = first.join(run.select("hash").hint("merge"), "hash", "left_anti")
        return first

    def add(self, occurrences: DataFrame) -> DataFrame:
        """Take in a batch of (doc_id, mark, hash); returns, stashed, those of them that are repeats."""
        before = self.spark.conf.get(IN_ORDER, "false")
        self.spark.conf.set(IN_ORDER, "true")
        try:
            fresh = stash_sorted(self.unknown(occurrences), "line-run", "hash", self.buckets)
        finally:
            self.spark.conf.set(IN_ORDER, before)
        # joined on both columns, a key that a third of the documents have is spread over all tasks
        own = unsorted(fresh).select(F.col("hash").alias("__hash"), "owner").hint("merge")
        repeats = stash(occurrences.join(own, (F.col("hash") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("owner")), "left_anti"), "line-repeats")
        self._push(fresh, 0)
        return repeats

    def _push(self, run: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fan_out:
            old, merged = self.levels[level], unsorted(self.levels[level][0])
            for other in old[1:]:
                merged = merged.unionByName(unsorted(other))
            self.levels[level] = []
            self._push(stash_sorted(merged, "line-run", "hash", self.buckets), level + 1)
            for x in old:
                discard(x)

    def close(self) -> None:
        for run in self.runs():
            discard(run)
        self.levels = []


def id_ranges(docs: DataFrame, n: int) -> list[str]:
    """Conditions that part the rows into n ranges of ascending doc_id of about equal numbers of rows; nulls are in the last."""
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [k / n for k in range(1, n)], 1000)).first()[0] if n > 1 else []
    cuts = sorted(set(cuts or []))
    edges = [None, *cuts, None]
    out = []
    for low, high in zip(edges, edges[1:]):
        parts = ([f"doc_id > {low}"] if low is not None else []) + ([f"doc_id <= {high}"] if high is not None else [])
        out.append(" and ".join(parts) or "doc_id is not null")
    out[-1] = f"({out[-1]}) or doc_id is null"
    return out


#: Bytes of text for each shuffle partition that make a batch.
PART_BYTES = 4 << 20


def dedup_lines(docs: DataFrame, batches: int | None = None, fan_out: int = 3) -> DataFrame:
    """docs (all columns) with text cut to the lines that stay, and __n_lines, __n_dropped.

    A line whose key (stripped, A-Z lowered) has 10 code points or more and is found in several documents stays only in that
    with the smallest doc_id. Rows with equal doc_id are one document; rows with null ids are one, after all others; null and
    empty texts are one empty line. A document that loses all lines keeps an empty text. An empty table has an empty result;
    a text of any length is read whole, and one task holds the hashes of its lines. Columns of docs named __n_lines or __n_dropped
    are replaced; all others, whatever their names, stay.

    The documents are read in ranges of doc_id (by default as many as bring PART_BYTES of text to each shuffle partition), each
    checked against the runs so far. Only hashes are shuffled for that; at the end the repeated hashes of each row meet its text in
    one join. A key in a third of the documents is met by partial aggregation and by joins on more than the key.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in ("__n_lines", "__n_dropped")]
    docs = docs.select(*names)
    if batches is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        batches = max(1, ceil(size / (PART_BYTES * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    runs, found = LineRuns(spark, fan_out), []
    for condition in id_ranges(docs, batches):
        occurrences = stash(line_hashes(docs.where(condition)), "line-hashes")
        found.append(runs.add(occurrences))
        discard(occurrences)
    runs.close()
    repeats = found[0]
    for other in found[1:]:
        repeats = repeats.unionByName(other)
    own, mark, gone = (free_name(docs, x) for x in ("__id", "__mark", "__drops"))
    drops = repeats.groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark)).agg(F.collect_set("hash").alias(gone))
    joined = docs.join(drops, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark)), "left").select(*names, gone)
    schema = docs.select(*names, F.lit(0).cast("long").alias("__n_lines"), F.lit(0).cast("long").alias("__n_dropped")).schema

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1024):
            cols = dict(zip(names, batch.columns, strict=False))
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(cols["text"].to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                gone = set(drop or ())
                kept = [x for x in lines if line_hash(x) not in gone] if gone else lines
                texts.append(text if len(kept) == len(lines) else "\n".join(kept))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            cols |= {"text": pa.array(texts, pa.string()), "__n_lines": pa.array(n_lines, pa.int64()), "__n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema], names=[f.name for f in schema])

    return joined.mapInArrow(rebuild, schema)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


OP5_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT doc_id, line, i, translate(regexp_replace(regexp_replace(line, '^[ \x09-\x0D]+', ''), '[ \x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, k.i, k.line, owner IS NOT NULL AND owner <> k.doc_id AS gone FROM k LEFT JOIN r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""
