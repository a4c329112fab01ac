"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import discard, pieces, stash, texts_of, words

WINDOW = 10
#: UTF-8 bytes of benchmark text whose windows one pass over the documents broadcasts (about 250 MB of a worker's memory); a
#: larger benchmark takes several passes.
BLOCK_BYTES = 4 << 20


class WuManber:
    """Patterns are sequences of words. Those of one length share a table of shifts by block (two neighbouring words, or one
    word for patterns of one): how far the search may move on when it sees that block at the window's end. Blocks that end a
    pattern shift by 0 and name the bucket of patterns to compare word by word."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]) -> None:
        self.groups: list[tuple[int, int, dict, dict]] = []
        for m in sorted({len(p) for p in patterns}):
            own = [p for p in patterns if len(p) == m]
            b = min(2, m)
            shift: dict[tuple[bytes, ...], int] = {}
            buckets: dict[tuple[bytes, ...], list] = {}
            for p in own:
                for end in range(b, m + 1):
                    block = p[end - b : end]
                    shift[block] = min(shift.get(block, m), m - end)
                buckets.setdefault(p[m - b :], []).append((p[0], list(p), patterns[p]))
            self.groups.append((m, b, shift, buckets))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """Every occurrence: first word, number of words, the pattern's items."""
        n = len(text)
        for m, b, shift, buckets in self.groups:
            far, step, at = m - b + 1, shift.get, m - 1
            while at < n:
                block = (text[at - 1], text[at]) if b == 2 else (text[at],)
                s = step(block, far)
                if s:
                    at += s
                    continue
                start = at - m + 1
                head = text[start]
                for first, pattern, items in buckets[block]:
                    if first == head and text[start : at + 1] == pattern:
                        yield start, m, items
                at += 1


def windows(items: list[tuple[int, str | None]], size: int = WINDOW) -> dict[tuple[bytes, ...], list[int]]:
    """Each run of `size` consecutive words of an item (all words of a shorter one), with the items that hold it."""
    out: dict[tuple[bytes, ...], set[int]] = {}
    known: dict[bytes, bytes] = {}
    for item, text in items:
        w = [known.setdefault(x, x) for x in words(text)]
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(item)
    return {k: sorted(v) for k, v in out.items()}


def find_items(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, kept (a struct of the columns in keep), n_words, n_hit and items (sorted item ids with occurring windows).

    No shuffle: the benchmark's windows are broadcast, a block of at most about block_bytes of its text at a time (an item is never
    cut), and each block is one pass over the documents; hit words and items carry over from pass to pass through a written table,
    so that one block's windows are held at a time. Items with a null id are left out; null and empty texts have no words; repeated
    documents are rows of their own; repeated items count once. An empty table has an empty result, and an empty benchmark hits
    nothing; a text of any length is searched whole by one task. Columns of any name may be kept.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    n_blocks = max(1, ceil((bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / block_bytes))
    kept = F.struct(*(F.col(c) for c in keep)) if keep else F.lit(None).cast("int")
    state = docs.select(
        "doc_id", "text", kept.alias("kept"), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.lit(b"").alias("mask"), F.array().cast("array<long>").alias("items"),
    )
    names = state.columns

    def search(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
        machine = WuManber(matcher.value)
        for batch in pieces(batches):
            cols = dict(zip(names, batch.columns, strict=True))
            counts, masks, items = [], [], []
            for text, mask, had in zip(texts_of(batch), cols["mask"].to_pylist(), cols["items"].to_pylist(), strict=True):
                w = words(text)
                hits, got = None, None
                for start, m, of in machine.find(w):
                    if hits is None:
                        hits, got = bytearray(mask or bytes(len(w))), set(had)
                    hits[start : start + m] = b"\1" * m
                    got.update(of)
                counts.append(len(w))
                masks.append(mask if hits is None else bytes(hits))
                items.append(had if got is None else sorted(got))
            cols |= {
                "n_words": pa.array(counts, pa.int64()), "n_hit": pa.array([m.count(1) for m in masks], pa.int64()),
                "mask": pa.array(masks, pa.binary()), "items": pa.array(items, pa.list_(pa.int64())),
            }
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    for k in range(n_blocks):
        block = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == k) if n_blocks > 1 else bench
        matcher = spark.sparkContext.broadcast(windows([(r.item_id, r.text) for r in block.toLocalIterator()], size))
        found = state.mapInArrow(lambda batches, matcher=matcher: search(batches, matcher), state.schema)
        if k < n_blocks - 1:
            found = stash(found, "decontaminate")
            matcher.destroy()
            discard(state)
        state = found
    return state.drop("mask")


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row a document: n_words, n_hit, n_items, items_sha256, contaminated."""
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return find_items(docs, benchmark, size).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """docs, all columns, without the rows that hold a window of the benchmark."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    clean = find_items(docs, benchmark, size, keep=rest).where("n_hit = 0")
    return clean.select(*(F.col(c) if c in ("doc_id", "text") else F.col("kept")[c].alias(c) for c in docs.columns))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP2_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT item_id, w, least(10, len(w)) AS m FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT m FROM win),
spot AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM dw, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item_id FROM spot JOIN win USING (m, s)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS l FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
