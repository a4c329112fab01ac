"""A training corpus from raw documents: good ones, without repeated lines, near copies and benchmark passages, as tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, linededup, neardup, quality
from tessera.llm._shared import discard, settled

# All stages: null ids and repeated rows are rows of their own, an empty table has an empty result, texts of any length are taken
# whole, and further columns, whatever their names, stay as they are (the last stage leaves them behind).


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among docs, doesn't reject. A null or empty text has the classifier's
    score of no features; repeated rows share a fate."""
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def unrepeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the lines that no document of smaller id holds; n_chars follows. No row goes: one that loses all lines has an
    empty text, a null text stays null. Rows without an id are one document after all others."""
    cut = linededup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest id (with all its rows). Rows without an id, and texts without words, stay."""
    return neardup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Null and empty texts hold none."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens, their number and digest, and the digest of what they decode to. A null text has no tokens."""
    return bpe.encode_digest(docs, bpe.vocabulary_path(), with_ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("line dedup", unrepeated_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokens),
]

#: The classifier is learned: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it; what a stage wrote on the way, and what
    the one before it wrote, is removed then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before = docs
        docs = settled(lambda: stage(spark, before, sf_dir), "stage")  # noqa: B023
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
