"""Byte-balanced contiguous sharding from global prefix sums, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm._shared import stash


def byte_size(text: Column) -> Column:
    """UTF-8 bytes of a text (none for null) and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign_shards(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> DataFrame:
    """Cut the rows, in the order of their ids, into n_shards contiguous shards of nearly equal bytes.

    Law ``bytes``. Only (id, size, checksum) travel: they are range-partitioned by id and written to the shared folder, so
    that the partition numbers stay fixed. Each partition's bytes and rows are summed; prefix sums over these totals (a row
    a partition) give every partition its offset, and a running sum inside the partition gives every row its own. A row
    belongs to the shard in which its middle byte lies, so a shard differs from the target by at most one row at each end.

    What reaches the driver is the sample by which Spark cuts the ranges: at most 300 rows of ids, sizes and checksums for each
    partition that is made (spark.sql.execution.rangeExchange.sampleSizePerPartition, three times over), however many rows there are.

    Null texts have size 1 and checksum 0; null ids come first; rows with equal ids follow one another by checksum, size and
    place of input. An empty table gives an empty result; other columns of the input are left behind.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.col(text_col)
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        byte_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("tie")]
    placed = stash(narrow.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shard-order")

    totals = placed.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("part_bytes").over(everything).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    ranked = placed.select(
        "part", "doc_id", "size", "text_crc32",
        F.sum("size").over(inside).alias("to_here"), F.count("*").over(inside).alias("rank"),
    ).join(offsets, "part")
    middle = 2 * (F.col("bytes_before") + F.col("to_here")) - F.col("size")
    sharded = ranked.select(
        "doc_id", "size", "text_crc32",
        (F.col("rows_before") + F.col("rank") - 1).alias("at"),
        F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * F.col("all_bytes")))).cast("int").alias("shard"),
    )
    starts = sharded.groupBy("shard").agg(F.min("at").alias("first"))
    return sharded.join(F.broadcast(starts), "shard").select(  # n_shards rows at most
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
