"""What the operators of this package share: the cluster's shared folder, written intermediate tables, word splitting and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that belong to words once A-Z are lower-cased: digits, a-z and everything beyond ASCII. The rest become spaces.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: A-Z to a-z, all other bytes as they are.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A session on one machine that names none gets one of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def free_name(df: DataFrame, base: str) -> str:
    """base, or a longer name if df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while base in taken:
        base = "_" + base
    return base


#: What stash() has written inside the settled() calls that are under way.
_made: list[list[DataFrame]] = []


def _noted(df: DataFrame) -> DataFrame:
    for made in _made[-1:]:
        made.append(df)
    return df


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later steps don't depend on executors that are lost meanwhile."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return _noted(out)


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() returns, written. Tables that make() wrote on the way are removed, also if it fails."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        df = make()
        path = fresh_path(df.sparkSession, name)
        df.write.parquet(path)
    finally:
        _made.remove(made)
        for x in made:
            discard(x)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stashed_at = path
    return _noted(out)


#: Lets a scan of a table whose buckets are one sorted file each say that its rows are sorted.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def stash_sorted(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """Like stash(), as a table of n buckets by key, each one file sorted by key. A join on the key needs neither exchange nor sort of
    it, while n is the number of shuffle partitions and IN_ORDER is set."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    table = f"tessera_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).format("parquet").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out._stashed_at, out._table = path, table
    return _noted(out)


def unsorted(df: DataFrame) -> DataFrame:
    """What stash_sorted() wrote, as a plain table: adaptive execution may deal its rows anew."""
    return df.sparkSession.read.schema(df.schema).parquet(df._stashed_at)


def discard(df: DataFrame | None) -> None:
    """Remove a stashed table that nothing reads any more."""
    path = getattr(df, "_stashed_at", None)
    if getattr(df, "_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def words(text: str | None) -> list[bytes]:
    """The lower-cased words of a text, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what Python holds at a time stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
