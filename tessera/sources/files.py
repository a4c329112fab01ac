"""Readers and writers: text files through Hadoop's file systems, vector files, benchmark sets for retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import AlreadyExists, FailedPrecondition, NotFound


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> None:
    """A small text file. Without overwrite the file must be new: of two writers one fails, which makes it a lock."""
    from py4j.protocol import Py4JJavaError

    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, overwrite)
    except Py4JJavaError as e:
        raise AlreadyExists(path) from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise NotFound(path)
    f = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(f)).decode()
    finally:
        f.close()


def read_vectors_text(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """Lines `id;v v v`: key (text), vector (floats). Lines that aren't of this form are left out."""
    line = F.split("value", separator, 2)
    numbers = F.transform(F.filter(F.split(F.trim(F.get(line, 1)), r"[\s,]+"), lambda x: x != ""), lambda x: x.try_cast("float"))
    out = spark.read.text(path).select(F.trim(F.get(line, 0)).alias("key"), numbers.alias("vector"))
    return out.where("key <> '' and size(vector) > 0 and not exists(vector, x -> x is null)")


def write_vectors_text(df: DataFrame, path: str, key: str, vector: str, separator: str = ";") -> None:
    line = F.concat(F.col(key).cast("string"), F.lit(separator), F.array_join(F.col(vector).cast("array<string>"), " "))
    df.where(F.col(vector).isNotNull()).select(line.alias("value")).write.text(path)


def read_beir(spark: SparkSession, path: str, split: str = "test") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A retrieval benchmark: corpus (id, title, text), queries (id, text), judgements (query_id, corpus_id, score)."""
    corpus = spark.read.schema("_id string, title string, text string").json(f"{path}/corpus.jsonl").withColumnRenamed("_id", "id")
    queries = spark.read.schema("_id string, text string").json(f"{path}/queries.jsonl").withColumnRenamed("_id", "id")
    judged = spark.read.schema("query_id string, corpus_id string, score int").csv(f"{path}/qrels/{split}.tsv", sep="\t", header=True)
    return corpus, queries, judged


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A forward scan: only the named columns are read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns is not None else df


def write_table(df: DataFrame, path: str, max_records: int = 10_000_000, mode: str = "errorifexists") -> None:
    """Parquet in files of at most max_records rows."""
    df.write.mode(mode).option("maxRecordsPerFile", max_records).parquet(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files (or streams): one, or all in a folder, of one schema. The driver looks at the first one's schema; executors
    read a file each, a record batch at a time."""
    import pyarrow as pa
    import pyarrow.fs as pafs
    from pyspark.sql.pandas.types import from_arrow_schema

    fs, base = pafs.FileSystem.from_uri(path)
    found = fs.get_file_info(base)
    if found.type == pafs.FileType.NotFound:
        raise NotFound(path)
    names = [found.path] if found.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and f.size)
    if not names:
        raise NotFound(path)

    def batches_of(name: str):
        with fs.open_input_file(name) as f:
            head = f.read(6)
            f.seek(0)
            if head == b"ARROW1":
                reader = pa.ipc.open_file(f)
                yield reader.schema
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)
            else:
                reader = pa.ipc.open_stream(f)
                yield reader.schema
                yield from reader

    schema = from_arrow_schema(next(batches_of(names[0])))

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                yield from (x for x in batches_of(name) if isinstance(x, pa.RecordBatch))

    paths = spark.createDataFrame([(n,) for n in names], "path string").repartition(len(names))
    return paths.mapInArrow(run, schema)


def write_arrow(df: DataFrame, folder: str) -> None:
    """Arrow IPC files in a new folder, one a partition, written by the executors a batch at a time. Files of attempts that failed are
    removed at the end."""
    import uuid

    import pyarrow as pa
    import pyarrow.fs as pafs
    from pyspark.sql.pandas.types import to_arrow_schema

    fs, base = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(base).type != pafs.FileType.NotFound:
        raise AlreadyExists(folder)
    fs.create_dir(base, recursive=True)
    schema = to_arrow_schema(df.schema)

    def run(batches):
        name = f"part-{uuid.uuid4().hex}.arrow"
        with fs.open_output_stream(f"{base}/{name}") as f, pa.ipc.new_file(f, schema) as out:
            for batch in batches:
                out.write_batch(batch.cast(schema))
        yield pa.RecordBatch.from_pydict({"name": [name]})

    kept = {r.name for r in df.mapInArrow(run, "name string").collect()}  # a name for each partition
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.base_name not in kept:
            fs.delete_file(f.path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name on shared storage: under spark.checkpoint.dir, or, on one machine that names none, a temporary folder."""
    import tempfile
    import uuid

    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise FailedPrecondition("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
