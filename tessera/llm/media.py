"""Media columns: payloads in content-addressed tar shards, rows that point into them, metadata from range reads."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._shared import fresh_path, pieces, remove, stash, texts_of

#: Samples in a row of the stored image; a payload is a positive multiple of it.
WIDTH = 576
#: A shard is closed once it holds this many bytes or members, and read back then.
SHARD_BYTES, SHARD_MEMBERS = 64 << 20, 20_000
#: The signature of a PNG file; bytes from its start to the end of its first chunk.
SIGNATURE, HEADER = b"\x89PNG\r\n\x1a\n", 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes, level: int = 6) -> bytes:
    """A payload as a grey PNG image with 8-bit samples, WIDTH to a row."""
    rows = b"".join(b"\0" + payload[i : i + WIDTH] for i in range(0, len(payload), WIDTH))
    head = struct.pack(">IIBBBBB", WIDTH, len(payload) // WIDTH, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows, level)) + _chunk(b"IEND", b"")


def image_header(data: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits a sample, kind of colour, from the first HEADER bytes."""
    if data[:8] != SIGNATURE or data[12:16] != b"IHDR":
        raise ValueError("not a PNG image")
    return struct.unpack(">IIBB", data[16:26])


def from_image(data: bytes) -> bytes:
    """The samples of an image written by to_image."""
    width, _, depth, colour = image_header(data)
    if (depth, colour) != (8, 0):
        raise ValueError("not a grey image with 8-bit samples")
    at, packed = 8, []
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IDAT":
            packed.append(data[at + 8 : at + 8 + n])
        at += n + 12
    raw, step = zlib.decompress(b"".join(packed)), width + 1
    if any(raw[i] for i in range(0, len(raw), step)):
        raise ValueError("filtered rows")
    return b"".join(raw[i + 1 : i + step] for i in range(0, len(raw), step))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of a text, filled up with bytes 255 (which UTF-8 never has) to a positive multiple of WIDTH; bytes before filling."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b"\xff" * (-len(data) % WIDTH if data else WIDTH), len(data)


def tar_header(name: str, size: int) -> bytes:
    """Header of a file in a ustar archive."""
    h = bytearray(512)
    for at, value in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"%011o\0" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        h[at : at + len(value)] = value
    h[148:156] = b"%06o\0 " % sum(h)
    return bytes(h)


class Shard:
    """A tar file being written: each content once, named by its digest."""

    def __init__(self, folder: str) -> None:
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"shard-{uuid.uuid4().hex}.tar"  # of this attempt only: rows of a lost attempt never point here
        self.path = f"{base}/{self.name}"
        self.out = self.fs.open_output_stream(self.path)
        self.at = 0
        self.members: dict[str, tuple[int, int]] = {}

    def put(self, digest: str, data: bytes) -> None:
        if digest not in self.members:
            self.out.write(tar_header(f"{digest}.png", len(data)))
            self.out.write(data + b"\0" * (-len(data) % 512))
            self.members[digest] = (self.at + 512, len(data))
            self.at += 512 + len(data) + -len(data) % 512

    def close(self) -> None:
        self.out.write(b"\0" * 1024)
        self.out.close()


def _read_back(shard: Shard) -> dict[str, dict]:
    """Of each member: the header's values by a range read of the header alone, the rest from the whole member."""
    out = {}
    with shard.fs.open_input_file(shard.path) as f:
        for digest, (offset, length) in shard.members.items():
            width, height, depth, colour = image_header(f.read_at(HEADER, offset))
            data = f.read_at(length, offset)
            samples = from_image(data)
            out[digest] = {
                "shard": shard.name, "offset": offset, "media_bytes": length, "media_sha256": hashlib.sha256(data).hexdigest(),
                "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-32:]),
                "width": width, "height": height,
                "feature": f"png {width}x{height} depth {depth} colour {colour} sum {sum(samples)}",
            }
    return out


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, shard string, offset long, width int, height int"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


#: Contents with several places, of some 150 bytes each, that are broadcast once their number is known; more are joined.
BROADCAST_ROWS = 100_000


def store_texts(docs: DataFrame, folder: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Store each text as an image in tar shards under folder; one row a document with where and what is stored.

    Each task writes shards of its own and reads them back; a shard holds a content once, under its SHA-256. A content that
    several shards hold is then given one place, the first by shard and offset, in a join of digests and places alone, and
    shards that no row points to any more are deleted. So equal texts have equal values in every column but doc_id. What is
    returned is a written table: to evaluate it again stores nothing again.

    Null is an empty text; null and repeated ids are rows of their own; an empty table has an empty result; other columns are left
    behind. A text of any length is one payload in one task. Shards are named by attempt: a task that runs again writes new ones
    and its rows point there. Memory: one shard's list of members and one payload.
    """
    schema = _arrow(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, waiting = None, []

        def finish() -> pa.RecordBatch:
            shard.close()
            found = _read_back(shard)
            rows = [{"doc_id": i, "n_bytes": n} | found[d] for i, n, d in waiting]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in pieces(batches):
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                shard = shard or Shard(folder)
                payload, n = payload_of(text)
                data = to_image(payload)
                digest = hashlib.sha256(data).hexdigest()
                shard.put(digest, data)
                waiting.append((i, n, digest))
                if shard.at >= SHARD_BYTES or len(waiting) >= SHARD_MEMBERS:
                    yield finish()
                    shard, waiting = None, []
        if shard:
            yield finish()

    met = stash(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA), "media-met")
    first = stash(first_places(met), "media-places")
    digest = F.unhex("media_sha256")
    if first.count() <= broadcast_rows:
        place = F.broadcast(first.select(F.col("digest").alias("__digest"), F.col("place").alias("__place")))
        out = met.join(place, digest == F.col("__digest"), "left")
    else:
        # joined by content and shard: a content of a third of all rows is dealt by the shards that hold it
        held = met.select(digest.alias("digest"), "shard").distinct().join(first.hint("merge"), "digest")
        place = held.select(F.col("digest").alias("__digest"), F.col("shard").alias("__held"), F.col("place").alias("__place")).hint("merge")
        out = met.join(place, (digest == F.col("__digest")) & (F.col("shard") == F.col("__held")), "left")
    moved = {"shard": F.coalesce("__place.shard", "shard"), "offset": F.coalesce("__place.offset", "offset")}
    out = out.withColumns(moved).select(*met.columns)
    for row in met.select("shard").distinct().join(out.select("shard").distinct(), "shard", "left_anti").toLocalIterator():
        remove(docs.sparkSession, f"{folder}/{row.shard}")
    return out


def first_places(stored: DataFrame) -> DataFrame:
    """digest, place (shard, offset): the first place of each content that several shards hold."""
    places = stored.groupBy(F.unhex("media_sha256").alias("digest")).agg(F.min(F.struct("shard", "offset")).alias("place"), F.max("shard").alias("last"))
    return places.where(F.col("place.shard") < F.col("last")).select("digest", "place")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), fresh_path(spark, "media"))
