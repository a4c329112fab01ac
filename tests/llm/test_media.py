import hashlib
import tarfile
import zlib

import pytest

from tessera.llm import media as M


def test_images_hold_payloads():
    for text in (None, "", "a", "é" * 287, "x" * 576, "y" * 577):
        payload, n = M.payload_of(text)
        assert len(payload) % 576 == 0 and len(payload) > 0 and payload[:n] == (text or "").encode() and set(payload[n:]) <= {255}
        data = M.to_image(payload)
        assert M.from_image(data) == payload and M.image_header(data[: M.HEADER]) == (576, len(payload) // 576, 8, 0)
    with pytest.raises(ValueError):
        M.image_header(b"x" * 40)


def test_rows_point_into_shards(odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 3000)
    rows = M.store_texts(odd, f"file://{tmp_path}").collect()
    docs = odd.collect()
    assert len(rows) == len(docs)
    want = set()
    for d in docs:
        p, n = M.payload_of(d.text)
        want.add((d.doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    for r in rows:
        raw = (tmp_path / r.shard).read_bytes()[r.offset : r.offset + r.media_bytes]
        assert hashlib.sha256(raw).hexdigest() == r.media_sha256
        with tarfile.open(tmp_path / r.shard) as t:
            names = t.getnames()
            assert len(set(names)) == len(names) and t.extractfile(f"{r.media_sha256}.png").read() == raw
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    assert M.store_texts(none, f"file://{tmp_path}").count() == 0


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_equal_texts_have_equal_values_on_several_partitions(spark, tmp_path, broadcast_rows):
    rows = [(k, ("common text " * 50, "another", None, f"own {k}")[k % 4]) for k in range(400)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, offset int").repartition(7)
    out = M.store_texts(docs, f"file://{tmp_path}", broadcast_rows)
    by = {}
    for r in out.collect():
        text = dict(rows)[r.doc_id] or ""
        assert by.setdefault(text, tuple(r)[1:]) == tuple(r)[1:]
        assert M.from_image((tmp_path / r.shard).read_bytes()[r.offset : r.offset + r.media_bytes]) == M.payload_of(text)[0]
    files = sorted(p.name for p in tmp_path.glob("shard-*.tar"))
    assert files == sorted({r.shard for r in out.collect()}) and len(by) == 103
    out.collect()  # stores nothing again
    assert files == sorted(p.name for p in tmp_path.glob("shard-*.tar"))


def test_shards_without_rows_go(spark, tmp_path):
    docs = spark.createDataFrame([(k, "the same") for k in range(40)], "doc_id long, text string").repartition(5)
    assert M.store_texts(docs, f"file://{tmp_path}").select("shard", "offset").distinct().count() == 1
    assert len(list(tmp_path.glob("*.tar"))) == 1
