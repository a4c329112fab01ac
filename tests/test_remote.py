import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tessera.errors import FailedPrecondition, InvalidArgument
from tessera.operators.remote import HttpEmbedding, HttpRerankModel
from tessera.operators.rerank import ModelReranker, embed_column


class Server(BaseHTTPRequestHandler):
    failures = 0
    seen: list = []

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        Server.seen.append((self.path, self.headers.get("Authorization"), body))
        if Server.failures or body["model"] == "broken":
            Server.failures = max(0, Server.failures - 1)
            self.send_response(503 if body["model"] != "broken" else 400)
            self.end_headers()
            return
        if self.path.endswith("embeddings"):
            data = [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in enumerate(body["input"])][::-1]
            out = {"data": data[1:] if body["model"] == "short" else data}
        else:
            out = {"results": [{"index": i, "relevance_score": float(body["query"] in t)} for i, t in enumerate(body["documents"])]}
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps(out).encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def url():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_embeddings(spark, url, monkeypatch):
    m = HttpEmbedding(url, "m", batch=2)
    assert m.embed_all(["a", "bbb", "cc"]) == [[1.0, 1.0], [3.0, 1.0], [2.0, 1.0]] and m.dimension == 2 and m.embed("xx") == [2.0, 1.0]
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r.embedding for r in embed_column(df, "t", m).collect()] == [[3.0, 1.0], None]
    monkeypatch.setenv("SOME_KEY", "k1")
    HttpEmbedding(url, "m", key_variable="SOME_KEY").embed("x")
    assert Server.seen[-1][1] == "Bearer k1" and "k2" not in repr(HttpEmbedding(url, "m", key="k2"))
    for bad in ("", "  ", None, 3):
        with pytest.raises(InvalidArgument):
            m.embed(bad)


def test_failures(url):
    Server.failures = 2
    assert HttpEmbedding(url, "m").embed("x") == [1.0, 1.0]
    for model in (HttpEmbedding(url, "broken"), HttpEmbedding(url, "short"), HttpEmbedding(url, "m", dimension=3), HttpEmbedding("http://127.0.0.1:9", "m", tries=1, timeout=1)):
        with pytest.raises(FailedPrecondition):
            model.embed("x")


def test_rerank(spark, url):
    model = HttpRerankModel(url, "r", batch=2)
    assert model([("q", "a q"), ("q", "b"), ("z", "z"), ("q", "q")]) == [1.0, 0.0, 1.0, 1.0]
    docs = spark.createDataFrame([("1", "has q"), ("2", "none"), ("3", " ")], "pk string, text string")
    got = ModelReranker("q", model, "text", 2).rerank({"text": docs}).collect()
    assert [(r.pk, r.score) for r in got] == [("1", 1.0), ("2", 0.0)]
