"""Models behind HTTP: embeddings and rerank scores from any server that speaks the common JSON protocols.

Objects are small and picklable: they travel to the executors with the UDF that uses them, and each task sends its own batches.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Any

from tessera.errors import FailedPrecondition, InvalidArgument


@dataclass
class _Service:
    """Where a model is served. key_variable names the environment variable that holds the key, if none is given."""

    url: str
    model: str
    key: str = field(default="", repr=False)
    key_variable: str = ""
    timeout: float = 30.0
    tries: int = 3
    batch: int = 64

    def _post(self, path: str, body: dict) -> dict:
        """The server's answer; overload and lost connections are tried again with growing pauses."""
        headers = {"Content-Type": "application/json"}
        if key := self.key or os.environ.get(self.key_variable or " ", ""):
            headers["Authorization"] = f"Bearer {key}"
        request = urllib.request.Request(self.url.rstrip("/") + path, json.dumps(body).encode(), headers)  # noqa: S310
        for attempt in range(self.tries):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if e.code not in (429, 500, 502, 503, 504) or attempt == self.tries - 1:
                    raise FailedPrecondition(f"{self.url}: HTTP {e.code}") from e
            except (urllib.error.URLError, TimeoutError) as e:
                if attempt == self.tries - 1:
                    raise FailedPrecondition(f"{self.url}: {e}") from e
            time.sleep(0.2 * 2**attempt)
        raise FailedPrecondition(self.url)


def _texts(values: list[Any]) -> list[str]:
    for v in values:
        if type(v) is not str or not v.strip():
            raise InvalidArgument(f"no text to send: {v!r}")
    return values


@dataclass
class HttpEmbedding(_Service):
    """Dense vectors from <url>/v1/embeddings: {model, input} to {data: [{index, embedding}]}. dimension 0: whatever the first
    answer has; else it is asked for and checked. For embed_column()."""

    dimension: int = 0
    path: str = "/v1/embeddings"

    def embed_all(self, values: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for at in range(0, len(values), self.batch):
            some = _texts(values[at : at + self.batch])
            body = {"model": self.model, "input": some} | ({"dimensions": self.dimension} if self.dimension else {})
            data = self._post(self.path, body).get("data")
            if not isinstance(data, list) or len(data) != len(some) or any("embedding" not in d for d in data):
                raise FailedPrecondition(f"{self.url}: not {len(some)} embeddings")
            vectors = [d["embedding"] for d in sorted(data, key=lambda d: d.get("index", 0))]
            self.dimension = self.dimension or len(vectors[0])
            if any(len(v) != self.dimension for v in vectors):
                raise FailedPrecondition(f"{self.url}: vectors of another length than {self.dimension}")
            out += vectors
        return out

    def embed(self, value: str) -> list[float]:
        return self.embed_all([value])[0]


@dataclass
class HttpRerankModel(_Service):
    """Scores of (query, text) pairs from <url>/v1/rerank: {model, query, documents} to {results: [{index, relevance_score}]}. For
    ModelReranker(model=...)."""

    path: str = "/v1/rerank"

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = [0.0] * len(pairs)
        by_query: dict[str, list[int]] = {}
        for i, (query, _) in enumerate(pairs):
            by_query.setdefault(query, []).append(i)
        for query, places in by_query.items():
            for at in range(0, len(places), self.batch):
                some = places[at : at + self.batch]
                body = {"model": self.model, "query": query, "documents": [pairs[i][1] for i in some], "top_n": len(some)}
                results = self._post(self.path, body).get("results")
                if not isinstance(results, list) or {r.get("index") for r in results} != set(range(len(some))):
                    raise FailedPrecondition(f"{self.url}: not {len(some)} scores")
                for r in results:
                    out[some[r["index"]]] = float(r["relevance_score"])
        return out
