"""Optional HTTP adapters for embedding and reranking services."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from folioscope.functions.ids import EmbeddingProfile

TIMEOUT_S = 60


def post_json(url: str, body: dict, api_key: str = "", timeout: float = TIMEOUT_S) -> dict:
    headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {api_key}"} if api_key else {})
    request = urllib.request.Request(url, json.dumps(body).encode(), headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as got:
        return json.load(got)


def ordered_vectors(data: list[dict], n: int) -> list[list[float]]:
    """Embeddings by index, which must be exactly 0..n-1; all of one dimension above 0."""
    rows = sorted(data, key=lambda d: d["index"])
    if [d["index"] for d in rows] != list(range(n)):
        raise ValueError("embedding response has missing, repeated or surplus indices")
    vectors = [d["embedding"] for d in rows]
    if n and (not vectors[0] or any(len(v) != len(vectors[0]) for v in vectors)):
        raise ValueError("embedding response has empty vectors or vectors of different dimensions")
    return vectors


def ordered_ranks(results: list[dict], n: int) -> list[tuple[int, float]]:
    """(index, score), best first, ties to the lower index. Fewer than n are legal; repeated or foreign indices are not."""
    indices = [r["index"] for r in results]
    if len(set(indices)) != len(indices) or any(not 0 <= i < n for i in indices):
        raise ValueError("rerank response has repeated or foreign indices")
    return sorted(((r["index"], float(r["relevance_score"])) for r in results), key=lambda r: (-r[1], r[0]))


@dataclass(frozen=True)
class HttpEmbedder:
    """``style``: openai (encoding_format) or voyage (input_type)."""

    endpoint: str
    model: str
    api_key: str = ""
    style: str = "openai"
    input_type: str = "document"

    @property
    def profile(self) -> EmbeddingProfile:
        return EmbeddingProfile(self.style, self.endpoint, self.model, self.input_type)

    def __call__(self, texts: list[str]) -> list[list[float]]:
        extra = {"encoding_format": "float"} if self.style == "openai" else {"input_type": self.input_type}
        got = post_json(f"{self.endpoint.rstrip('/')}/v1/embeddings", {"model": self.model, "input": texts} | extra, self.api_key)
        return ordered_vectors(got["data"], len(texts))


@dataclass(frozen=True)
class HttpReranker:
    """``style``: cohere (top_n, results) or voyage (top_k, data)."""

    endpoint: str
    model: str
    api_key: str = ""
    style: str = "cohere"

    def __call__(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        limit = "top_n" if self.style == "cohere" else "top_k"
        got = post_json(f"{self.endpoint.rstrip('/')}/v1/rerank", {"model": self.model, "query": query, "documents": texts, limit: len(texts)}, self.api_key)
        return ordered_ranks(got["results" if self.style == "cohere" else "data"], len(texts))


@dataclass(frozen=True)
class HashingEmbedder:
    """A local, deterministic embedder: words hashed into a fixed number of dimensions."""

    dimensions: int = 64

    @property
    def profile(self) -> EmbeddingProfile:
        return EmbeddingProfile("hashing", "", str(self.dimensions))

    def __call__(self, texts: list[str]) -> list[list[float]]:
        import zlib

        vectors = []
        for text in texts:
            vector = [0.0] * self.dimensions
            for word in text.lower().split():
                code = zlib.crc32(word.encode())
                vector[code % self.dimensions] += 1.0 if code & 0x10000 else -1.0
            vectors.append(vector)
        return vectors
