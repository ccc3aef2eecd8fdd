"""Interfaces of outside services, with local stand-ins, and how plans call them."""

from __future__ import annotations

import hashlib
import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class ContentBlocked(Exception):
    """A service refused a text for its content."""


class Embedder(Protocol):
    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]: ...


class Chunker(Protocol):
    def chunk(self, text: str) -> list[str]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: Sequence[str]) -> list[dict]: ...


class HashEmbedder:
    """A deterministic stand-in: signed counts of hashed words, of unit length."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dims)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % self.dims] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v + self.dims**-0.5).tolist())
        return out


class OverlapReranker:
    """A deterministic stand-in: the share of the query's words in a text."""

    def rerank(self, query: str, texts: Sequence[str]) -> list[dict]:
        q = set(query.lower().split())
        return [{"index": i, "relevance_score": len(q & set(t.lower().split())) / max(1, len(q))} for i, t in enumerate(texts)]


#: What the body of a refusal says where a service blocks a text for its content; another refusal is an error.
BLOCK_SIGNS = ("content blocked", "guardrail_name")


class ServiceError(Exception):
    """A service answered with an error."""


def http_post(url: str, key: str, timeout: float = 60) -> Callable[[dict], tuple[int, str]]:
    """Posts JSON to an address: the status and the body of the answer."""

    def post(body: dict) -> tuple[int, str]:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                return answer.status, answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")

    return post


def answered(status: int, body: str) -> dict:
    """The answer as data. A refusal for content is ``ContentBlocked``, any other error ``ServiceError``."""
    if status == 403 and any(sign in body[:2000].lower() for sign in BLOCK_SIGNS):
        raise ContentBlocked(body[:500])
    if not 200 <= status < 300:
        raise ServiceError(f"{status}: {body[:500]}")
    return json.loads(body)


class ServiceEmbedder:
    """Vectors from a service that may answer in any order: the answers' indexes say which text is which."""

    def __init__(self, post: Callable[[dict], tuple[int, str]], model: str):
        self.post, self.model = post, model

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        if not texts:
            return []
        rows = answered(*self.post({"model": self.model, "input": list(texts)}))["data"]
        by = {r["index"]: r["embedding"] for r in rows}
        if sorted(by) != list(range(len(texts))):
            raise ServiceError(f"{len(texts)} texts, but vectors of {sorted(by)}")
        return [by[i] for i in range(len(texts))]


class ServiceReranker:
    """Scores from a service that wraps its results as ``data`` or ``results``."""

    def __init__(self, post: Callable[[dict], tuple[int, str]], model: str):
        self.post, self.model = post, model

    def rerank(self, query: str, texts: Sequence[str], top_n: int | None = None) -> list[dict]:
        if not texts:
            return []
        said = answered(*self.post({"model": self.model, "query": query, "documents": list(texts), "top_n": len(texts) if top_n is None else top_n}))
        return said["data"] if "data" in said else said.get("results", [])


def embed_partial(embedder: Embedder, texts: Sequence[str]) -> list[list[float] | None]:
    """Vectors in order; where the service blocks a batch each text is sent alone, and a blocked one has none. Other errors are raised."""
    try:
        return list(embedder.embed_batch(texts))
    except ContentBlocked:
        out: list[list[float] | None] = []
        for t in texts:
            try:
                out.append(embedder.embed_batch([t])[0])
            except ContentBlocked:
                out.append(None)
        return out


class TokenBucket:
    """A thread-safe rate limit that starts empty and can be sent to tasks."""

    def __init__(self, per_minute: float, capacity: float | None = None, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.capacity = per_minute / 60, capacity or max(1.0, per_minute / 60)
        self.clock, self.sleep = clock, sleep
        self.tokens, self.at, self.lock = 0.0, clock(), threading.Lock()

    def acquire(self, tokens: float = 1) -> None:
        if tokens > self.capacity:
            raise ValueError("more than the bucket holds")
        while True:
            with self.lock:
                now = self.clock()
                self.tokens, self.at = min(self.capacity, self.tokens + (now - self.at) * self.rate), now
                if self.tokens >= tokens:
                    self.tokens -= tokens
                    return
                wait = (tokens - self.tokens) / self.rate
            self.sleep(wait)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "lock"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"lock": threading.Lock(), "at": state["clock"]()}


def embed(df: DataFrame, key: str, text: str, make: Callable[[], Embedder], *, batch: int = 32, per_minute: float | None = None) -> DataFrame:
    """``key, vector`` of every text, null for blocked ones. A rate is shared evenly by the partitions."""
    share = per_minute / max(1, df.rdd.getNumPartitions()) if per_minute else None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service, limit = make(), TokenBucket(share) if share else None
        for frame in frames:
            vectors: list = []
            for i in range(0, len(frame), batch):
                if limit:
                    limit.acquire()
                vectors += embed_partial(service, frame.iloc[i : i + batch, 1].tolist())
            yield pd.DataFrame({key: frame.iloc[:, 0], "vector": vectors})

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).where(f"{text} is not null").mapInPandas(run, f"{key} {kind}, vector array<float>")


def ordered_scores(results: Sequence[dict], n: int) -> list[tuple[int, float]]:
    """``index, score`` of a reranker's results, best first; results without a score or of no candidate are left out."""
    out = []
    for r in results:
        score = r.get("relevance_score", r.get("score"))
        if score is not None and 0 <= r.get("index", -1) < n:
            out.append((r["index"], float(score)))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def rerank_groups(candidates: DataFrame, make: Callable[[], Reranker]) -> DataFrame:
    """``query_id, id, score`` of candidates ``query_id, query, id, text``, each query's few candidates sent together."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id").reset_index(drop=True)
        got = ordered_scores(make().rerank(frame["query"][0], frame["text"].tolist()), len(frame))
        return pd.DataFrame({"query_id": [frame["query_id"][0]] * len(got), "id": [frame["id"][i] for i, _ in got], "score": [s for _, s in got]})

    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    return candidates.groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, id {kinds['id']}, score double")


def chunks(df: DataFrame, key: str, text: str, make: Callable[[], Chunker]) -> DataFrame:
    """``key, chunk_no, chunk``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = make()
        for frame in frames:
            rows = [(k, i, c) for k, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for i, c in enumerate(cutter.chunk(t) if t else [])]
            yield pd.DataFrame(rows, columns=[key, "chunk_no", "chunk"])

    return df.select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, chunk_no int, chunk string")
