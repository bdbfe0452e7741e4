"""Embedders: anything that turns texts to vectors; a service over HTTP, and a deterministic one for offline use."""

from __future__ import annotations

import hashlib
import http.client
import itertools
import json
import random
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..errors import DimensionError, EmbeddingError

Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 32
TIMEOUT_S = 120
#: Requests of one task that are under way at a time; a job has as many times its running tasks.
IN_FLIGHT = 4
RETRIES = 5
#: The wait before the first retry; it doubles with each, up to LONGEST_WAIT_S.
WAIT_S = 0.5
LONGEST_WAIT_S = 60.0
#: The name under which HashEmbedder's vectors are kept.
HASH_MODEL = "word-hash"
# Answers of a service that may be different later.
PASSING = [429, 500, 502, 503, 504]


class HashEmbedder:
    """Signed hashes of words, at unit length: equal texts get equal vectors, similar texts similar ones."""

    def __init__(self, dims: int) -> None:
        self.dims = dims

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dims))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
                out[k, h % self.dims] += 1 if h >> 63 else -1
            norm = np.linalg.norm(out[k])
            out[k] = out[k] / norm if norm else 1 / np.sqrt(self.dims)
        return out.astype(np.float32).tolist()


class HttpEmbedder:
    """POSTs {model, input} to <gateway>/embeddings; vectors come in the order of the texts.

    An answer of PASSING, or none, is asked for again up to `retries` times, after a wait that doubles or that the service
    names (Retry-After, in seconds); any other error is final. in_flight requests of a task are under way at a time.
    """

    def __init__(self, gateway: str, model: str, timeout: float = TIMEOUT_S, in_flight: int = IN_FLIGHT, retries: int = RETRIES, wait: float = WAIT_S) -> None:
        self.url, self.model, self.timeout = f"{gateway.rstrip('/')}/embeddings", model, timeout
        self.in_flight, self.retries, self.wait = in_flight, retries, wait

    def pause(self, attempt: int, named: str | None) -> float:
        """Seconds before the next attempt; up to half of its length is added by chance, so that tasks don't ask in step."""
        try:
            least = float(named or 0)
        except ValueError:
            least = 0.0  # a date
        return min(max(self.wait * 2**attempt, least), LONGEST_WAIT_S) * random.uniform(1, 1.5)

    def answer(self, body: bytes) -> dict:
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        for attempt in itertools.count():
            named = None
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                error, named = f"{e.code}: {e.read().decode(errors='replace')}", e.headers.get("Retry-After")
                if e.code not in PASSING or attempt == self.retries:
                    raise EmbeddingError(error) from e
            except ValueError as e:
                raise EmbeddingError(str(e)) from e
            except (OSError, http.client.HTTPException) as e:
                if attempt == self.retries:
                    raise EmbeddingError(str(e)) from e
            time.sleep(self.pause(attempt, named))
        raise AssertionError

    def __call__(self, texts: list[str]) -> list[list[float]]:
        try:
            data = self.answer(json.dumps({"model": self.model, "input": texts}).encode())["data"]
            if all("index" in x for x in data):
                data = sorted(data, key=lambda x: x["index"])
            return [x["embedding"] for x in data]
        except (KeyError, TypeError) as e:
            raise EmbeddingError(f"not an answer with vectors: {e!r}") from e


def checked(embedder: Embedder, texts: list[str], dims: int) -> list[list[float]]:
    vectors = embedder(texts)
    if len(vectors) != len(texts):
        raise EmbeddingError(f"{len(vectors)} vectors for {len(texts)} texts")
    for v in vectors:
        if len(v) != dims:
            raise DimensionError(f"expected {dims}, got {len(v)}")
    return vectors


def in_order(requests: Iterable[list[str]], ask: Callable, limit: int) -> Iterator:
    """ask of each request, in their order, with at most `limit` of them begun and not yet passed on.

    The first error ends it: what hasn't begun is dropped.
    """
    with ThreadPoolExecutor(limit) as pool:
        waiting: deque[Future] = deque()
        try:
            for request in requests:
                if len(waiting) == limit:
                    yield waiting.popleft().result()
                waiting.append(pool.submit(ask, request))
            while waiting:
                yield waiting.popleft().result()
        finally:
            for left in waiting:
                left.cancel()


def embedded(chunks: DataFrame, embedder: Embedder, dims: int, batch: int = BATCH, text_col: str = "text") -> DataFrame:
    """chunks with an embedding each, whose length is checked.

    Texts go to the embedder `batch` at a time, each distinct text of an Arrow batch once; an embedder with a number
    in_flight is asked so many times at once by each task, any other one after the other.
    """
    schema = T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType(), False))])
    kind = pa.list_(pa.field("element", pa.float32(), False))

    def ask(texts: list[str]) -> pa.Array:
        return pa.array(checked(embedder, texts, dims), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = b.column(text_col).dictionary_encode(null_encoding="encode")
            requests = (coded.dictionary.slice(at, batch).to_pylist() for at in range(0, len(coded.dictionary), batch))
            made = [pa.array([], kind), *in_order(requests, ask, getattr(embedder, "in_flight", 1))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(made).take(coded.indices)], schema.names)

    return chunks.mapInArrow(run, schema)
