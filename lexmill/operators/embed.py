"""Pluggable embedders and language models, run in Arrow batches inside the executors.

No model ships with the package. ``HashingEmbedder`` is a deterministic stand-in (signed feature hashing of character
runs); any callable ``list[str] -> array`` takes its place. The same embedder serves corpus and queries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class HashingEmbedder:
    """Unit vectors from the runs of one to three characters of a text, by array operations over all texts of a batch."""

    def __init__(self, size: int = 64):
        self.size = size

    def __call__(self, texts: list[str]) -> np.ndarray:
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(texts)), lens)
        out = np.zeros(len(texts) * self.size)
        h = np.zeros(len(cp), np.uint64)
        for n in (1, 2, 3):
            h = (h[: len(cp) - n + 1] ^ cp[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            whole = owner[n - 1 :] == owner[: len(cp) - n + 1]
            v = (h[whole] + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
            v ^= v >> np.uint64(32)
            at = owner[: len(cp) - n + 1][whole] * self.size + (v % np.uint64(self.size)).astype(np.int64)
            out += np.bincount(at, np.where(v >> np.uint64(63) == 1, 1.0, -1.0), len(out))
        return normalize(out.reshape(len(texts), self.size))


class PooledEmbedder:
    """Any token model as an embedder: tokenise, cut at ``most`` tokens, run the model, masked mean, length one.

    ``tokenize`` gives the ids of a text; ``model`` takes ids and mask (texts x tokens) and gives token vectors.
    """

    def __init__(self, tokenize: Callable[[str], list[int]], model: Callable[[np.ndarray, np.ndarray], np.ndarray], most: int = 512, pad: int = 0):
        self.tokenize, self.model, self.most, self.pad = tokenize, model, most, pad

    def __call__(self, texts: list[str]) -> np.ndarray:
        ids = [self.tokenize(t)[: self.most] for t in texts]
        width = max(map(len, ids), default=0) or 1
        padded, mask = np.full((len(ids), width), self.pad, np.int64), np.zeros((len(ids), width), np.int64)
        for k, row in enumerate(ids):
            padded[k, : len(row)], mask[k, : len(row)] = row, 1
        return mean_pool(self.model(padded, mask), mask)


def normalize(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean over the tokens of each text, normalised; a text without tokens gives zeros."""
    weights = mask[..., None].astype(np.float64)
    return normalize((tokens * weights).sum(1) / np.maximum(weights.sum(1), 1e-9))


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The same pooling on columns: ``array<array<double>>`` of token vectors and ``array<int>``."""
    kept = F.zip_with(vectors, mask, lambda v, m: F.transform(v, lambda x: x * m))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept), F.lit(1))), F.get(kept, F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    count = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m), F.lit(1e-9))
    mean = F.transform(total, lambda x: x / count)
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(mean, lambda x: x / norm))


def pooled_by_key(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Unit mean vector of each group as ``keys, k, x``: an average a dimension with partial sums, so no group is held."""
    parts = rows.select(*keys, F.posexplode(F.col(vector).cast("array<double>")).alias("k", "x"))
    means = parts.groupBy(*keys, "k").agg(F.avg("x").alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(*keys)))
    return means.withColumn("x", F.when(norm > 0, F.col("x") / norm))


def embed(rows: DataFrame, text: str, output: str, make: Callable[[], Callable[[list[str]], np.ndarray]] = HashingEmbedder, batch: int = 32) -> DataFrame:
    """Adds the embedding of a text column. The model is made once a worker; empty and null texts have null."""

    @F.pandas_udf("array<float>")
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            texts = part.fillna("").tolist()
            found: list = [None] * len(texts)
            full = [k for k, t in enumerate(texts) if t]
            for at in range(0, len(full), batch):
                some = full[at : at + batch]
                for k, v in zip(some, model([texts[k] for k in some])):
                    found[k] = v.astype(np.float32) if np.any(v) else None
            yield pd.Series(found)

    return rows.withColumn(output, encode(F.col(text)))


def ask(prompts: DataFrame, prompt: str, output: str, make: Callable[[], Callable[[str], str | None]]) -> DataFrame:
    """Adds a language model's answer and the seconds it took. ``make`` gives the client, once a worker; errors are null."""

    @F.pandas_udf(f"{output} string, time_seconds double")
    def call(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import time

        client = make()
        for part in parts:
            rows = []
            for text in part:
                began = time.monotonic()
                try:
                    answer = client(text)
                except Exception:  # noqa: BLE001
                    answer = None
                rows.append((answer, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=[output, "time_seconds"])

    return prompts.withColumn("__answer", call(F.col(prompt))).select("*", f"__answer.{output}", "__answer.time_seconds").drop("__answer")


class HttpClient:
    """A model behind HTTP: ``POST {prompt, temperature}``, answer in ``response``; the read timeout follows the prompt."""

    def __init__(self, url: str, temperature: float = 0.1):
        self.url, self.temperature = url, temperature

    def __call__(self, prompt: str) -> str | None:
        import json
        import socket
        import urllib.request
        from urllib.parse import urlsplit

        size = len(prompt)
        wait = 30 if size < 100 else 60 if size < 300 else 120 if size < 500 else 180
        body = json.dumps({"prompt": prompt, "temperature": self.temperature}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json"})
        try:  # reachable at all within the connect time
            at = urlsplit(self.url)
            socket.create_connection((at.hostname, at.port or (443 if at.scheme == "https" else 80)), timeout=10).close()
        except OSError:
            return None
        with urllib.request.urlopen(request, timeout=wait) as answer:  # noqa: S310
            return json.load(answer).get("response") if answer.status == 200 else None
