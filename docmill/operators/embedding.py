"""Embedding of chunks behind a small interface, with an encoder that needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from docmill.functions.text import col

#: Texts in a request, tries, first pause in seconds.
BATCH, TRIES, PAUSE = 8, 3, 0.5


#: What the hash of a trigram is made of: a factor for each sign, and a prime.
FACTORS, PRIME = (73856093, 19349663, 83492791), 2147483629


class HashingEncoder:
    """Character trigrams hashed to `dimension` signed places, unit length. Deterministic, so a rebuild gives equal vectors; all texts of a call at once."""

    provider, model = "local", "hashed-trigrams"

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        flat = [f" {' '.join(t.lower().split())} " for t in texts]
        codes = np.frombuffer("".join(flat).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(flat)), [len(t) for t in flat])
        if len(codes) < 3:
            return np.zeros((len(texts), self.dimension))
        whole = row[:-2] == row[2:]
        h = sum(c * f for c, f in zip((codes[:-2], codes[1:-1], codes[2:]), FACTORS))[whole] % PRIME
        sign = np.where(h // self.dimension % 2, 1.0, -1.0)
        out = np.bincount(row[:-2][whole] * self.dimension + h % self.dimension, sign, len(texts) * self.dimension).reshape(len(texts), self.dimension)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def signature(provider: str, model: str, dimension: int) -> str:
    """What must be equal for two vectors to be comparable."""
    return f"{provider}:{model}:{dimension}"


def with_retries(encode: Callable[[list[str]], np.ndarray], tries: int = TRIES, pause: float = PAUSE) -> Callable[[list[str]], np.ndarray]:
    """An encoder that is asked again after a growing pause; the last failure is raised."""

    def run(texts: list[str]) -> np.ndarray:
        for n in range(tries):
            try:
                return encode(texts)
            except Exception:
                if n + 1 == tries:
                    raise
                time.sleep(pause * 2**n)
        raise ValueError("tries must be positive")

    return run


def embed(chunks: DataFrame, text: str, factory: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = BATCH, out: str = "embedding") -> DataFrame:
    """chunks with the vector of a text column; null text gives null. The encoder is made once a task and asked for `batch` texts at a time."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = with_retries(factory())
        for part in parts:
            known = [t for t in part if t is not None]
            rows = iter([v for i in range(0, len(known), batch) for v in np.asarray(encode(known[i : i + batch]), np.float32)])
            yield pd.Series([None if t is None else next(rows) for t in part])

    return chunks.withColumn(out, run(F.col(text)))


def checked(vector: Column | str, dimension: int) -> Column:
    """The vector; a query fails where its length isn't the dimension. Null stays null."""
    v = col(vector)
    return F.when(v.isNull() | (F.size(v) == dimension), v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dimension} numbers, got "), F.size(v).cast("string"))).cast("array<float>"))
