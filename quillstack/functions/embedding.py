"""Text to vectors, behind an interface: a factory that makes an encoder once in each task."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

Encoder = Callable[[list[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed word hashes, unit norm. It knows no meaning."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for k, text in enumerate(texts):
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                out[k, h % dim] += 1 if h & 0x10000 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return encode


def embed(text: Column, factory: Callable[[], Encoder] = hashing_encoder) -> Column:
    """Vectors of a text column; null texts count as empty (the null vector)."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = factory()
        for batch in batches:
            yield pd.Series(list(encode(batch.fillna("").tolist())))

    return run(text)
