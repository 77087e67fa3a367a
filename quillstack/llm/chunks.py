"""Documents in chunks, and what chunks ask of the whole corpus.

A chunk is a set of documents by hashed id, some megabytes of text. What a
chunk has to tell about its words goes out in packed arrays, one row for each
bucket of hashes; whoever gets a bucket answers each chunk that wrote to it. A
key is told once by a chunk however often it stands there, so that a key in a
third of all rows weighs no more in its bucket than one row for each chunk.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text in a chunk, about; and the fewest chunks.
CHUNK, LEAST = 8 << 20, 128


class Chunks:
    """`rows` has chunk, id, text (binary) and the carried columns under their position's name (c0, c1, ...)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK, least: int = LEAST):
        total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.count = max(least, -(-total // chunk_bytes))
        # a bucket gets some megabytes: about a word for every 6 bytes, 4 to 8 bytes each
        self.bits = max(8, (-(-total // (4 << 20))).bit_length())
        self.carry = carry
        self.rows = docs.select(
            F.pmod(F.xxhash64(id_col, F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(self.count)).cast("int").alias("chunk"),  # null ids by their texts
            F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"),
            *(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
        )

    def tell(self, f: Callable[[pa.Table], dict], schema: str, answers: DataFrame | None = None) -> DataFrame:
        """f(rows of a chunk[, answers to it]) for each chunk."""
        arrow = arrow_schema(self.rows, schema)
        if answers is None:
            return self.rows.groupBy("chunk").applyInArrow(lambda rows: pa.table(f(rows), schema=arrow), schema)
        return self.rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(lambda rows, got: pa.table(f(rows, got), schema=arrow), schema)


def answer(told: DataFrame, f: Callable[[pa.Table], dict], schema: str) -> DataFrame:
    """f(rows of a bucket) for each bucket."""
    arrow = arrow_schema(told, schema)
    return told.groupBy("bucket").applyInArrow(lambda rows: pa.table(f(rows), schema=arrow), schema)


def arrow_schema(df: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def ids_of(rows: pa.Table) -> np.ndarray:
    """Ids as integers; null ids come after all others."""
    return rows["id"].fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64)


@functools.cache
def _codec() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(values: np.ndarray, ascending: bool = False) -> bytes:
    """An array as compressed bytes, the first bytes of all values first; ascending ones as differences."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return _codec()[0].compress(planes.tobytes())


def stretch(data: bytes, dtype, ascending: bool = False) -> np.ndarray:
    """The array that was squeezed."""
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(_codec()[1].decompress(data), np.uint8).reshape(size, -1)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if ascending else values


def unpack(column: pa.ChunkedArray, dtype, read: Callable[[bytes, type], np.ndarray] = np.frombuffer) -> tuple[np.ndarray, np.ndarray]:
    """All rows' packed values one after another, and which row each is of."""
    parts = [read(x, dtype) for x in column.to_pylist()]
    if not parts:
        return np.zeros(0, dtype), np.zeros(0, np.int64)
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def slices(buckets: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each bucket in an ascending array of buckets (n + 1 of them)."""
    return np.searchsorted(buckets, np.arange(n + 1))
