"""Vectors as rows of numbers: which take part, and their packing into blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import arrow_schema


def finite(vector: str) -> Column:
    """Whether a vector is there and all its components are; never null. An empty vector is finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(~odd, F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int, dtype=np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype).reshape(len(column), dim)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles; raises if some component is too large for exact sums."""
    out = np.floor(x * scale)
    if out.size and np.abs(out).max() >= 1 << 27:
        raise OverflowError(f"components of {(1 << 27) / scale:g} and more have no exact products here")
    return out.astype(np.int64)


def pack(rows: DataFrame, blocks: int, f: Callable[[pa.Table, int], dict], schema: str) -> DataFrame:
    """One row for each dimension and block of rows, dealt by the hash of `row`: dim, block and what f(rows, dim) gives as `schema` declares."""
    kind = f"dim int, block int, {schema}"
    arrow = arrow_schema(rows, kind)

    def run(t: pa.Table) -> pa.Table:
        dim = t["dim"][0].as_py()
        return pa.table({"dim": [dim], "block": [t["block"][0].as_py()], **f(t, dim)}, schema=arrow)

    dealt = rows.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")})
    return dealt.groupBy("dim", "block").applyInArrow(run, kind)


def blocks_of(n: int, least: int, most: int, wanted: int) -> int:
    """Number of blocks for n rows: `least` rows in each, more if that would make more than `wanted` blocks, but never over `most`."""
    return max(1, -(-n // min(most, max(least, -(-n // wanted)))))
