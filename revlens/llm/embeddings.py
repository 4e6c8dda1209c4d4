"""Embedding columns as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v): the rows whose embedding has only finite components, not
    all zero, and the most frequent length (the longer one of equals)."""
    v = only(vectors, vec_id=vec_id, v=embedding).where("v is not null")
    inf = float("inf")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == inf))
    v = v.where(~bad & F.exists("v", lambda x: x != 0)).withColumn("v", F.col("v").cast("array<double>"))
    length = v.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return v.where(F.size("v") == (length["n"] if length else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list<double> column (same lengths, no nulls) as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def packed(m: np.ndarray) -> pa.Array:
    """One binary value per row of a matrix."""
    m = np.ascontiguousarray(m)
    width = m.shape[1] * m.itemsize
    offsets = np.arange(len(m) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(m)])


def unpacked(column: pa.Array, kind) -> np.ndarray:
    """The matrix of a ``packed`` column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)
