"""Small helpers shared by the operators: tables, scratch space, Arrow output."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, ship_package  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate Parquet tables in the shared folder ``spark.checkpoint.dir``.

    A written table cuts the lineage, survives lost executors and has exact
    size statistics, so Catalyst broadcasts it only when it really is small.
    ``drop`` deletes tables that no later plan reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        ship_package(spark)
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def batches(it, columns: list[str]):
    """Record batches -> tuples of the named columns as pyarrow arrays."""
    for b in it:
        yield tuple(b.column(b.schema.get_field_index(c)) for c in columns)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type) for c, f in zip(columns, schema)],
        schema=schema)


def list_array(offsets, values, kind: pa.DataType) -> pa.ListArray:
    """Arrow list column from row offsets (n + 1) and flat values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` reduced to the named columns under the operator's own names, so
    extra or clashing columns of the caller never meet the operator's."""
    return df.select(*(F.col(f"`{src}`").alias(dst) for dst, src in columns.items()))


def text_slices(it, column: str = "text", most: int = 1 << 19):
    """Record batches cut so that each holds about ``most`` bytes of text (one
    longer text stays whole): the vectorised kernels then work in cache and
    their memory does not depend on the size of Spark's batches."""
    for b in it:
        text = b.column(b.schema.get_field_index(column))
        lo, size = 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(text), 0).to_numpy(zero_copy_only=False)
        for i, n in enumerate(sizes):
            if size and size + n > most:
                yield b.slice(lo, i - lo)
                lo, size = i, 0
            size += int(n)
        if lo < b.num_rows:
            yield b.slice(lo)


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def thrifty(run):
    """``run`` (batches -> batches), giving its memory back when it ends: Spark keeps
    Python workers, and each would hold the most that any of its tasks took."""
    def outer(it):
        yield from run(it)
        give_back()
    return outer


def runs(it, keys: list[str]):
    """Batches sorted by ``keys`` -> one table per key, also where a key goes on
    in the next batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in it:
        if not b.num_rows:
            continue
        k = np.stack([b.column(c).to_numpy() for c in keys], 1)
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        if held and (last != k[0]).any():
            yield pa.Table.from_batches(held)
            held = []
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(k)]):
            held.append(b.slice(lo, hi - lo))
            if hi < len(k):
                yield pa.Table.from_batches(held)
                held = []
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def in_buckets(df: DataFrame, key, wanted: DataFrame, wanted_key, bits: int = 18) -> DataFrame:
    """Rows of ``df`` whose key's hash bucket occurs in ``wanted``: a cheap first
    filter before an exact join, broadcasting at most 2**bits bucket numbers."""
    number = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << bits))
    buckets = wanted.select(number(wanted_key).alias("_bucket")).distinct()
    return df.withColumn("_bucket", number(key)).join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")


_KINDS = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.string(): "string", pa.binary(): "binary",
          pa.bool_(): "boolean"}


def arrow_ddl(schema: pa.Schema) -> str:
    """The Spark schema of an Arrow schema, for ``mapInArrow``."""
    def kind(t):
        return f"array<{kind(t.value_type)}>" if pa.types.is_list(t) else _KINDS[t]
    return ", ".join(f"`{f.name}` {kind(f.type)}" for f in schema)
