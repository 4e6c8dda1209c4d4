"""Sparse matrices as blocks of entries, multiplied with tables of short vectors.

The entries are dealt to blocks of bounded size once, each written as one row,
so that a pass reads whole blocks where they lie.  In a pass every block
*pulls* the vectors of the rows or columns that occur in it, works on them in
numpy, and *pushes* one partial vector per key, which are added up per key.  A
key that occurs in every block costs one vector a block, however many entries it
has.  A factor of at most ``BROADCAST`` bytes (its size is known beforehand) is
pulled from a broadcast; a larger one by an equi-join on the key and a shuffle
by block, so that no task or driver ever holds it whole.

On this rest the singular value decomposition below, the topic model
(``topics``) and the document vectors (``vectors``).
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass
from functools import cached_property
from typing import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

#: Entries of a block (about 250 MB with its working copies: fewer blocks push fewer
#: partial vectors), and of one row's piece.
BLOCK_ENTRIES, PIECE = 1 << 22, 1 << 16
#: Doubles of a temporary array, triangular factors joined by one task, and
#: blocks from which partial sums are added up in two steps.
CELLS, FAN, TWO_STEPS = 1 << 18, 32, 512
#: Bytes of a factor that is broadcast, and rows of a table of words that may be.
BROADCAST, BROADCAST_ROWS = 1 << 25, 1 << 16

#: Vectors travel as the bytes of their doubles (or floats): one copy between Spark and numpy.
VECTORS = "key long, vec binary"
VECTORS_ARROW = pa.schema([("key", pa.int64()), ("vec", pa.binary())])


#: Spark deletes the shuffle files of a query at its end, not when the driver happens to collect garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The paths written inside each open ``temporary``.
_TEMPORARY: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: read by all later
    passes, and safe from lost executors.  Its shuffle files are freed at once."""
    spark = df.sparkSession
    ship_package(spark)
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    with shuffles_freed(spark):
        df.write.parquet(path)
    for paths in _TEMPORARY[-1:]:
        paths.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


@contextmanager
def shuffles_freed(spark):
    """What is written inside leaves no shuffle files."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_FREE_SHUFFLES) if before is None else spark.conf.set(_FREE_SHUFFLES, before)


def part(table: DataFrame, rows) -> DataFrame:
    """Some rows of a written table, which ``drop`` takes for the table."""
    out = table.where(rows)
    out.written_at = getattr(table, "written_at", None)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes tables of ``written`` that no later plan reads; other frames stay."""
    for t in tables:
        path = getattr(t, "written_at", None) if t is not None else None
        if path:
            _delete(t.sparkSession, path)


def _delete(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def temporary(spark):
    """Tables ``written`` inside are deleted at the end: for models that are written whole."""
    made: list[str] = []
    _TEMPORARY.append(made)
    try:
        yield made
    finally:
        _TEMPORARY.pop()
        for path in made:
            _delete(spark, path)


def settled(spark, build: Callable[[], DataFrame]) -> DataFrame:
    """The written table that ``build()`` returns; others that it wrote on the way are deleted."""
    with temporary(spark) as made:
        out = build()
        made.remove(out.written_at)
    for paths in _TEMPORARY[-1:]:
        paths.append(out.written_at)
    return out


def numbered(df: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` with a unique ``id``, written so that it never changes."""
    return written(df.withColumn("id", F.monotonically_increasing_id()), name)


def words_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a table with a row per word, as the side of a join: hashed by
    partition where it has many rows.  Files of words are several times smaller
    than the words in memory, so Spark would collect and broadcast them by the
    files' size, one table for every join at the same time."""
    return df.hint("shuffle_hash") if rows > BROADCAST_ROWS else df


def joined(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame, weight: str) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (a row per word) on ``key``.

    ``counts`` (key, weight) is a written table with each word's number of rows.
    Frequent words hold most rows, so their part of ``table`` is broadcast; only
    rows of other words are shuffled, and no word can fill a task.  At most half
    of ``BROADCAST_ROWS`` words are frequent, those of the largest weights, each of
    twice the mean at least.
    ``rows`` and ``table`` are read several times: they should be written tables."""
    total, n = (x or 0 for x in counts.agg(F.sum(weight), F.count(F.lit(1))).first())
    if n <= BROADCAST_ROWS:
        return rows.join(words_side(table, n), key)
    size = F.floor(F.log2(F.col(weight).cast("double")) * 8)
    least, held = None, 0
    for r in counts.where(F.col(weight) * n >= 2 * total).groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect():
        held += r["n"]
        if held > BROADCAST_ROWS // 2:
            break
        least = r["size"]
    if least is None:
        return rows.join(words_side(table, n), key)
    often = counts.where((F.col(weight) * n >= 2 * total) & (size >= least)).select(key)
    rare = rows.join(F.broadcast(often), key, "left_anti").join(words_side(table.join(F.broadcast(often), key, "left_anti"), n), key)
    return rows.join(F.broadcast(table.join(F.broadcast(often), key, "left_semi")), key).unionByName(rare)


# --- vectors in Arrow -------------------------------------------------------------

def matrix(column, real=np.float64) -> np.ndarray:
    """A column of equally long vectors, of doubles or of floats as ``real`` says, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        return np.vstack([matrix(c, real) for c in column.chunks]) if column.num_chunks else np.zeros((0, 0))
    n = len(column)
    if not n:
        return np.zeros((0, 0))
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[at[0]:at[-1]].view(real).reshape(n, -1)


def vectors(rows: np.ndarray, real=np.float64) -> pa.BinaryArray:
    n, width = rows.shape
    data = np.ascontiguousarray(rows, real)
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(data.itemsize * width)), pa.py_buffer(data)])


def batch(keys, rows: np.ndarray, real=np.float64) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), vectors(rows, real)], schema=VECTORS_ARROW)


def batches(keys, rows: np.ndarray, schema: pa.Schema = VECTORS_ARROW, real=np.float64, **columns):
    """Record batches of a few million numbers; ``columns`` are constants that stand before the key."""
    step = max(1, (1 << 22) // max(1, rows.shape[1]))
    for a in range(0, len(rows), step):
        part = rows[a:a + step]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), v), schema.field(c).type) for c, v in columns.items()]
                                         + [pa.array(keys[a:a + step], pa.int64()), vectors(part, real)], schema=schema)


def as_arrays(table: DataFrame, real=np.float64) -> DataFrame:
    """(key, vec) with vec as an array of doubles, for Spark's own functions."""
    def run(it):
        for b in it:
            x = matrix(b.column(1), real).astype(np.float64)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * (x.shape[1] if len(x) else 0), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], ["key", "vec"])
    return table.select("key", "vec").mapInArrow(run, "key long, vec array<double>")


def total(df: DataFrame) -> np.ndarray | None:
    """The sum of all vectors of a table: one partial sum a partition reaches the driver."""
    def run(it):
        out = None
        for b in it:
            if b.num_rows:
                x = matrix(b.column(0)).sum(0)
                out = x if out is None else out + x
        if out is not None:
            yield pa.RecordBatch.from_arrays([vectors(out[None])], ["vec"])
    got = matrix(df.select("vec").mapInArrow(run, "vec binary").toArrow().column("vec"))
    return got.sum(0) if len(got) else None


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    u = np.uint64
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return x ^ (x >> u(31))


def uniform(seeds: np.ndarray, width: int, stream: int = 0) -> np.ndarray:
    """Numbers in (0, 1), a row for each 64-bit seed: the same in whatever task."""
    at = _mix(np.arange(1, width + 1, dtype=np.uint64) + np.uint64(stream << 32))
    return ((_mix(seeds.view(np.uint64)[:, None] ^ at) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def random_vectors(keys: DataFrame, width: int, seed: int = 0, normal: bool = True, real=np.float64) -> DataFrame:
    """(key, hash) -> a random vector per key, from its hash."""
    def run(it):
        for b in it:
            h = b.column(1).to_numpy()
            if normal:
                x = np.sqrt(-2 * np.log(uniform(h, width, 2 * seed))) * np.cos(2 * np.pi * uniform(h, width, 2 * seed + 1))
            else:
                x = uniform(h, width, 2 * seed)
            yield batch(b.column(0), x, real)
    return keys.select("key", "hash").mapInArrow(run, VECTORS)


def summed(parts: DataFrame, blocks: int = 1, real=np.float64) -> DataFrame:
    """One vector per key, the sum of its parts (in doubles)."""
    def run(it):
        key, held = None, None
        for b in it:
            keys, x = b.column(0).to_numpy(), matrix(b.column(1), real)
            if not len(keys):
                continue
            heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            sums = np.add.reduceat(x, heads, axis=0, dtype=np.float64)
            keys = keys[heads]
            if key is not None and key == keys[0]:
                sums[0] += held
            elif key is not None:
                yield batch([key], held[None], real)
            key, held = keys[-1], sums[-1].copy()
            if len(keys) > 1:
                yield batch(keys[:-1], sums[:-1], real)
        if key is not None:
            yield batch([key], held[None], real)

    if blocks > TWO_STEPS:
        parts = parts.repartition("key", F.pmod(F.spark_partition_id(), F.lit(64))).sortWithinPartitions("key").mapInArrow(run, VECTORS)
    return parts.repartition("key").sortWithinPartitions("key").mapInArrow(run, VECTORS)


def transformed(table: DataFrame, by: np.ndarray, real=np.float64) -> DataFrame:
    """Every vector times a small matrix."""
    def run(it):
        for b in it:
            if b.num_rows:
                yield batch(b.column(0), matrix(b.column(1), real) @ by, real)
    return table.mapInArrow(run, VECTORS)


def triangular(table: DataFrame, real=np.float64) -> np.ndarray:
    """The triangular factor R of the tall matrix of a table's vectors (``table =
    QR``): one per partition, then joined ``FAN`` at a time until few are left."""
    def run(it, real=np.float64):
        held = None
        for b in it:
            if b.num_rows:
                x = matrix(b.column("vec"), real).astype(np.float64)
                held = np.linalg.qr(x if held is None else np.vstack([held, x]), mode="r")
        if held is not None:
            yield pa.RecordBatch.from_arrays([vectors(held)], ["vec"])

    parts = table.select("vec")
    n = parts.rdd.getNumPartitions()
    factors, kept = parts.mapInArrow(lambda it: run(it, real), "vec binary"), []
    while n > FAN:
        n = -(-n // FAN)
        kept.append(written(factors, "triangular"))
        factors = kept[-1].repartition(n).mapInArrow(run, "vec binary")
    rows = matrix(factors.toArrow().column("vec"))  # at most FAN factors
    drop(*kept)
    return np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, 0))


def orthonormaliser(table: DataFrame, real=np.float64) -> tuple[np.ndarray, np.ndarray]:
    """(the small matrix that makes the table's columns an orthonormal basis of their space, all singular values)."""
    _, s, w = np.linalg.svd(triangular(table, real), full_matrices=False)
    keep = s > (s[:1].sum() or 1.0) * 1e-12
    return w[keep].T / s[keep], s


def orthonormal(table: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(an orthonormal basis of the same column space, singular values of the table's matrix)."""
    turn, s = orthonormaliser(table)
    return transformed(table, turn), s


# --- blocks -------------------------------------------------------------------------

def multiplied(group: np.ndarray, n: int, x: np.ndarray, at: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """out[g] = sum of x * factor[at] over the entries of group g (sorted), in slices that fit the cache."""
    out = np.zeros((n, factor.shape[1]), factor.dtype)
    step = max(1, CELLS // max(1, factor.shape[1]))
    for a in range(0, len(x), step):
        g = group[a:a + step]
        heads = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        out[g[heads]] += np.add.reduceat(x[a:a + step, None] * factor[at[a:a + step]], heads, axis=0)
    return out


#: A block as one row: its rows, their numbers of entries, its columns, and the entries' columns and values.
_STORED = pa.schema([("block", pa.int32()), ("rows", pa.binary()), ("sizes", pa.binary()), ("cols", pa.binary()), ("col", pa.binary()), ("x", pa.binary())])


@dataclass
class Block:
    """One block's entries, with rows and columns as numbers of the block."""

    rows: np.ndarray
    cols: np.ndarray
    row: np.ndarray
    col: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(table: pa.Table) -> "Block":
        cols = table.column("cols").combine_chunks()
        n = np.diff(cols.offsets.to_numpy())
        rows, row = np.unique(table.column("row").to_numpy(), return_inverse=True)
        used, col = np.unique(cols.flatten().to_numpy(), return_inverse=True)
        row = np.repeat(row, n)
        order = np.argsort(row, kind="stable")
        x = table.column("xs").combine_chunks().flatten().to_numpy()
        return Block(rows, used, row[order], col[order], x[order])

    @staticmethod
    def read(b: pa.RecordBatch | pa.Table, i: int, real=np.float64) -> "Block":
        """The block of row ``i`` of a table of ``_STORED``."""
        whole = lambda name, kind: np.frombuffer(b.column(name)[i].as_buffer(), kind)
        rows, sizes, col = whole("rows", np.int64), whole("sizes", np.int32), whole("col", np.int32)
        held = np.float32 if len(b.column("x")[i].as_buffer()) == 4 * len(col) else np.float64
        return Block(rows, whole("cols", np.int64), np.repeat(np.arange(len(rows)), sizes), col, whole("x", held).astype(real, copy=False))

    def stored(self, number: int, real=np.float64) -> pa.RecordBatch:
        """The block as a row; doubles that are floats (counts) are kept as floats."""
        sizes, x = np.bincount(self.row, minlength=len(self.rows)), self.x.astype(np.float32)
        cells = [np.ascontiguousarray(v, kind).tobytes() for v, kind in (
            (self.rows, np.int64), (sizes, np.int32), (self.cols, np.int64), (self.col, np.int32),
            (self.x, np.float32 if real == np.float32 or (x == self.x).all() else np.float64))]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *(pa.array([c], pa.binary()) for c in cells)], schema=_STORED)

    @cached_property
    def by_col(self) -> np.ndarray:
        """The order of the entries by column."""
        return np.argsort(self.col, kind="stable")

    def times(self, factor: np.ndarray) -> np.ndarray:
        """A F for a factor with a row for each of the block's columns."""
        return multiplied(self.row, len(self.rows), self.x, self.col, factor)

    def transposed_times(self, factor: np.ndarray) -> np.ndarray:
        """A' F for a factor with a row for each of the block's rows."""
        return self.weighted_by_col(self.x, factor)

    def weighted_by_col(self, x: np.ndarray, factor: np.ndarray, n: int | None = None) -> np.ndarray:
        """Sums by column of ``x`` (a number per entry) times the entry's row of ``factor``."""
        order = self.by_col
        return multiplied(self.col[order], len(self.cols) if n is None else n, x[order], self.row[order], factor)


class Blocks:
    """A sparse matrix (row, col, x) with long keys, written as blocks, a row for each.

    ``whole`` rows lie in one block each (documents, say, whose size is bounded);
    other rows are split where they have more than ``piece`` entries.  ``n_cols``
    is a bound on the number of columns, where the caller knows one.  Small matrices
    are ``spread`` over all cores, or else lie in as few blocks as hold them.
    Entries and vectors are doubles, or floats as ``real`` says.
    """

    def __init__(self, entries: DataFrame, whole: bool = True, per_block: int = BLOCK_ENTRIES, piece: int = PIECE, n_cols: int | None = None,
                 spread: bool = True, real=np.float64):
        entries, gone = entries.select("row", "col", F.col("x").cast("double").alias("x")), []
        if whole:
            pieces = entries.withColumn("piece", F.lit(0))
        else:
            entries = written(entries, "entries")
            long_rows = written(entries.groupBy("row").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece), "long_rows")
            gone = [entries, long_rows]
            pieces = entries.join(long_rows, "row", "left").withColumn(
                "piece", F.coalesce(F.pmod(F.xxhash64("col"), F.ceil(F.col("n") / piece)), F.lit(0)).cast("int"))
        packed = written(pieces.groupBy("row", "piece").agg(F.sort_array(F.collect_list(F.struct("col", "x"))).alias("e"))
                         .select("row", "piece", F.col("e.col").alias("cols"), F.col("e.x").alias("xs")), "packed")
        drop(*gone)
        size = packed.agg(F.sum(F.size("cols")).alias("n"), F.count(F.lit(1)).alias("pieces"), F.max("piece").alias("piece"))
        self.n_entries, pieces, last = (x or 0 for x in size.first())
        self.whole, self.real = last == 0, real
        self.n_rows = pieces if self.whole else packed.select("row").distinct().count()
        cores = packed.sparkSession.sparkContext.defaultParallelism
        self.n_blocks = max(1, -(-self.n_entries // per_block), min(cores, self.n_entries // 4096) if spread else 1)
        block = F.pmod(F.xxhash64("row", "piece"), F.lit(self.n_blocks)).cast("int").alias("block")

        def store(it):
            table = _whole(it, _PACKED)
            numbers = pa.compute.unique(table.column("block")).to_pylist()
            for number in numbers:  # one, as a rule: no second copy of its entries
                yield Block.of(table.filter(pa.compute.equal(table.column("block"), number)) if len(numbers) > 1 else table).stored(number, real)
        self.blocks = written(packed.select(block, "row", "cols", "xs").repartitionById(self.n_blocks, F.col("block"))
                              .mapInArrow(store, _ddl(_STORED)), "blocks")
        drop(packed)
        self._needs: dict[str, DataFrame] = {}
        self._keys = {"row": self.n_rows} | ({} if n_cols is None else {"col": n_cols})
        self._held: list = []

    def needs(self, side: str) -> DataFrame:
        """(block, key): the rows or columns that occur in each block."""
        if side not in self._needs:
            def run(it):
                for b in it:
                    for i in range(b.num_rows):
                        keys = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                        for a in range(0, len(keys), 1 << 20):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[a:a + (1 << 20)]), b.column(0)[i].as_py()), pa.int32()),
                                                              pa.array(keys[a:a + (1 << 20)])], ["block", "key"])
            self._needs[side] = written(self.blocks.select("block", f"{side}s").mapInArrow(run, "block int, key long"), f"needs_{side}")
        return self._needs[side]

    def n_keys(self, side: str) -> int:
        if side not in self._keys:
            self._keys[side] = self.needs(side).select("key").distinct().count()
        return self._keys[side]

    def run(self, table: DataFrame, width: int, work: Callable, schema: pa.Schema, side: str = "col",
            state: DataFrame | None = None, state_width: int | None = None) -> DataFrame:
        """``work(block number, Block, factor, state)`` -> record batches, on every block.

        ``factor`` has the vectors of ``table`` (key, vec of ``width`` numbers)
        for the block's columns (or rows, by ``side``), ``state`` what the rows
        (block, key, vec of ``state_width`` numbers) of that table hold for the
        block's rows, None for none.  Where both are small enough to be broadcast,
        the blocks are read where they lie; else each meets its vectors in a partition.
        """
        real = self.real
        fits = lambda n, keys: n is not None and np.dtype(real).itemsize * n * keys <= BROADCAST
        small, few = fits(width, self.n_keys(side)), state is None or fits(state_width, self.n_rows)
        held = self._broadcast(table) if small else None
        kept = self._broadcast(state) if few and state is not None else None

        def found(block: Block, more: pa.Table | None):
            keys = block.cols if side == "col" else block.rows
            factor = _of_keys(held.value, keys) if small else _rows_of(more, 0, real)
            if kept is not None:
                return factor, _of_keys(kept.value, block.rows)
            return factor, None if more is None else _rows_of(more, 1, real)

        def alone(it):
            for b in it:
                for i in range(b.num_rows):
                    block = Block.read(b, i, real)
                    yield from work(b.column("block")[i].as_py(), block, *found(block, None))

        def together(it):
            table = _whole(it, _MEETING)
            numbers = pa.compute.unique(table.column("block")).to_pylist()
            for number in numbers:
                more = table.filter(pa.compute.equal(table.column("block"), number)) if len(numbers) > 1 else table
                block = Block.read(more.filter(pa.compute.equal(more.column("kind"), _BLOCK)), 0, real)
                yield from work(number, block, *found(block, more.select(["kind", "key", "vec"])))

        if small and few:
            return self.blocks.mapInArrow(alone, _ddl(schema))
        kind = lambda df, n: df.select(F.lit(n).alias("kind"), "block", "key", "vec")
        every = self.blocks.withColumn("kind", F.lit(_BLOCK))
        if not small:
            every = every.unionByName(kind(words_side(self.needs(side), self.n_keys(side)).join(table, "key"), 0), allowMissingColumns=True)
        if not few:
            every = every.unionByName(kind(state, 1), allowMissingColumns=True)
        # a partition of its own for each block: hashed, several large blocks would meet in one task
        return every.select(*_MEETING.names).repartitionById(self.n_blocks, F.col("block")).mapInArrow(together, _ddl(schema))

    def _broadcast(self, table: DataFrame):
        self._held.append(broadcast_factor(table, self.real))
        return self._held[-1]

    def free(self) -> None:
        """Deletes the broadcasts of passes that have been written."""
        while self._held:
            self._held.pop().destroy()

    def drop(self) -> None:
        """Deletes the tables of a matrix that no later pass reads."""
        self.free()
        drop(self.blocks, *self._needs.values())

    def times(self, table: DataFrame, width: int) -> DataFrame:
        """A F for F (key = column, vec): (key = row, vec)."""
        real = self.real
        work = lambda _, block, factor, __: batches(block.rows, block.times(factor), real=real)
        return summed(self.run(table, width, work, VECTORS_ARROW), self.n_blocks, real)

    def gram_times(self, table: DataFrame, width: int) -> DataFrame:
        """A' A F: in one pass where every row is whole, else in two."""
        real = self.real
        if self.whole:
            work = lambda _, block, factor, __: batches(block.cols, block.transposed_times(block.times(factor)), real=real)
            return summed(self.run(table, width, work, VECTORS_ARROW), self.n_blocks, real)
        work = lambda _, block, factor, __: batches(block.cols, block.transposed_times(factor), real=real)
        return summed(self.run(written(self.times(table, width), "product"), width, work, VECTORS_ARROW, side="row"), self.n_blocks, real)

    def gram_step(self, table: DataFrame, width: int, less: DataFrame | None) -> tuple[DataFrame, np.ndarray]:
        """(A' A F - ``less``, F' A' A F) of whole rows, in one pass; the first is written."""
        real = self.real

        def work(_, block, factor, __):
            y = block.times(factor)
            yield from batches(block.cols, block.transposed_times(y), real=real)
            yield batch(_SIDE + np.arange(width), y.T @ y, real)
        parts = self.run(table, width, work, VECTORS_ARROW)
        if less is not None:
            parts = parts.unionByName(transformed(less, -np.eye(width), real))
        done = written(summed(parts, self.n_blocks, real), "subspace")
        side = done.where(F.col("key") < _SIDE + width).toArrow()
        return part(done, F.col("key") >= _SIDE + width), matrix(side.column("vec"), real)[np.argsort(side.column("key").to_numpy())].astype(np.float64)


#: The first of the smallest keys, which hold the rows of a small matrix beside the columns' vectors.
_SIDE = -1 << 63
_DDL = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary"}
#: What meets in a block's partition: vectors of kinds 0 (its keys') and 1 (its state), and the block itself.
_BLOCK = 2
_MEETING = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("vec", pa.binary()), *_STORED])
_PACKED = pa.schema([("block", pa.int32()), ("row", pa.int64()), ("cols", pa.list_(pa.int64())), ("xs", pa.list_(pa.float64()))])


def _whole(it, schema: pa.Schema) -> pa.Table:
    """All rows of a task."""
    full = [b for b in it if b.num_rows]
    return pa.Table.from_batches(full) if full else schema.empty_table()


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema)


def _of_keys(held: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
    return held[1][np.searchsorted(held[0], keys)]


def _rows_of(more: pa.Table, kind: int, real=np.float64) -> np.ndarray | None:
    """The vectors of one kind in the order of their keys, which is that of a block's own numbers."""
    more = more.filter(pa.compute.equal(more.column("kind"), kind))
    if not more.num_rows:
        return None
    return matrix(more.column("vec"), real)[np.argsort(more.column("key").to_numpy())]


def broadcast_factor(table: DataFrame, real=np.float64):
    """(sorted keys, vectors) of a table of checked size."""
    got = table.select("key", "vec").toArrow()
    keys = got.column("key").to_numpy()
    order = np.argsort(keys)
    return table.sparkSession.sparkContext.broadcast((keys[order], matrix(got.column("vec"), real)[order]))


@dataclass
class Decomposition:
    """``rows`` (key, vec = U S), ``cols`` (key, vec = V), with arrays, and the singular values."""

    rows: DataFrame
    cols: DataFrame
    values: np.ndarray
    rounds: int


def decompose(a: Blocks, starts: DataFrame, k: int, symmetric: bool = False, tol: float = 1e-11, most: int = 60) -> Decomposition:
    """Truncated singular value decomposition by randomised subspace iteration.

    ``starts`` (key, vec) holds a random vector per column, of ``k`` and some
    more components.  Rounds of one pass each (``symmetric``: A F, else A'A F)
    and a distributed orthonormalisation go on until the k largest singular
    values change by less than ``tol`` of themselves, ``most`` at most; where
    the matrix has no more than that rank, the first round is exact.  Rounds
    over whole rows have momentum, which about halves their number or better.
    Signs: the sum of the cubes of a component's column weights is positive.
    """
    real = a.real
    z, (turn, s) = starts, orthonormaliser(starts, real)
    before, rounds, last, least = None, 0, None, 0.0
    quick = a.whole and not symmetric and a.n_entries > 0
    made: list[DataFrame] = []  # the tables of this iteration that may still be read
    while True:
        rounds += 1
        width, basis = max(1, turn.shape[1]), transformed(z, turn, real)
        if quick:
            # momentum: X'' = A'A X' - (least / 2)^2 X damps all components below ``least`` evenly.  The smallest
            # Ritz value is never above that of the true component, so no wanted component is damped
            less = None if last is None or not least else transformed(last[0], last[1] * (least ** 2 / 4), real)
            new, gram = a.gram_step(basis, width, less)
            ritz = np.linalg.eigvalsh(gram)[::-1].clip(0)
            now = np.sqrt(ritz)[:k]
            least = max(least, ritz[-1]) if len(ritz) > k else 0.0
        else:
            new = written(a.times(basis, width) if symmetric else a.gram_times(basis, width), "subspace")
        a.free()
        made.append(new)
        by, s = orthonormaliser(new, real)
        if quick and by.shape[1] < width:  # no more components: the basis is exact
            last, least = None, 0.0
        elif quick:
            last = (z, turn @ by)
        else:
            now = (s if symmetric else np.sqrt(s))[:k]
        z, turn = new, by
        read = [z] + ([last[0]] if last else [])
        drop(*(t for t in made if not any(t is r for r in read)))
        made = [t for t in made if any(t is r for r in read)]
        if rounds >= most or before is not None and len(now) == len(before) and np.all(np.abs(now - before) <= tol * now):
            break
        before = now
    width, basis = max(1, turn.shape[1]), transformed(z, turn, real)
    basis = written(basis, "basis")
    drop(*made)
    y = written(a.times(basis, width), "projected")
    a.free()
    _, s, w = np.linalg.svd(triangular(y, real), full_matrices=False)
    k = min(k, int((s > (s[:1].sum() or 1.0) * 1e-12).sum()))
    turn = w[:k].T
    cols = written(transformed(basis, turn, real), "cols")
    drop(basis)
    signs = np.where(_cubes(cols, k, real) < 0, -1.0, 1.0)
    return Decomposition(as_arrays(transformed(y, turn * signs, real), real), as_arrays(transformed(cols, np.diag(signs), real), real), s[:k], rounds)


def _cubes(cols: DataFrame, k: int, real=np.float64) -> np.ndarray:
    def run(it):
        for b in it:
            if b.num_rows:
                yield batch([0], (matrix(b.column("vec"), real).astype(np.float64) ** 3).sum(0)[None])
    found = total(cols.mapInArrow(run, VECTORS))
    return np.zeros(k) if found is None else found
