"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

A unit vector u is kept as int8 codes with its own scale, u = û + r with the
length of r known.  For two vectors ``|u.v - û.v̂| <= |û| |r_v| + |r_u|``, so a
pair whose coded product is further than that below the threshold cannot reach
it, and only the others are computed again in double precision.  Nothing is
missed and nothing below the threshold is linked.

Vectors are dealt into blocks around pivots; a block pair is one task of matrix
products over small tiles.  A vector goes to another block only if its angle to
that block's pivot allows a link (angles obey the triangle inequality).  Tasks
return link counts and a spanning forest, never pairs, so a group of copies
costs its size in rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_ddl, only, record_batch, table
from .components import components
from .embeddings import matrix, packed, unpacked, usable

#: Vectors in a block, rows of a tile, and most pivots.
BLOCK, TILE, PIVOTS = 8192, 1024, 256
#: Added to every bound for the rounding of the float32 products.
ROUNDING = 1e-5

_CODED = pa.schema([("uid", pa.int64()), ("codes", pa.binary()), ("scale", pa.float64()), ("error", pa.float64()),
                    ("unit", pa.binary()), ("pivot", pa.int32()), ("angles", pa.binary())])
_SENT = pa.schema([("one", pa.int32()), ("two", pa.int32()), ("block", pa.int32()), ("uid", pa.int64()), ("codes", pa.binary()),
                   ("scale", pa.float64()), ("error", pa.float64()), ("unit", pa.binary())])
_FOUND = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def quantised(u: np.ndarray):
    """int8 codes, scales (u ~ codes * scale) and residual lengths of unit rows."""
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    return codes, scale, np.linalg.norm(u - codes * scale[:, None], axis=1)


def _coded(pivots):
    def run(it):
        p = pivots.value
        for b in it:
            m = matrix(b.column("v"))
            m = m / np.abs(m).max(1, keepdims=True)  # lengths neither overflow nor vanish
            u = m / np.linalg.norm(m, axis=1, keepdims=True)
            codes, scale, error = quantised(u)
            angles = np.arccos(np.clip(u @ p.T, -1, 1))
            yield record_batch(_CODED, b.column("uid"), packed(codes), scale, error, packed(u),
                               angles.argmin(1).astype(np.int32), packed(angles))
    return run


def _sent(blocks, reach: float):
    """Each vector to the block pairs that it may have links in."""
    def run(it):
        first, count, radius, numbers = blocks.value  # by pivot; ``numbers``: (pivot, block) of all blocks
        for b in it:
            angles = unpacked(b.column("angles"), np.float64)
            pivot = b.column("pivot").to_numpy()
            uid = b.column("uid").to_numpy()
            own = (first[pivot] + uid % count[pivot]).astype(np.int32)
            for p, k in numbers:
                rows = np.flatnonzero((angles[:, p] <= radius[p] + reach) | (own == k))
                if len(rows):
                    mine, other = own[rows], np.full(len(rows), k, np.int32)
                    part = b.take(pa.array(rows))
                    yield record_batch(_SENT, np.minimum(mine, other), np.maximum(mine, other), mine,
                                       *(part.column(c) for c in ("uid", "codes", "scale", "error", "unit")))
    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position each of n positions is joined to by the links a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _linked(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
        side = group.column("block").to_numpy()
        order = np.argsort(side != one, kind="stable")
        group = group.take(pa.array(order))
        m = int((side == one).sum())
        n = len(order)
        uid = group.column("uid").to_numpy()
        scale, error = group.column("scale").to_numpy(), group.column("error").to_numpy()
        coded = (unpacked(group.column("codes"), np.int8) * scale[:, None]).astype(np.float32)
        unit = unpacked(group.column("unit"), np.float64)
        links, label = np.zeros(n, np.int64), np.arange(n)
        within = one == two
        for lo in range(0, m, TILE):
            hi = min(m, lo + TILE)
            worst = error[lo:hi].max()
            for start in range(lo if within else m, n, TILE):
                end = min(n, start + TILE)
                least = (threshold - ROUNDING - worst - (1 + worst) * error[start:end]).astype(np.float32)
                i, j = np.nonzero(coded[lo:hi] @ coded[start:end].T >= least)
                i, j = i + lo, j + start
                if within:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                # in blocks of pairs, the exact value
                sure = np.concatenate([np.einsum("ij,ij->i", unit[i[k:k + 65536]], unit[j[k:k + 65536]]) >= threshold
                                       for k in range(0, len(i), 65536)])
                i, j = i[sure], j[sure]
                links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
                differ = label[i] != label[j]
                if differ.any():
                    label = _forest(n, np.r_[np.arange(n), i[differ]], np.r_[label, j[differ]])
        some = np.flatnonzero(links)
        return pa.Table.from_batches([record_batch(_FOUND, uid[some], links[some], uid[label[some]])])
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, block: int = BLOCK, vec_id: str = "vec_id",
                    embedding: str = "embedding") -> DataFrame:
    """Links between all vectors of cosine ``threshold`` (over 0) or more, and their components.

    Returns vec_id, n_links, component_id (smallest vec_id reachable by links,
    itself included) and kept (vec_id = component_id), one row per input row.
    Embeddings that are null, empty, zero, of another length than most, or hold
    null or non-finite components link with nothing.  Rows with equal vec_ids
    are vectors of their own; a null vec_id is a component's id only if no
    member has one, and its row is never kept.  Other columns are ignored; an
    empty table gives none.
    """
    spark = vectors.sparkSession
    s = Scratch(spark, "embedding-dedup")
    base = s.write(only(vectors, vec_id=vec_id, v=embedding).withColumn("uid", F.monotonically_increasing_id()), "base")
    good = usable(base, "uid", "v").withColumnRenamed("vec_id", "uid")
    n = good.count()
    wanted = max(1, min(PIVOTS, n // block))
    # pivots: rows at even steps of a hash order (any choice is right; it sets only what is pruned)
    picked = good.orderBy(F.xxhash64("uid"), "uid").limit(wanted).collect()
    if not picked:
        return base.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                           F.col("vec_id").isNotNull().alias("kept"))
    p = np.array([r["v"] for r in picked])
    p /= np.abs(p).max(1, keepdims=True)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    coded = s.write(good.mapInArrow(_coded(spark.sparkContext.broadcast(p)), arrow_ddl(_CODED)), "coded")
    stat = coded.select("pivot", F.col("angles")).mapInArrow(_radius, "pivot int, rows long, radius double")
    stat = {r["pivot"]: r for r in stat.groupBy("pivot").agg(F.sum("rows").alias("rows"), F.max("radius").alias("radius")).collect()}
    count = np.array([-(-stat[k]["rows"] // block) if k in stat else 1 for k in range(len(p))])
    radius = np.array([stat[k]["radius"] if k in stat else -9.0 for k in range(len(p))])
    first = np.cumsum(count) - count
    numbers = [(k, int(first[k]) + i) for k in range(len(p)) for i in range(count[k])]
    blocks = spark.sparkContext.broadcast((first, count, radius, numbers))
    sent = coded.mapInArrow(_sent(blocks, float(np.arccos(threshold)) + 1e-6), arrow_ddl(_SENT))
    found = s.write(sent.groupBy("one", "two").applyInArrow(_linked(threshold), arrow_ddl(_FOUND)), "found")
    s.drop("coded")
    root = s.write(components(found.select(F.col("uid").alias("a"), F.col("other").alias("b"))), "roots")
    total = found.groupBy("uid").agg(F.sum("links").alias("n_links"))
    rooted = (base.select("uid", "vec_id").join(total, "uid", "left")
              .join(root.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    least = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    return rooted.join(least, "root").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
        F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _radius(it):
    for b in it:
        pivot = b.column("pivot").to_numpy()
        angle = unpacked(b.column("angles"), np.float64)[np.arange(len(pivot)), pivot]
        keys = np.unique(pivot)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([int((pivot == k).sum()) for k in keys], pa.int64()),
             pa.array([float(angle[pivot == k].max()) for k in keys], pa.float64())], names=["pivot", "rows", "radius"])


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine 0.9 or more, all rows of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


QUERIES = {"op10_embedding_near_dedup": op10_embedding_near_dedup}

ORACLE_SQL = {"op10_embedding_near_dedup": r"""
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(e.vec_id, coalesce(low.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN low ON low.a = e.vec_id
"""}
