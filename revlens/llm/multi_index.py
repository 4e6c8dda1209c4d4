"""Nearest neighbours by an inverted multi-index (Babenko and Lempitsky).

Vectors are first made comparable by distance: with one more component
``sqrt(M^2 - |x|^2)`` (M the greatest length) the nearest vector is the one of
largest inner product.  Each half of the vector is quantised with its own
codebook, so a cell is a pair of centroids.  A query walks the pairs by
increasing summed distance with a heap until the cells visited hold enough
vectors, and their entries are reranked by the exact inner product.

The codebooks are fitted on a bounded sample; every vector is indexed.  How
many vectors are enough is measured: exact neighbours of a bounded sample of
queries, sought among all vectors, give the smallest number that reaches the
target recall.  Posting lists are dealt by first centroid and, where one holds
many rows, by hash into blocks, so no task depends on the size of a list.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_ddl, only, record_batch, table
from .embeddings import matrix, packed, unpacked, usable

#: Vectors that the codebooks are fitted on, and queries that the number of visits is measured on.
SAMPLE, PROBES = 20_000, 256
#: Vectors of one block of a posting list.
BLOCK = 8192

_ENTRIES = pa.schema([("vec_id", pa.int64()), ("uid", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("vector", pa.binary())])
_VISITS = pa.schema([("query", pa.int64()), ("i", pa.int32()), ("block", pa.int32()), ("cells", pa.binary()), ("vector", pa.binary())])
_HITS = pa.schema([("query", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def codebook(x: np.ndarray, size: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(size, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def halves(x: np.ndarray, longest: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of vectors with the additional component; of queries (None) it is 0."""
    more = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest ** 2 - (x * x).sum(1), 0))
    half = x.shape[1] // 2
    return x[:, :half], np.c_[x[:, half:], more]


def walk(d1: np.ndarray, d2: np.ndarray, held: np.ndarray, enough: float):
    """Cells (i, j) by increasing d1[i] + d2[j] until they hold ``enough``
    vectors: the multi-sequence algorithm.  ``held[i, j]``: vectors of a cell."""
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, reached = [(s1[0] + s2[0], 0, 0)], [0] * len(o1)  # reached[a]: pairs of row a put on the heap
    reached[0] = 1
    out, total = [], 0
    while heap and total < enough:
        _, a, b = heapq.heappop(heap)
        i, j = o1[a], o2[b]
        out.append((i, j))
        total += held[i][j]
        if b + 1 < len(o2):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
        if b == 0 and a + 1 < len(o1):
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
    return out


def _entries(index):
    def run(it):
        c1, c2, longest, scale = index.value
        for b in it:
            x = matrix(b.column("v"))
            h1, h2 = halves(x / scale, longest)
            yield record_batch(_ENTRIES, b.column("vec_id"), b.column("uid"), _distances(h1, c1).argmin(1).astype(np.int32),
                               _distances(h2, c2).argmin(1).astype(np.int32), packed(x))
    return run


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to smaller ids."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _exact(probes, k: int):
    """Best entries of every batch for the probe queries."""
    def run(it):
        uids, q = probes.value
        for b in it:
            x, uid = unpacked(b.column("vector"), np.float64), b.column("uid").to_numpy()
            cell = np.c_[b.column("i").to_numpy(), b.column("j").to_numpy()]
            scores = q @ x.T
            rows = []
            for p in range(len(q)):
                s = np.where(uid == uids[p], -np.inf, scores[p])
                best = _best(uid, s, k)
                rows += [(int(uids[p]), float(s[r]), int(cell[r, 0]), int(cell[r, 1]), int(uid[r])) for r in best if s[r] > -np.inf]
            yield pa.RecordBatch.from_pylist([dict(zip(("probe", "score", "i", "j", "uid"), r)) for r in rows],
                                             schema=pa.schema([("probe", pa.int64()), ("score", pa.float64()), ("i", pa.int32()),
                                                               ("j", pa.int32()), ("uid", pa.int64())]))
    return run


def _visits(index, held, blocks, enough: float):
    def run(it):
        c1, c2, _, scale = index.value
        cells, n_blocks = held.value, blocks.value
        for b in it:
            x = matrix(b.column("v"))
            h1, h2 = halves(x / scale, None)
            d1, d2 = _distances(h1, c1), _distances(h2, c2)
            uid = b.column("uid").to_numpy()
            for r in range(len(x)):
                seen = np.zeros((len(c1), len(c2)), np.uint8)
                pairs = np.array(walk(d1[r], d2[r], cells, enough))
                seen[pairs[:, 0], pairs[:, 1]] = 1
                i = np.flatnonzero(seen.any(1) & (n_blocks > 0))
                i, block = np.repeat(i, n_blocks[i]), np.concatenate([np.arange(n) for n in n_blocks[i]]) if len(i) else i
                yield record_batch(_VISITS, np.full(len(i), uid[r]), i.astype(np.int32), block.astype(np.int32),
                                   packed(seen[i]), packed(np.repeat(x[r:r + 1], len(i), 0)))
    return run


def _reranked(k: int):
    def run(entries: pa.Table, visits: pa.Table) -> pa.Table:
        if not len(entries) or not len(visits):
            return pa.Table.from_batches([], schema=_HITS)
        x, j = unpacked(entries.column("vector"), np.float64), entries.column("j").to_numpy()
        uid, ids = entries.column("uid").to_numpy(), entries.column("vec_id").to_numpy()
        order = np.argsort(j, kind="stable")  # the posting lists, one after another
        x, uid, ids = x[order], uid[order], ids[order]
        start = np.searchsorted(j[order], np.arange(j.max() + 2))
        q, cells = unpacked(visits.column("vector"), np.float64), unpacked(visits.column("cells"), np.uint8)
        out = []
        for r, query in enumerate(visits.column("query").to_numpy()):
            lists = [c for c in np.flatnonzero(cells[r]) if c + 1 < len(start)]
            if not lists:
                continue
            rows = np.concatenate([np.arange(start[c], start[c + 1]) for c in lists])
            rows = rows[uid[rows] != query]
            # a fixed order of summation: the score is the same whatever else the task holds
            scores = np.einsum("ij,j->i", x[rows], q[r])
            best = _best(ids[rows], scores, k)
            out.append(record_batch(_HITS, np.full(len(best), query), uid[rows[best]], ids[rows[best]], scores[best]))
        return pa.Table.from_batches(out, schema=_HITS)
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int = 64, recall: float = 0.96,
            vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The ``k`` vectors of largest inner product found for every query.

    ``queries`` holds vec_ids (column ``vec_id``); their vectors are those of
    the table, and the query's own row is no candidate.  Returns query_id, rank
    (from 1), vec_id, score (the exact inner product in double precision),
    nearest first, ties to the smaller vec_id; all candidates if there are
    fewer than ``k``.  ``recall`` is the share of true neighbours aimed at on
    the probe queries.  Vectors that are null, empty, zero, of another length
    than most, or hold null or non-finite components, and rows without vec_id,
    take no part.  Rows with equal vec_ids are vectors of their own (as queries
    they are answered once each).  Other columns are ignored.
    """
    spark = vectors.sparkSession
    s = Scratch(spark, "multi-index")
    base = s.write(only(vectors, vec_id=vec_id, v=embedding).where("vec_id is not null")
                   .withColumn("uid", F.monotonically_increasing_id()), "base")
    good = s.write(usable(base, "uid", "v").withColumnRenamed("vec_id", "uid").join(base.select("uid", "vec_id"), "uid"), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, greatest = good.agg(F.count(F.lit(1)), F.max(norm)).first()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    asked = good.join(only(queries, vec_id="vec_id").distinct(), "vec_id", "left_semi")

    sample = good.orderBy(F.xxhash64("uid"), "uid").limit(SAMPLE).select("v").toArrow()
    scale = float(greatest) if math.isfinite(greatest) and greatest > 0 else 1.0
    h1, h2 = halves(matrix(sample.column("v").combine_chunks()) / scale, 1.0)
    index = spark.sparkContext.broadcast((codebook(h1, centroids), codebook(h2, centroids), 1.0, scale))
    entries = s.write(good.select("vec_id", "uid", "v").mapInArrow(_entries(index), arrow_ddl(_ENTRIES)), "entries")
    held = np.zeros([len(c) for c in index.value[:2]], np.int64)
    for r in entries.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():
        held[r["i"], r["j"]] = r["n"]
    blocks = -(-held.sum(1) // BLOCK)
    cells = spark.sparkContext.broadcast(held.tolist())

    enough = max(_enough(spark, entries, asked, index, held, n, k, recall), k + 1)  # k candidates and the query itself
    n_blocks = spark.sparkContext.broadcast(blocks)
    visits = asked.select("uid", "v").mapInArrow(_visits(index, cells, n_blocks, enough), arrow_ddl(_VISITS))
    count = F.element_at(F.lit(np.maximum(blocks, 1).tolist()), F.col("i") + 1)
    dealt = entries.withColumn("block", F.pmod(F.xxhash64("uid"), count).cast("int"))
    hits = (dealt.groupBy("i", "block").cogroup(visits.groupBy("i", "block"))
            .applyInArrow(_reranked(k), arrow_ddl(_HITS)))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = base.select(F.col("uid").alias("query"), F.col("vec_id").alias("query_id"))
    return ranked.join(names, "query").select("query_id", "rank", "vec_id", "score")


def _enough(spark, entries, asked, index, held, n: int, k: int, recall: float) -> float:
    """Vectors to visit so that the probe queries reach the recall."""
    probes = asked.orderBy(F.xxhash64("uid", F.lit(1)), "uid").limit(PROBES).select("uid", "v").toArrow()
    if not len(probes):
        return 0
    uid, q = probes.column("uid").to_numpy(), matrix(probes.column("v").combine_chunks())
    schema = "probe long, score double, i int, j int, uid long"
    true = entries.mapInArrow(_exact(spark.sparkContext.broadcast((uid, q)), k), schema)
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "uid")
    true = true.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("probe", "i", "j").collect()
    c1, c2, _, scale = index.value
    h1, h2 = halves(q / scale, None)
    d = (_distances(h1, c1)[:, :, None] + _distances(h2, c2)[:, None, :]).reshape(len(q), -1)
    order = np.argsort(d, 1, kind="stable")
    upto = held.ravel()[order].cumsum(1)  # held by the cells up to each
    before = np.empty_like(upto)
    np.put_along_axis(before, order, upto, 1)
    row = {u: r for r, u in enumerate(uid.tolist())}
    needs = np.sort([before[row[t["probe"]], t["i"] * len(c2) + t["j"]] for t in true])
    return float(needs[min(len(needs) - 1, math.ceil(recall * len(needs)) - 1)]) if len(needs) else 0


def op3_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every vector whose id is divisible by 20, among all ``embeddings``."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"), k=20)


QUERIES = {"op3_multi_index_neighbours": op3_multi_index_neighbours}
