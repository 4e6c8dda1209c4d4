import math

import numpy as np
import pytest

from revlens.llm import multi_index as M


def want(ids, x, k, query):
    s = x @ x.T
    out = {}
    for r in np.flatnonzero([query(i) for i in ids]):
        order = [c for c in np.lexsort((ids, -s[r])) if c != r][:k]
        out[int(ids[r])] = [(int(ids[c]), float(s[r, c])) for c in order]
    return out


def got(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(found, true):
    return np.mean([len({i for i, _ in found.get(q, [])} & {i for i, _ in t}) / max(1, len(t)) for q, t in true.items()])


@pytest.mark.parametrize("lengths", [False, True])
def test_recall_and_scores(rows, lengths):
    r = np.random.default_rng(1)
    x = r.normal(size=(20, 16))[r.integers(0, 20, 1500)] + r.normal(size=(1500, 16)) * .7
    x = x * r.uniform(.2, 5, (1500, 1)) if lengths else x / np.linalg.norm(x, axis=1, keepdims=True)
    ids = r.permutation(5000)[:1500]
    df = rows("vec_id long, embedding array<double>, i int, j int, uid int", [(int(i), v.tolist(), 1, 1, 1) for i, v in zip(ids, x)])
    found = got(M.nearest(df, df.where("vec_id % 20 = 0"), k=10, centroids=16))
    true = want(ids, x, 10, lambda i: i % 20 == 0)
    assert set(found) == set(true) and recall(found, true) >= .9
    at = {int(i): v for i, v in zip(ids, x)}
    for q, t in found.items():
        assert len(t) == 10 and q not in {i for i, _ in t}
        assert all(math.isclose(s, at[q] @ at[i], rel_tol=1e-12, abs_tol=1e-12) for i, s in t)
        assert t == sorted(t, key=lambda e: (-e[1], e[0]))


def test_walk_is_by_summed_distance():
    r = np.random.default_rng(0)
    d1, d2 = r.random(7), r.random(5)
    held = r.integers(0, 4, (7, 5))
    cells = M.walk(d1, d2, held.tolist(), 10**9)
    sums = [d1[i] + d2[j] for i, j in cells]
    assert len(set(cells)) == 35 and sums == sorted(sums)
    some = M.walk(d1, d2, held.tolist(), 20)
    assert some == cells[:len(some)] and sum(held[c] for c in some) >= 20 > sum(held[c] for c in some[:-1])


def test_edge_rows(rows):
    schema = "vec_id long, embedding array<double>"
    data = [(0, [1.0, 0.0]), (20, None), (40, [0.0, 0.0]), (1, [1.0, math.nan]), (2, [None, 1.0]), (3, [2.0, 1.0]), (4, [2.0, 1.0]),
            (None, [9.0, 9.0]), (5, [-1.0, 0.0]), (6, [1.0, 2.0, 3.0]), (60, [0.0, 1.0])]
    df = rows(schema, data)
    assert got(M.nearest(df, df.where("vec_id % 20 = 0"))) == {0: [(3, 2.0), (4, 2.0), (60, 0.0), (5, -1.0)],
                                                              60: [(3, 1.0), (4, 1.0), (0, 0.0), (5, 0.0)]}
    assert M.nearest(rows(schema, []), rows("vec_id long", [])).collect() == []
    assert M.nearest(df, rows("vec_id long", [])).collect() == []
    same = rows(schema, [(20, [1.0, 0.0]), (20, [1.0, 0.0])])
    assert [tuple(r) for r in M.nearest(same, same).collect()] == [(20, 1, 20, 1.0)] * 2


def test_query_recall(spark):
    sf = "/root/testdata/sf0.1"
    t = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x = np.stack(t.embedding).astype(np.float64)
    true = want(t.vec_id.to_numpy(), x, 20, lambda i: i % 20 == 0)
    found = got(M.op3_multi_index_neighbours(spark, sf))
    assert set(found) == set(true) and recall(found, true) >= .9 and all(len(f) == 20 for f in found.values())
