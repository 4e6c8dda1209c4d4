import math

import duckdb
import numpy as np
import pytest

from revlens.llm import embedding_dedup as E

from .brute import roots


def want(ids, x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= threshold
    np.fill_diagonal(s, False)
    up = roots(range(len(ids)), [(int(i), int(j)) for i, j in zip(*np.nonzero(s)) if i < j])
    least = {}
    for i, r in up.items():
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {ids[i]: (int(s[i].sum()), least[up[i]], ids[i] == least[up[i]]) for i in range(len(ids))}


def got(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("block,dim", [(40, 6), (8192, 16)])
def test_equals_brute_force(rows, block, dim):
    r = np.random.default_rng(dim)
    base = r.normal(size=(60, dim))
    x = np.concatenate([base, base[r.integers(0, 60, 200)] * r.uniform(.1, 9, (200, 1)) + r.normal(size=(200, dim)) * .25])
    ids = r.permutation(1000)[:260].tolist()
    df = rows("vec_id long, embedding array<double>, uid int, v int", [(i, v.tolist(), 1, 1) for i, v in zip(ids, x)])
    assert got(E.near_duplicates(df, .9, block=block)) == want(ids, x, .9)


def test_bounds_hold():
    r = np.random.default_rng(2)
    u = r.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    codes, scale, error = E.quantised(u)
    near = (codes * scale[:, None]) @ (codes * scale[:, None]).T
    bound = error[:, None] + (1 + error[:, None]) * error[None]
    assert (np.abs(near - u @ u.T) <= bound + 1e-12).all() and bound.max() < .03


def test_edge_rows(rows):
    nan, inf = math.nan, math.inf
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]),
            (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 1e-3]), (10, [1e-300, 0.0]), (11, [-1.0, 0.0])]
    out = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(rows("vec_id long, embedding array<double>", data)).collect())
    assert out == sorted([(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (0, 4, 1, False), (10, 4, 1, False), (11, 0, 11, True)]
                         + [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)])
    assert E.near_duplicates(rows("vec_id long, embedding array<double>", [])).collect() == []
    assert got(E.near_duplicates(rows("vec_id long, embedding array<float>", [(1, None)]))) == {1: (0, 1, True)}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    expect = {r[0]: r[1:] for r in con.execute(E.ORACLE_SQL["op10_embedding_near_dedup"]).fetchall()}
    assert got(E.op10_embedding_near_dedup(spark, sf)) == expect
