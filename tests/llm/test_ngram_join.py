import random

import numpy as np
import pytest

from revlens.llm import ngram_join as J
from revlens.llm import words as W

from .brute import jaccard_components

SCHEMA = "doc_id long, text string"


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed, n_base=12, copies=14, vocabulary=400):
    """Groups of texts around one base, at distances on both sides of the threshold,
    with a passage that all of them share."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    common = [r.choice(vocab) for _ in range(12)]
    out, i = [], 0
    for _ in range(n_base):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 15, 40, 120, 400]))] + common * r.choice([0, 1, 1])
        for _ in range(r.randrange(1, copies)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                at = r.randrange(len(t))
                if r.random() < .5:
                    t[at] = r.choice(vocab)
                else:
                    t.insert(at, r.choice(vocab))
            out.append((i, " ".join(t)))
            i += 1
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,k,num,den,frequent", [(1, 4, 85, 100, 2), (2, 5, 4, 5, 16)])
def test_equals_brute_force(rows, monkeypatch, seed, k, num, den, frequent):
    monkeypatch.setattr(J, "LARGE_GROUP", 5)
    monkeypatch.setattr(J, "GROUP_BLOCK", 3)
    monkeypatch.setattr(J, "FREQUENT", frequent)  # 2: nearly all shared tokens are indexed as combinations
    docs = near_copies(seed)
    assert got(J.jaccard_components(rows(SCHEMA, docs), k, num, den)) == jaccard_components(docs, k, num, den)


def test_edge_rows(rows):
    docs = [(1, None), (2, ""), (3, " \t\n"), (4, "a b"), (5, "A  B"), (6, "a b c"), (7, "x y z w v u"), (8, "x y z w v u")]
    df = rows("doc_id long, text string, n long, sig long", [(*d, 0, 0) for d in docs])
    assert got(J.jaccard_components(df)) == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (2, 7), 8: (2, 7)}
    assert J.jaccard_components(rows(SCHEMA, [])).collect() == []
    again = J.jaccard_components(rows(SCHEMA, [(9, "a b"), (9, "a b"), (None, "a b"), (None, "c"), (9, "q r s")]))
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in again.collect()) == [(-1, -1), (-1, 9), (9, 9), (9, 9), (9, 9)]


def test_query_equals_brute_force(spark):
    from revlens.llm.ngram_join import op2_ngram_jaccard_join as op
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op(spark, sf)) == jaccard_components(docs, 4, 85, 100)


def test_signatures_meet_for_every_link(spark):
    """Whatever tokens are called frequent, linked sets share a signature."""
    import pyarrow as pa
    docs = near_copies(5, n_base=8)
    texts = [t for _, t in docs]
    want = {}
    for d, (n, c) in jaccard_components(docs, 4, 85, 100).items():
        want.setdefault(c, []).append(d)
    values, offsets = W.shingle_sets(W.split(pa.array(texts), True), 4)
    for share in (0, .5, 1):
        heavy = np.unique(values)
        heavy = heavy[np.random.default_rng(1).random(len(heavy)) < share]

        class Fixed:
            value = heavy
        out = list(J._signatures(4, 85, 100, Fixed)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])))
        sigs = {}
        for b in out:
            for s, n in zip(b.column("sig").to_pylist(), b.column("node").to_pylist()):
                sigs.setdefault(n, set()).add(s)
        nodes = J.node_hash(values, offsets).view(np.int64).tolist()
        sets = [set(values[offsets[i]:offsets[i + 1]].tolist()) for i in range(len(docs))]
        for i in range(len(docs)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                    assert sigs[nodes[i]] & sigs[nodes[j]], (share, texts[i], texts[j])


def test_digests_bound_the_intersection():
    r = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 50, 500, 5000):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        for drop in (0, 1, n // 10, n // 2):
            y = np.concatenate([x[drop:], r.integers(0, 2**63, r.integers(0, n // 4 + 1), dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            assert J.most_shared(J.digest(x), J.digest(y)) >= both
            assert J.most_shared(J.digest(y), J.digest(x)) <= min(len(x), len(y))
    assert J.most_shared(None, J.digest(x)) is None


def test_sets_that_share_many_signatures_are_proposed_once():
    """A group of near copies has many common signatures; its pairs are rows once, not once a signature."""
    import pyarrow as pa
    n, sigs = 40, list(range(-300, 300, 20))
    r = np.random.default_rng(4)
    sets = [r.integers(0, 2**63, 50, dtype=np.uint64)] * n
    of = [sorted(r.choice(sigs, len(sigs) - 3, replace=False).tolist()) for _ in range(n)]
    rows, found = 0, set()
    for sig in sigs:
        at = [i for i in range(n) if sig in of[i]]
        group = pa.table({"sig": [sig] * len(at), "one": pa.array([0] * len(at), pa.int32()), "two": pa.array([0] * len(at), pa.int32()),
                          "block": pa.array([0] * len(at), pa.int32()), "node": at, "root": at, "n": [50] * len(at),
                          "digest": [J.digest(sets[i]) for i in at], "named": [of[i][:J.NAMED] for i in at]})
        for b in J._possible_in_groups(85, 100, None)(iter(group.to_batches())):
            rows += b.num_rows
            found |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    assert found == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert rows < 1.1 * len(found)


def test_sets_without_further_partners_leave_the_group():
    """After a round only sets of pairs that it did not propose go on; before, all of a large group did."""
    import pyarrow as pa
    r = np.random.default_rng(6)
    one, other = (r.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(2))
    sets = [one] * 4 + [other] * 2 + [r.integers(0, 2**63, 50, dtype=np.uint64) for _ in range(30)]
    n = len(sets)
    group = pa.table({"sig": [7] * n, "one": pa.array([0] * n, pa.int32()), "two": pa.array([0] * n, pa.int32()), "block": pa.array([0] * n, pa.int32()),
                      "node": range(n), "root": range(n), "n": [50] * n, "digest": [J.digest(x) for x in sets], "named": [[7]] * n})
    out = [row for b in J._possible_in_groups(85, 100, 1)(iter(group.to_batches())) for row in b.to_pylist()]
    pairs = {(x["a"], x["b"]) for x in out if x["b"] is not None}
    left = {x["a"] for x in out if x["b"] is None}
    assert (4, 5) in pairs and pairs <= {(i, j) for i in range(n) for j in range(i + 1, n)}
    missing = {(i, j) for i in range(4) for j in range(i + 1, 4)} - pairs
    assert missing and {i for p in missing for i in p} <= left <= {0, 1, 2, 3}
    assert {(x["sig"], x["n"]) for x in out if x["b"] is None} == {(7, 50)}


@pytest.mark.parametrize("rows_a_batch", [1, 3, 1000])
def test_pairs_of_small_groups(rows_a_batch):
    import pyarrow as pa
    r = random.Random(2)
    rows = sorted((sig, r.randrange(1000), r.choice([10, 11, 20]), r.randrange(3)) for sig in range(60) for _ in range(r.randrange(1, 6)))
    table = pa.table({c: pa.array([x[i] for x in rows], pa.int64()) for i, c in enumerate(("sig", "node", "n", "root"))})
    got = set()
    for b in J._in_few(85, 100, 6)(iter(table.to_batches(rows_a_batch))):
        got |= set(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows
            if x is not y and x[0] == y[0] and x[3] != y[3] and 100 * min(x[2], y[2]) >= 85 * max(x[2], y[2])}
    assert got == want
