import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.llm import lm_scoring as M
from revlens.llm import words as W

from .brute import WORD, lower

SCHEMA = "doc_id long, text string, held boolean"


def base_scores(docs):
    """{doc_id: (tokens, known, N, base score)} counted one by one."""
    toks = {d: WORD.findall(lower(t)) + [None] for d, t, _ in docs}
    c = Counter(w for d, _, h in docs if not h for w in toks[d])
    n, v = sum(c.values()), len(c)
    return {d: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in t)) for d, t in toks.items()}


def sentences(seed, n=300):
    """Words follow each other in a fixed order, with rare words between."""
    r = random.Random(seed)
    chain = {f"w{i}": [f"w{(i * 7 + k) % 40}" for k in (1, 2)] for i in range(40)}
    out = []
    for i in range(n):
        w, t = "w0", []
        for _ in range(r.randrange(5, 60)):
            t.append(w if r.random() > .1 else f"r{r.randrange(400)}ed")
            w = r.choice(chain[w])
        out.append((i, " ".join(t), i % 5 == 1))
    return out


@pytest.mark.parametrize("frequent", [3, 1 << 18])
def test_counts_and_base_equal_brute_force(rows, monkeypatch, frequent):
    monkeypatch.setattr(M, "FREQUENT", max(frequent, 3))
    docs = sentences(1) + [(900, None, False), (901, "", True), (902, " The THE the ", False), (903, "zz " * 3000, True)]
    df = rows(SCHEMA + ", uid int, h int, c int", [(*d, 1, 1, 1) for d in docs])
    out = {r.doc_id: r for r in M.score_documents(df, F.col("held")).collect()}
    for d, (n, known, total, base) in base_scores(docs).items():
        r = out[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isfinite(r.score) and r.score < 0


def test_context_helps_on_held_out_text(rows):
    out = M.score_documents(rows(SCHEMA, sentences(2, 1500)), F.col("held")).where("held_out").collect()
    assert sum(r.score for r in out) > sum(r.base_score for r in out) * .8


def test_probabilities_add_up_to_one(rows, spark, monkeypatch):
    """Scored one by one, all known words, the end and one unseen word after a context have probability 1."""
    monkeypatch.setattr(M, "SHORTLIST", M.SHORTLIST)
    docs = sentences(3, 200)
    words = sorted({w for _, t, _ in docs for w in t.split()})
    context = "w1 w2"
    probes = [(10_000 + i, f"{context} {w}", True) for i, w in enumerate([*words, "neverseen"])] + [(9_999, context, True)]
    df = rows(SCHEMA, [(d, t, False) for d, t, _ in docs] + probes)
    score = {r.doc_id: r.score for r in M.score_documents(df, F.col("held")).collect()}
    # p(context, w, end) = p(context) p(w | context) p(end | context, w): the last factor depends on w, so
    # compare through the model's own tables instead of the texts' totals
    v = grabbed(df)
    a, b, z = v[1]
    c1, c2 = 5, 9
    p = np.exp(a[c1] + b[c2] - z[c1, c2])
    assert math.isclose(p.sum(), 1, rel_tol=1e-9)
    assert all(s < 0 for s in score.values())
    total = v[0].class_total[v[0].class_total > 0]
    assert math.isclose(total.sum(), sum(c + .5 for c in v[2]), rel_tol=1e-9)


def grabbed(df):
    """(vocabulary, model tables, counts of the words outside the shortlist) of a run's training half."""
    got = {}
    plain = M._scored
    try:
        def spy(vocabulary, model):
            got["v"], got["m"] = vocabulary.value, model.value
            return plain(vocabulary, model)
        M._scored = spy
        M.score_documents(df, F.col("held")).count()
    finally:
        M._scored = plain
    c = Counter(w for t, in df.where("not held").select("text").collect() for w in t.split())
    hashes = dict(zip(c, W.split(pa.array([" ".join(c)]), lower=True).hash.tolist()))
    short = set(got["v"].short.tolist())
    return got["v"], got["m"], [n for w, n in c.items() if hashes[w] not in short]


def test_lookup():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000, dtype=np.uint64))
    keys[:50] = (keys[:50] & ~np.uint64(0xFFFFF)) | np.uint64(7)  # one slot for many
    keys = np.unique(keys)
    find = M.Lookup(keys, np.arange(len(keys)))
    assert (find(keys) == np.arange(len(keys))).all() and (find(keys + np.uint64(1 << 62)) == -1).mean() > .99
    assert (M.Lookup(keys[:0], np.zeros(0, int))(keys) == -1).all()


def test_edge_tables(rows):
    assert M.score_documents(rows(SCHEMA, []), F.col("held")).collect() == []
    out = M.score_documents(rows(SCHEMA, [(1, "a b", True), (1, "a b", True), (None, None, None)]), F.col("held")).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out) == [(0, False, 1, 1, 1), (1, True, 3, 1, 1), (1, True, 3, 1, 1)]
    none = M.score_documents(rows(SCHEMA, [(1, "a b", True)]), F.col("held")).collect()[0]
    assert (none.n_known, none.train_tokens) == (0, 0) and math.isclose(none.base_score, 3 * math.log10(.5 / .5))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(d, t, zlib.crc32(str(d).encode()) % 5 == 1) for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = base_scores(docs)
    out = M.op7_lm_scoring(spark, sf).collect()
    for r in out:
        n, known, total, base = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total) and math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in out if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _, h in docs if h}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
