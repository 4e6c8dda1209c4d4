"""Block products, the randomised SVD, word vectors, topic models and paragraph vectors against dense or brute-force answers."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from revlens.operators import blocks as BL
from revlens.operators import topics as TP
from revlens.operators import vectors as VE


def sparse(rng, n, m, share=0.25):
    return (rng.random((n, m)) < share) * rng.integers(1, 6, (n, m)).astype(float)


def entries(spark, a):
    return spark.createDataFrame([(int(i), int(j), float(a[i, j])) for i, j in zip(*np.nonzero(a))], "row long, col long, x double")


def table(spark, rows):
    return spark.createDataFrame([(i, np.asarray(r, float).tobytes()) for i, r in enumerate(rows)], BL.VECTORS)


def dense(df, n):
    rows = (BL.as_arrays(df) if dict(df.dtypes)["vec"] == "binary" else df).collect()
    out = np.zeros((n, len(rows[0]["vec"])))
    assert len({r["key"] for r in rows}) == len(rows)
    for r in rows:
        out[r["key"]] = r["vec"]
    return out


@pytest.mark.parametrize("piece, held", [(1 << 16, 1 << 27), (3, 1 << 27), (1 << 16, 0), (3, 0)])
def test_products_by_blocks_equal_dense_ones(spark, monkeypatch, piece, held):
    monkeypatch.setattr(BL, "BROADCAST", held)
    rng = np.random.default_rng(1)
    a, f = sparse(rng, 40, 25), rng.normal(size=(25, 4))
    blocks = BL.Blocks(entries(spark, a), whole=piece > 25, per_block=60, piece=piece)
    assert blocks.n_blocks > 2 and blocks.whole == (piece > 25)
    assert np.allclose(dense(blocks.times(table(spark, f), 4), 40), a @ f)
    assert np.allclose(dense(blocks.gram_times(table(spark, f), 4), 25), a.T @ a @ f)


def test_orthonormal_basis_of_a_tall_table(spark, monkeypatch):
    monkeypatch.setattr(BL, "FAN", 2)  # factors are joined in several steps
    x = np.random.default_rng(2).normal(size=(200, 6))
    x[:, 5] = x[:, 0] - 2 * x[:, 1]  # rank 5
    basis, s = BL.orthonormal(table(spark, x).repartition(9))
    q = dense(basis, 200)
    assert q.shape == (200, 5) and np.allclose(q.T @ q, np.eye(5)) and np.allclose(q @ (q.T @ x), x)
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False), atol=1e-9)


def test_sums_of_parts_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        parts = table(spark, [(i, 1.0) for i in range(300)]).withColumn("key", F.col("key") % 4)
        want = {k: [float(sum(range(k, 300, 4))), 75.0] for k in range(4)}
        for blocks in (1, BL.TWO_STEPS + 1):
            assert {r["key"]: r["vec"] for r in BL.as_arrays(BL.summed(parts, blocks)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lsa_equals_the_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    a = sparse(rng, 50, 30)
    a[7] = 0  # a document without terms
    bow = spark.createDataFrame([(int(i), f"t{j:02d}", int(a[i, j])) for i, j in zip(*np.nonzero(a))], "doc_id long, term string, n long")
    weights, positions, values = TP.lsa(bow, 4, spare=40)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    sign = np.sign((vt[:4] ** 3).sum(1))
    w, p = np.zeros((30, 4)), np.zeros((50, 4))
    for r in weights.collect():
        w[int(r["term"][1:]), r["topic"]] = r["weight"]
    for r in positions.collect():
        p[r["doc_id"], r["topic"]] = r["value"]
    assert np.allclose(values, s[:4], rtol=1e-9)
    assert np.abs(w - vt[:4].T * sign).max() < 1e-6 and np.abs(p - u[:, :4] * s[:4] * sign).max() < 1e-6


def test_subspace_iteration_converges_without_full_rank(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 40)) @ np.diag(0.7 ** np.arange(40)) @ rng.normal(size=(40, 40))
    d = BL.decompose(BL.Blocks(entries(spark, a)), BL.random_vectors(spark.range(40).select(F.col("id").alias("key"), F.xxhash64("id").alias("hash")), 8), 3)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert 1 < d.rounds < 60 and np.allclose(d.values, s[:3], rtol=1e-8)
    assert np.abs(np.abs(dense(d.rows, 60)) - np.abs(u[:, :3] * s[:3])).max() < 1e-4 * s[0]


# --- word vectors -------------------------------------------------------------------------

def pair_counts(docs, window):
    out = Counter()
    for _, tokens in docs:
        for i, w in enumerate(tokens):
            for j in range(max(0, i - window), min(len(tokens), i + window + 1)):
                if i != j:
                    out[w, tokens[j]] += 1
    return out


def some_docs(n=40, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choices("abcdefghij", k=rng.randint(0, 12))) for i in range(n)] + [(n, ["alone"]), (n + 1, [])]


def test_cooccurrence_and_pmi_equal_brute_force(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    counts = VE.cooccurrence(df, 3)
    want = pair_counts(docs, 3)
    assert {(r["word"], r["context"]): r["n"] for r in counts.collect()} == dict(want)
    total, margin = sum(want.values()), Counter()
    for (w, _), n in want.items():
        margin[w] += n
    for shift in (1.0, 1.2):
        pmi = {k: math.log(n * total / (margin[k[0]] * margin[k[1]])) - math.log(shift) for k, n in want.items()}
        got = {(r["word"], r["context"]): r["pmi"] for r in VE.shifted_pmi(counts, shift).collect()}
        assert got == pytest.approx({k: v for k, v in pmi.items() if v > 0})


def test_word_vectors_leave_the_least_residual(spark):
    docs = some_docs()
    df = spark.createDataFrame(docs, "doc_id long, tokens array<string>")
    got = {r["word"]: np.array(r["vector"]) for r in VE.word_vectors(df, size=4, rounds=60, spare=10).collect()}
    words = sorted(got)
    m = np.zeros((len(words), len(words)))
    for r in VE.shifted_pmi(VE.cooccurrence(df, 3)).collect():
        m[words.index(r["word"]), words.index(r["context"])] = r["pmi"]
    x = np.array([got[w] for w in words])
    u, s, vt = np.linalg.svd(m)
    assert np.allclose((x * x).sum(0), s[:4])  # columns of U sqrt(S) have the singular values as squared lengths
    q = x / np.sqrt(s[:4])
    assert np.linalg.norm(m - q @ (q.T @ m)) == pytest.approx(np.sqrt((s[4:] ** 2).sum()))
    assert not got["alone"].any()


def test_sorted_and_sliced_words_keep_whole_vectors(spark, monkeypatch):
    from revlens.plans import catalog_vec
    words = {w: [float(i), -1.0, 0.5 * i] for i, w in enumerate("dbeac")}
    table = spark.createDataFrame(list(words.items()), "word string, vector array<double>")
    monkeypatch.setattr(catalog_vec, "_word_vectors", lambda *_: table)
    rows = [(r["word"], r["vector"], r["x0"]) for r in catalog_vec.sort_words(spark, "").collect()]
    assert rows == [(w, words[w], words[w][0]) for w in sorted(words)]
    assert [(r["word"], r["vector"]) for r in catalog_vec.slice_rows(spark, "").collect()] == [(w, words[w]) for w in "bcde"]


def test_the_table_of_word_vectors_keeps_floats(spark, monkeypatch):
    from revlens.plans import catalog_vec
    kept = {}

    def fitted(spark, d, name, build):
        kept[name] = build()
        return kept[name]
    monkeypatch.setattr(catalog_vec, "_clean_tokens", lambda *_: spark.createDataFrame(some_docs(), "doc_id long, tokens array<string>"))
    monkeypatch.setattr(catalog_vec.C, "fitted", fitted)
    got = catalog_vec._word_vectors(spark, "")
    assert dict(kept["word_vectors"].dtypes)["vector"] == "array<float>" and dict(got.dtypes)["vector"] == "array<double>"
    assert got.count() == 11 and all(len(r["vector"]) == 200 for r in got.collect())


# --- topics -----------------------------------------------------------------------------

def test_gamma_functions():
    x = np.array([1e-4, 0.1, 0.5, 1.0, 2.0, 3.5, 10.0, 1e4])
    assert np.allclose(TP.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-10)
    h = 1e-6 * x
    assert np.allclose(TP.digamma(x), [(math.lgamma(v + e) - math.lgamma(v - e)) / (2 * e) for v, e in zip(x, h)], rtol=1e-4, atol=1e-4)
    assert TP.digamma(np.array(1.0)) == pytest.approx(-0.5772156649015329)
    assert TP.trigamma(np.array([1.0, 0.5])) == pytest.approx([math.pi ** 2 / 6, math.pi ** 2 / 2])
    assert np.allclose(TP.inverse_digamma(TP.digamma(x)), x, rtol=1e-8)


def two_themes(spark, n=60):
    rng = random.Random(6)
    rows = []
    for d in range(n):
        for w, c in Counter(rng.choices(["sea", "ship", "wind", "sail"] if d % 2 else ["stove", "salt", "soup", "spoon"], k=12)).items():
            rows.append((d, w, c))
    return spark.createDataFrame(rows, "doc_id long, term string, n long")


def test_lda_bound_never_falls_and_topics_are_found(spark):
    model = TP.lda(two_themes(spark), 2, passes=8, tol=0.0)
    assert len(model.bounds) > 2 and all(b >= a - 1e-7 * abs(a) for a, b in zip(model.bounds, model.bounds[1:]))
    docs = spark.range(61).select(F.col("id").alias("doc_id"))
    mix = {r["doc_id"]: r["mixture"] for r in TP.topic_mixtures(model, docs).collect()}
    assert all(sum(mix[d]) == pytest.approx(1, abs=0.02) for d in range(60))
    assert len({int(np.argmax(mix[d])) for d in range(0, 60, 2)}) == len({int(np.argmax(mix[d])) for d in range(1, 60, 2)}) == 1
    assert np.argmax(mix[0]) != np.argmax(mix[1])
    assert mix[60] == pytest.approx(list(model.prior / model.prior.sum()))  # a document without terms
    top = {}
    for r in TP.lda_topic_terms(model, 4).collect():
        top.setdefault(r["topic"], set()).add(r["term"])
    assert sorted(map(sorted, top.values())) == [["sail", "sea", "ship", "wind"], ["salt", "soup", "spoon", "stove"]]


def test_lda_bound_equals_a_plain_evaluation(spark):
    """The bound after one pass, from the formulas word by word."""
    bow = two_themes(spark, 6)
    k = 2
    model = TP.lda(bow, k, passes=1)
    rows = bow.collect()
    # what the pass started from
    start = TP.lda(bow, k, passes=0)
    # numbers differ between the two vocabularies, terms do not
    lam = {r["term"]: np.array(r["vec"]) for r in BL.as_arrays(start.terms).join(start.vocab, F.col("key") == F.col("id")).collect()}
    gamma = {r["key"]: np.array(r["vec"]) for r in BL.as_arrays(model.documents).collect()}
    totals = sum(v[:k] for v in lam.values())
    beta = {t: TP.digamma(v[:k]) - TP.digamma(totals) for t, v in lam.items()}
    theta = {d: TP.digamma(g) - TP.digamma(g.sum()) for d, g in gamma.items()}
    prior = np.full(k, 1 / k)
    lg = np.vectorize(math.lgamma)
    bound = sum(r["n"] * math.log(np.exp(theta[r["doc_id"]] + beta[r["term"]]).sum()) for r in rows)
    for d, g in gamma.items():
        bound += ((prior - g) * theta[d] + lg(g) - lg(prior)).sum() + lg(prior.sum()) - lg(g.sum())
    eta = np.array([v[k] for v in lam.values()])
    for t in range(k):
        for v, (term, b) in zip(lam.values(), beta.items()):
            bound += (v[k] - v[t]) * b[t] + math.lgamma(v[t]) - math.lgamma(v[k])
        bound += math.lgamma(eta.sum()) - math.lgamma(totals[t])
    assert model.bounds[0] == pytest.approx(bound, rel=1e-9)


# --- paragraph vectors -------------------------------------------------------------------

def block_of(a):
    packed = pa.table({"row": [i for i in range(len(a))], "cols": pa.array([np.flatnonzero(r) for r in a], pa.list_(pa.int64())),
                       "xs": pa.array([r[r > 0] for r in a], pa.list_(pa.float64()))})
    return BL.Block.of(packed)


def test_paragraph_gradients_are_the_slopes_of_the_objective():
    rng = np.random.default_rng(7)
    a = sparse(rng, 5, 9, 0.6)
    a[:, 0] = 1
    a[0] = 1
    block = block_of(a)
    docs, words, noise = rng.normal(size=(5, 3)), rng.normal(size=(9, 3)), np.array([1, 4, 8])
    _, by_docs, by_words = VE.paragraph_gradients(block, docs, words, noise)
    for x, slope in ((docs, by_docs), (words, by_words)):
        for at in np.ndindex(x.shape):
            keep = x[at]
            x[at] = keep + 1e-6
            up = VE.paragraph_gradients(block, docs, words, noise)[0]
            x[at] = keep - 1e-6
            down = VE.paragraph_gradients(block, docs, words, noise)[0]
            x[at] = keep
            assert slope[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def test_near_copies_and_held_out_documents_are_nearest_neighbours(spark):
    rng = random.Random(8)
    themes = [[f"{t}{i}" for i in range(12)] for t in "abcd"]
    docs = [(d, rng.choices(themes[d % 4], k=30)) for d in range(80)]
    docs += [(100 + d, docs[d][1][:-1] + ["other"]) for d in range(8)]  # near copies, held out
    docs += [(200, ["never", "seen"]), (201, docs[0][1])]
    bow = spark.createDataFrame([(d, w, n) for d, ws in docs for w, n in Counter(ws).items()], "doc_id long, term string, n long")
    model = VE.fit_paragraph_vectors(bow.where("doc_id < 80"), size=16, passes=4)
    got = {r["doc_id"]: np.array(r["vector"]) for r in VE.infer_paragraph_vectors(model, bow).collect()}
    assert 200 not in got and np.allclose(got[201], got[0])
    unit = {d: v / np.linalg.norm(v) for d, v in got.items()}
    for d in range(8):
        near = sorted((x for x in unit if x not in (100 + d, 201)), key=lambda x: -unit[100 + d] @ unit[x])
        assert near[0] == d
        assert all(x % 4 == d % 4 for x in near[:10])
    again = {r["doc_id"]: r["vector"] for r in VE.infer_paragraph_vectors(model, bow.repartition(3)).collect()}
    assert all(np.allclose(again[d], got[d]) for d in got)


def test_empty_tables(spark):
    bow = spark.createDataFrame([], "doc_id long, term string, n long")
    assert TP.lsa(bow, 2)[1].collect() == [] and len(TP.lsa(bow, 2)[2]) == 0
    assert TP.lda(bow, 2).documents.collect() == []
    assert VE.infer_paragraph_vectors(VE.fit_paragraph_vectors(bow), bow).collect() == []
    assert VE.word_vectors(spark.createDataFrame([], "doc_id long, tokens array<string>"), 4).collect() == []


def test_tables_of_many_words_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(BL, "BROADCAST_ROWS", 3)
    tokens = spark.createDataFrame(some_docs(), "doc_id long, tokens array<string>")
    pmi = VE.shifted_pmi(VE.cooccurrence(tokens, 3))
    want = sorted(tuple(r) for r in pmi.collect())
    assert "BroadcastHashJoin" not in pmi._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(BL, "BROADCAST_ROWS", 1 << 16)
    assert want == sorted(tuple(r) for r in VE.shifted_pmi(VE.cooccurrence(tokens, 3)).collect()) and want


def test_momentum_needs_fewer_rounds(spark):
    rng = np.random.default_rng(6)
    u, v = (np.linalg.qr(rng.normal(size=(60, 60)))[0] for _ in range(2))
    s = 0.97 ** np.arange(60)  # slow decay, few spare components
    a = (u * s) @ v
    starts = BL.random_vectors(spark.range(60).select(F.col("id").alias("key"), F.xxhash64("id").alias("hash")), 6)
    q, before, plain = np.linalg.qr(dense(BL.as_arrays(starts), 60))[0], np.zeros(3), 0
    while True:  # rounds without momentum
        plain += 1
        q, r = np.linalg.qr(a.T @ (a @ q))
        now = np.sqrt(np.linalg.svd(r)[1])[:3]
        if np.all(np.abs(now - before) <= 1e-9 * now):
            break
        before = now
    d = BL.decompose(BL.Blocks(entries(spark, a)), starts, 3, tol=1e-9)
    assert d.rounds <= plain * 2 / 3 and np.allclose(d.values, s[:3], rtol=1e-7)


# --- disk and time of the passes ---------------------------------------------------------

def tables_of(spark):
    """The names of the tables in the shared folder."""
    import os
    from revlens.session import scratch_path
    top = scratch_path(spark, "").removeprefix("file:")
    return set(os.listdir(top)) if os.path.isdir(top) else set()


def test_a_decomposition_leaves_no_table_of_its_rounds(spark):
    rng = np.random.default_rng(11)
    a = BL.Blocks(entries(spark, rng.normal(size=(60, 40)) @ np.diag(0.9 ** np.arange(40)) @ rng.normal(size=(40, 40))), n_cols=40)
    before = tables_of(spark)
    starts = BL.random_vectors(spark.range(40).select(F.col("id").alias("key"), F.xxhash64("id").alias("hash")), 8)
    d = BL.decompose(a, starts, 3)
    left = sorted(f.rsplit("-", 1)[0] for f in tables_of(spark) - before)
    assert d.rounds > 3 and left == ["cols", "projected"]
    assert d.rows.count() == 60 and d.cols.count() == 40  # which the results read


def test_topic_and_paragraph_models_leave_no_table_of_old_passes(spark):
    bow = two_themes(spark)
    before = tables_of(spark)
    assert len(TP.lda(bow, 2, passes=6, tol=0.0).bounds) == 6
    left = [f.rsplit("-", 1)[0] for f in tables_of(spark) - before]
    assert sorted(left) == ["lda_pass", "topics", "vocabulary"]
    before = tables_of(spark)
    VE.fit_paragraph_vectors(bow, size=8, passes=4)
    left = [f.rsplit("-", 1)[0] for f in tables_of(spark) - before]
    assert sorted(left) == ["paragraph_vectors", "paragraph_words"]


def test_a_fitted_model_leaves_its_table_alone(spark, tmp_path):
    from revlens.plans import common as C
    (tmp_path / "documents.parquet").write_text("")
    before = tables_of(spark)
    got = C.fitted(spark, str(tmp_path), "some_model", lambda: BL.written(spark.range(5).repartition(3), "step").where("id > 1"))
    left = tables_of(spark) - before
    assert got.count() == 3 and len(left) == 1 and left.pop().startswith("fit-")


def test_cooccurrence_leaves_the_cleaned_tokens_alone(spark):
    from tests.conftest import SF_SMALL
    from revlens.plans import QUERIES
    before = tables_of(spark)
    got = QUERIES["cooccurrence"](spark, SF_SMALL)
    left = [f.rsplit("-", 5)[0] for f in tables_of(spark) - before]
    assert left == ["clean_tokens"] and got.count() > 0  # no table that they were made from


def test_writing_a_table_frees_its_shuffle_files(spark):
    import glob
    import os
    import time
    top = spark.sparkContext._jsc.sc().getConf().get("spark.local.dir", "/tmp")
    data = lambda: {f for f in glob.glob(f"{top}/blockmgr-*/*/shuffle_*.data") if os.path.getsize(f)}
    before, kept = data(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    table = BL.written(spark.range(10_000).repartition(4, "id"), "dealt")
    for _ in range(50):  # files go in the background
        if not data() - before:
            break
        time.sleep(0.2)
    assert not data() - before and table.count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == kept


def test_small_passes_read_the_blocks_where_they_lie(spark, monkeypatch):
    rng = np.random.default_rng(12)
    a = sparse(rng, 40, 25)
    blocks = BL.Blocks(entries(spark, a), per_block=60)
    state = BL.written(blocks.needs("row").withColumn("vec", F.lit(bytearray(np.array([2.0, 3.0]).tobytes()))), "state")

    def work(number, block, factor, held):
        assert held.shape == (len(block.rows), 2) and (held == [2, 3]).all()
        yield from BL.batches(block.rows, block.times(factor))

    f = rng.normal(size=(25, 4))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    near = blocks.run(table(spark, f), 4, work, BL.VECTORS_ARROW, state=state, state_width=2)
    assert "Exchange" not in plan(near) and np.allclose(dense(near, 40), a @ f)
    monkeypatch.setattr(BL, "BROADCAST", 0)
    far = blocks.run(table(spark, f), 4, work, BL.VECTORS_ARROW, state=state, state_width=2)
    assert "FlatMapCoGroups" not in plan(far) and far.rdd.getNumPartitions() == blocks.n_blocks > 2
    assert np.allclose(dense(far, 40), a @ f)


def test_document_shares_by_slices_equal_those_of_all_at_once(monkeypatch):
    rng = np.random.default_rng(13)
    block = block_of(np.c_[np.ones(30), sparse(rng, 30, 20)])
    weights, prior = rng.gamma(1, 1, (21, 3)), np.array([0.1, 0.5, 1.0])
    start = prior + rng.gamma(1, 2, (30, 3))

    def plain(gamma):  # one document at a time, word by word
        for i in range(30):
            for _ in range(20):
                theta, old = np.exp(TP.digamma(gamma[i]) - TP.digamma(gamma[i].sum())), gamma[i].copy()
                gamma[i] = prior + sum(x * theta * weights[c] / (theta @ weights[c]) for r, c, x in zip(block.row, block.col, block.x) if r == i)
                if np.abs(gamma[i] - old).mean() < TP.SETTLED:
                    break
        return gamma

    want = plain(start.copy())
    for size in (1, 7, 1 << 14):
        monkeypatch.setattr(TP, "SHARE_ENTRIES", size)
        assert np.allclose(TP.document_shares(block, weights, prior, start), want)


def test_floats_travel_where_they_are_asked_for(spark):
    rng = np.random.default_rng(14)
    a, f = sparse(rng, 40, 25), rng.normal(size=(25, 4)).astype(np.float32)
    blocks = BL.Blocks(entries(spark, a), per_block=60, real=np.float32)
    floats = spark.createDataFrame([(i, r.tobytes()) for i, r in enumerate(f)], BL.VECTORS)
    got = {r["key"]: r["vec"] for r in blocks.times(floats, 4).collect()}
    assert all(len(v) == 16 for v in got.values())
    assert np.allclose([np.frombuffer(got[i], np.float32) for i in sorted(got)], (a @ f)[sorted(got)], atol=1e-5)
