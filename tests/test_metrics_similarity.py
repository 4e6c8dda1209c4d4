"""Metrics, histogram edges, block-pair similarity and silhouette vs brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.operators import metrics as M
from revlens.operators import similarity as SIM
from revlens.operators import tfidf as TF
from revlens.operators import vectors as VE


def test_confusion_matrix_fills_zeros(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "actual string, pred string")
    got = {r["actual"]: (r["a"], r["b"], r["c"]) for r in M.confusion_matrix(df, ["a", "b", "c"]).collect()}
    assert got == {"a": (1, 1, 0), "b": (0, 1, 0), "c": (0, 0, 0)}


def test_roc_running_sums_match_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [("m1" if i % 2 else "m2", float(rng.integers(0, 20)) / 20, int(rng.integers(0, 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "model string, score double, label int").repartition(7)
    pts = {(r["model"], r["score"]): (r["tpr"], r["fpr"]) for r in M.roc_points(df).collect()}
    for m in ("m1", "m2"):
        sub = [(s, l) for mm, s, l in rows if mm == m]
        P = sum(l for _, l in sub)
        N = len(sub) - P
        for s in {s for s, _ in sub}:
            tp = sum(l for ss, l in sub if ss >= s)
            fp = sum(1 - l for ss, l in sub if ss >= s)
            assert pts[(m, s)] == pytest.approx((tp / P, fp / N))
    auc = {r["model"]: r["auc"] for r in M.roc_auc(M.roc_points(df)).collect()}
    for m in ("m1", "m2"):
        sub = [(s, l) for mm, s, l in rows if mm == m]
        pos = [s for s, l in sub if l == 1]
        neg = [s for s, l in sub if l == 0]
        brute = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        assert auc[m] == pytest.approx(brute)


def test_running_sums_without_exchange_reuse(spark):
    keys = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false",
            "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.xxhash64("id").alias("o"), F.lit(1).alias("one"))
        out = M.running_sums(df, ["g"], [F.col("o")], ["one"]).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for g in (0, 1):
        assert [r["cum_one"] for r in sorted((r for r in out if r["g"] == g), key=lambda r: r["o"])] == list(range(1, 10_001))


def test_lookup_join_raises_on_a_missing_key(spark):
    from revlens.operators.relational import lookup_join
    dim = spark.createDataFrame([(1, "one")], "k int, title string")
    ok = lookup_join(spark.createDataFrame([(1,), (1,)], "k int"), dim, "k", ["title"])
    assert [r["title"] for r in ok.collect()] == ["one", "one"]
    missing = lookup_join(spark.createDataFrame([(1,), (2,)], "k int"), dim, "k", ["title"])
    for use in (lambda: missing.collect(), lambda: missing.select("k").collect()):
        with pytest.raises(Exception, match="missing k 2"):
            use()


def test_topic_models_keep_every_term_and_lda_shares_add_up(spark):
    from revlens.operators import topics as TP
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.transform(
        F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(F.lit("t"), (F.col("id") * 31 + i).cast("string"))).alias("tokens"))
    bow = df.select("doc_id", F.explode("tokens").alias("term")).withColumn("n", F.lit(1))
    lda = TP.lda(bow, 2, passes=2)
    assert lda.vocab.count() == lda.terms.count() == 40 * 31
    shares = TP.topic_mixtures(lda, df, min_share=0.0).collect()
    assert len(shares) == 40 and all(abs(sum(r["mixture"]) - 1) < 1e-6 for r in shares)
    tw, pos, sv = TP.lsa(bow, 3)
    top = pos.groupBy("topic").agg(F.sum(F.col("value") ** 2).alias("n")).orderBy("topic").collect()
    assert [r["n"] for r in top] == pytest.approx([x * x for x in sv])  # |U S| by topic are the singular values


def test_svm_separates_on_the_tfidf_features(spark):
    from revlens.operators import classify as CL
    rows = [(i, " ".join(["red", "apple", f"x{i}"] if i % 3 == 0 else ["blue", "sea", f"y{i}"] if i % 3 == 1 else ["green", "tree", f"z{i}"]),
             float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label_index double")
    _, out = CL.linear_svm(df.where("doc_id < 45"), df.where("doc_id >= 45"))
    assert all(r["prediction"] == r["label_index"] for r in out.collect())
    norm = F.sqrt(F.aggregate(__import__("pyspark.ml.functions", fromlist=["x"]).vector_to_array("features"), F.lit(0.0), lambda a, x: a + x * x))
    assert all(abs(r[0] - 1) < 1e-9 for r in out.select(norm).collect())


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (8.0,), (8.01,), (-0.1,), (0.08,), (4.0,)], "v double")
    got = dict(TF.score_histogram(df, "v", 100, 0.0, 8.0).collect())
    assert got == {1: 1, 100: 1, 2: 1, 51: 1}


def test_top_k_ties_by_key(spark):
    from revlens.operators.relational import top_k
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3), ("d", 1)], "k string, n int")
    assert [r["k"] for r in top_k(df, 3, [F.desc("n"), F.asc("k")]).collect()] == ["c", "a", "b"]


def brute_cos(vs):
    out = {}
    for (i, a), (j, b) in itertools.combinations(enumerate(vs), 2):
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        out[(i, j)] = 0.0 if na == 0 or nb == 0 else float(np.dot(a, b) / na / nb)
    return out


@pytest.mark.parametrize("rows_per_block", [3, 1000])
def test_cosine_dense_blocks(spark, rows_per_block):
    rng = np.random.default_rng(1)
    vs = [rng.normal(size=5) for _ in range(11)] + [np.zeros(5), np.ones(5), np.ones(5)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id long, v array<double>")
    got = {(r["a"], r["b"]): r["sim"] for r in SIM.cosine_dense(df, "id", "v", rows_per_block=rows_per_block).collect()}
    want = brute_cos(vs)
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    assert got[(12, 13)] == pytest.approx(1.0)


def test_cosine_dense_sends_a_vector_to_few_blocks(spark, monkeypatch):
    """More vectors do not mean more copies of each, and pairs leave a task in slices."""
    from revlens.operators.similarity import _wide_blocks
    assert [_wide_blocks(n, 64, 512) for n in (0, 500, 2_000, 100_000, 1_000_000)] == [1, 1, 4, 16, 16]
    assert _wide_blocks(10_000_000, 64, 512) * SIM.BLOCK_BYTES >= 10_000_000 * 64 * 8
    monkeypatch.setattr(SIM, "PAIRS", 10)
    rng = np.random.default_rng(2)
    vs = [rng.normal(size=4) for _ in range(60)]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vs)], "id long, v array<float>")
    want = brute_cos([np.array(v, np.float32).astype(float) for v in vs])
    for least in (None, 0.4):
        got = {(r["a"], r["b"]): r["sim"] for r in SIM.cosine_dense(df, "id", "v", rows_per_block=2, min_sim=least).collect()}
        assert set(got) == {k for k, s in want.items() if least is None or s >= least}
        assert all(abs(want[k] - s) < 1e-9 for k, s in got.items())
    assert SIM.cosine_dense(df.where("false"), "id", "v").collect() == []


def test_cosine_sparse_blocks(spark):
    docs = {1: {"a": 1.0, "b": 2.0}, 2: {"b": 1.0}, 3: {"c": 5.0}, 4: {}, 5: {"a": 1.0, "c": 1.0}}
    rows = [(d, t, s) for d, ts in docs.items() for t, s in ts.items()]
    scores = spark.createDataFrame(rows, "doc_id long, term string, score double")
    ids = spark.createDataFrame([(d,) for d in docs], "doc_id long")
    got = {(r["a"], r["b"]): r["sim"] for r in SIM.cosine_sparse(scores, ids=ids, rows_per_block=2, term_chunk=2).collect()}
    terms = ["a", "b", "c"]
    vs = [np.array([docs[d].get(t, 0.0) for t in terms]) for d in sorted(docs)]
    want = {(i + 1, j + 1): s for (i, j), s in brute_cos(vs).items()}
    assert set(got) == set(want)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)


def brute_silhouette(X, labels):
    n = len(X)
    s = []
    for i in range(n):
        own = labels[i]
        same = [j for j in range(n) if labels[j] == own and j != i]
        if not same:
            s.append(0.0)
            continue
        a = np.mean([np.linalg.norm(X[i] - X[j]) for j in same])
        b = min(np.mean([np.linalg.norm(X[i] - X[j]) for j in range(n) if labels[j] == c])
                for c in set(labels) if c != own)
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


def test_silhouette_exact_with_singleton(spark):
    rng = np.random.default_rng(2)
    X = [rng.normal(size=3) + (c * 3) for c in (0, 0, 0, 1, 1, 1, 1)] + [np.array([9.0, 9.0, 9.0])]
    labels = [0, 0, 0, 1, 1, 1, 1, 2]
    df = spark.createDataFrame([(i, [float(x) for x in v], labels[i]) for i, v in enumerate(X)],
                               "id long, v array<double>, c int")
    got = SIM.silhouette(df, "id", "v", "c", rows_per_block=3).collect()[0][0]
    assert got == pytest.approx(brute_silhouette(X, labels), abs=1e-9)


def test_sample_tokens_reproducible(spark):
    vocab = spark.createDataFrame([(w,) for w in "delta alpha charlie bravo echo".split()], "token string")
    a = sorted(tuple(r) for r in VE.sample_tokens(vocab, 20, seed=3).collect())
    b = sorted(tuple(r) for r in VE.sample_tokens(vocab.repartition(3), 20, seed=3).collect())
    assert a == b and len(a) == 20


def test_kmeans_rows_are_at_their_nearest_centroid(spark):
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from revlens.operators import cluster as CU
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 3)) + 4 * np.eye(3)[np.arange(120) % 3]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    preds, metrics, models = CU.kmeans_runs(df.withColumn("features", array_to_vector("embedding")), "features", [2, 3, 4])
    cost = {r["run"]: r["cost"] for r in metrics.collect()}
    for run, model in models.items():
        d = ((x[:, None, :] - np.array(model.clusterCenters())[None]) ** 2).sum(2)
        got = {r["vec_id"]: r["cluster"] for r in preds.where(F.col("run") == run).collect()}
        assert len(got) == 120 and all(d[i, c] <= d[i].min() + 1e-9 for i, c in got.items())
        assert cost[run] == pytest.approx(d.min(1).sum())
        # a centroid is the mean of its rows once the fit has settled
        for c, center in enumerate(model.clusterCenters()):
            assert np.allclose(center, x[[i for i in got if got[i] == c]].mean(0), atol=0.2)
    assert cost["k4"] < cost["k3"] < cost["k2"]


def test_silhouettes_of_near_points_far_from_the_origin(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(size=(30, 4)), np.ones((5, 4)), np.ones((5, 4)) + 1e-9 * np.arange(1, 6)[:, None]]) + 1e5
    one, two = [i % 3 for i in range(40)], [i // 10 for i in range(40)]
    df = spark.createDataFrame([(i, [float(x) for x in v], a, b) for i, (v, a, b) in enumerate(zip(X, one, two))],
                               "id long, v array<double>, a int, b int")
    got = {r["run"]: r["silhouette"] for r in SIM.silhouettes(df, "id", "v", {"a": "a", "b": "b"}, rows_per_block=7).collect()}
    assert got["a"] == pytest.approx(brute_silhouette(X, one), abs=1e-9)
    assert got["b"] == pytest.approx(brute_silhouette(X, two), abs=1e-9)
    assert SIM.distances(X[30:35], X[30:35]).max() == 0


def test_points_without_cluster_score_zero_and_absent_ones_do_not_count(spark):
    df = spark.createDataFrame([(0, [0.0], 1, True), (1, [1.0], 1, True), (2, [5.0], 2, True), (3, [6.0], 2, True),
                                (4, [9.0], None, True), (5, [100.0], 1, False)], "id long, v array<float>, c int, here boolean")
    got = SIM.silhouettes(df, "id", "v", {"r": "c"}, among={"r": "here"}).collect()[0]["silhouette"]
    assert got == pytest.approx(4 / 5 * brute_silhouette([np.array([x]) for x in (0.0, 1.0, 5.0, 6.0)], [1, 1, 2, 2]))


def test_runs_share_the_distances(spark):
    from revlens.operators import cluster as CU
    rows = [(f"k{k}", i, [float(i % 7), float(i)], i % k) for k in (3, 4) for i in range(40)]
    pred = spark.createDataFrame(rows, "run string, vec_id long, embedding array<double>, cluster int")
    out = CU.run_silhouettes(pred, "vec_id", "embedding", ["k3", "k4"])
    X = [np.array([float(i % 7), float(i)]) for i in range(40)]
    for r in out.collect():
        assert r["silhouette"] == pytest.approx(brute_silhouette(X, [i % int(r["run"][1]) for i in range(40)]), abs=1e-9)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInPandas") == 1
