"""Registered queries: similarity, clustering, vectors, topic models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cluster as CU
from ..operators import metrics as M
from ..operators import recurrent as RN
from ..operators import similarity as SIM
from ..operators import split as SP
from ..operators import tfidf as TF
from ..operators import topics as TP
from ..operators import vectors as VE
from ..operators import vocab as V
from . import common as C
from . import sqltext as S
from .catalog_text import CLEAN_MAP_CTE
from .registry import register


def _emb(spark, d):
    return C.fixtures.load_table(spark, d, "embeddings")


def _round6(x):
    """``round(x, 6)`` of numbers near 1, half away from zero: scaled, so that it stays in generated
    code.  Spark's ``round`` makes a decimal of every number, most of the time of an all-pairs table."""
    scaled = x * 1e6
    whole = F.rint(scaled)
    return F.when(F.abs(scaled - whole) == 0.5, scaled + F.signum(scaled) * 0.5).otherwise(whole) / 1e6 + 0.0


# --- similarity ------------------------------------------------------------------------------

@register("cosine_dense", """SELECT a.vec_id AS a, b.vec_id AS b,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""")
def cosine_dense(spark, d):
    s = SIM.cosine_dense(_emb(spark, d), "vec_id", "embedding")
    return s.select("a", "b", _round6(F.col("sim")).alias("sim"))


_TARGET_SIMS = """WITH sims AS (SELECT a.vec_id AS a, b.vec_id AS b,
  list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS sim
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)) """


def _first_of_label(spark, d):
    return _emb(spark, d).groupBy("label").agg(F.min("vec_id").alias("vec_id")).select("vec_id")


@register("cosine_top_k", _TARGET_SIMS + """SELECT a, b, round(sim, 6) AS sim, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM sims) WHERE rank <= 10""")
def cosine_top_k(spark, d):
    """The 10 vectors most similar to each target (the first vector of every label), among all vectors."""
    s = SIM.similar_to_targets(_emb(spark, d), _first_of_label(spark, d), "vec_id", "embedding", top_k=10)
    return s.select("a", "b", F.round("sim", 6).alias("sim"), F.col("rank").cast("bigint").alias("rank"))


@register("cosine_min_sim", _TARGET_SIMS + "SELECT a, b, round(sim, 6) AS sim FROM sims WHERE sim >= 0.3")
def cosine_min_sim(spark, d):
    """All vectors of similarity 0.3 or more to each target."""
    s = SIM.similar_to_targets(_emb(spark, d), _first_of_label(spark, d), "vec_id", "embedding", min_sim=0.3)
    return s.select("a", "b", F.round("sim", 6).alias("sim"))


_TARGET_TFIDF = "WITH " + S.CORPUS_CTE + f""",
targets AS (SELECT doc_id, text FROM corpus WHERE doc_id IN (SELECT min(doc_id) FROM corpus GROUP BY title)),
bow AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({S.remove_stop(S.tokenize(S.normalize('text')))}) AS term FROM targets) GROUP BY doc_id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM targets)) / (1 + count(*))) + 1 AS idf FROM bow GROUP BY term),
tfidf AS (SELECT b.doc_id, b.term, b.n * i.idf AS score FROM bow b JOIN idf i ON b.term = i.term) """


@register("cosine_sparse", _TARGET_TFIDF + """,
norms AS (SELECT doc_id, sqrt(sum(score * score)) AS nrm FROM tfidf GROUP BY doc_id),
dots AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(x.score * y.score) AS dot FROM tfidf x JOIN tfidf y ON x.term = y.term AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT t1.doc_id AS a, t2.doc_id AS b FROM targets t1 JOIN targets t2 ON t1.doc_id < t2.doc_id)
SELECT p.a, p.b, round(coalesce(d.dot / (n1.nrm * n2.nrm), 0), 6) AS sim
FROM pairs p LEFT JOIN dots d ON d.a = p.a AND d.b = p.b LEFT JOIN norms n1 ON n1.doc_id = p.a LEFT JOIN norms n2 ON n2.doc_id = p.b""")
def cosine_sparse(spark, d):
    """TF-IDF fitted on the target reviews, cosine between every two of them."""
    tg = C.corpus(spark, d).join(C.target_ids(spark, d), "descriptor", "left_semi").select("doc_id", "text")
    toks = tg.select("doc_id", T.remove_stop_words(T.tokenize_words(T.normalize_text("text"))).alias("tokens"))
    scores = TF.tfidf(C.written(V.bag_of_words(toks), "bow"), tg)
    s = SIM.cosine_sparse(scores, ids=tg)
    return s.select("a", "b", F.round("sim", 6).alias("sim"))


# --- clustering ---------------------------------------------------------------------------------

def _sil_sql(src: str, cl: str, sfx: str = "") -> str:
    """Exact silhouette CTEs over all point pairs of ``src`` with cluster column ``cl``."""
    return f"""d{sfx} AS (SELECT a.vec_id AS id, a.{cl} AS own, b.{cl} AS c,
    list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dist FROM {src} a, {src} b),
per{sfx} AS (SELECT id, own, c, sum(dist) AS s, count(*) AS n FROM d{sfx} GROUP BY id, own, c),
pt{sfx} AS (SELECT id, max(CASE WHEN c = own THEN n END) AS n_own, max(CASE WHEN c = own THEN s END) AS s_own,
              min(CASE WHEN c <> own THEN s / n END) AS b FROM per{sfx} GROUP BY id) """


_SIL_VALUE = ("avg(CASE WHEN n_own <= 1 OR b IS NULL THEN 0.0 ELSE (b - s_own / (n_own - 1)) / "
              "greatest(s_own / (n_own - 1), b) END)")


@register("silhouette", "WITH " + _sil_sql("embeddings", "label")
          + f"SELECT round({_SIL_VALUE}, 6) AS silhouette FROM pt")
def silhouette(spark, d):
    s = SIM.silhouette(_emb(spark, d), "vec_id", "embedding", "label")
    return s.select(F.round("silhouette", 6).alias("silhouette"))


_ASSIGN_CTE = """WITH cent AS (SELECT label AS cid, list(x ORDER BY dim) AS cv FROM (
    SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim
    FROM embeddings) GROUP BY label, dim) GROUP BY label),
dist AS (SELECT e.vec_id, e.label, e.embedding, c.cid, list_distance(e.embedding::DOUBLE[], c.cv) AS d FROM embeddings e, cent c),
assigned AS (SELECT vec_id, any_value(label) AS label, any_value(embedding) AS embedding, arg_min(cid, (d, cid)) AS cluster
             FROM dist GROUP BY vec_id) """


def _assigned(spark, d):
    e = _emb(spark, d)
    cents = CU.mean_vectors(e, "label", "embedding").withColumnRenamed("label", "cluster")
    return CU.assign_nearest(e, "embedding", cents)


@register("kmeans_assign", _ASSIGN_CTE + "SELECT vec_id, cluster FROM assigned")
def kmeans_assign(spark, d):
    return _assigned(spark, d).select("vec_id", "cluster")


@register("cluster_profile", _ASSIGN_CTE + "SELECT cluster, label, count(*) AS n FROM assigned GROUP BY cluster, label")
def cluster_profile(spark, d):
    return CU.cluster_profile(_assigned(spark, d), "cluster", "label")


@register("cluster_members", _ASSIGN_CTE + "SELECT cluster, vec_id FROM assigned ORDER BY cluster, vec_id")
def cluster_members(spark, d):
    return _assigned(spark, d).select("cluster", "vec_id").orderBy("cluster", "vec_id")


@register("best_run", _ASSIGN_CTE + ", " + _sil_sql("assigned", "label", "1") + ", " + _sil_sql("assigned", "cluster", "2")
          + f", runs AS (SELECT 'label' AS run, round({_SIL_VALUE}, 6) AS silhouette FROM pt1 "
          f"UNION ALL SELECT 'assigned', round({_SIL_VALUE}, 6) FROM pt2) "
          "SELECT run, silhouette FROM runs WHERE silhouette = (SELECT max(silhouette) FROM runs)")
def best_run(spark, d):
    a = _assigned(spark, d)
    both = SIM.silhouettes(a, "vec_id", "embedding", {"label": "label", "assigned": "cluster"})
    runs = C.materialize(both.select("run", F.round("silhouette", 6).alias("silhouette")))  # read for the maximum and for the rows
    return CU.best_runs(runs)


def _features(spark, d):
    return _emb(spark, d).select("vec_id", "label", "embedding", array_to_vector("embedding").alias("features"))


def _kmeans(spark, d):
    return CU.kmeans_runs(_features(spark, d), "features", [3, 4, 5], seed=0)


@register("kmeans_runs")
def kmeans_runs(spark, d):
    """k-means for k = 3, 4, 5 (seed 0) on the document vectors."""
    preds, _, _ = _kmeans(spark, d)
    return preds.select("run", "vec_id", "cluster")


@register("kmeans_silhouettes")
def kmeans_silhouettes(spark, d):
    """Exact Euclidean silhouette of every k-means run, with the best run flagged."""
    preds, _, _ = _kmeans(spark, d)
    s = CU.run_silhouettes(preds.select("run", "vec_id", "embedding", "cluster"), "vec_id", "embedding",
                           ["k3", "k4", "k5"])
    s = C.materialize(s)  # read for the maximum and for the rows
    top = s.agg(F.max("silhouette")).scalar()
    return s.select("run", "silhouette", (F.col("silhouette") == top).alias("best"))


@register("silhouette_sq")
def silhouette_sq(spark, d):
    """MLlib's linear-cost silhouette (squared Euclidean) for each k-means run."""
    preds, _, _ = _kmeans(spark, d)
    rows = [(r, CU.silhouette_sq(preds.where(F.col("run") == r))) for r in ("k3", "k4", "k5")]
    return spark.createDataFrame(rows, "run string, silhouette_sq double")


@register("kmeans_train_test")
def kmeans_train_test(spark, d):
    """Fit k-means on the train part, assign the test part."""
    f = SP.split_train_test(_features(spark, d), "vec_id", 0.8, seed=1)
    out = None
    for k in (3, 4, 5):
        from pyspark.ml.clustering import KMeans
        m = KMeans(k=k, seed=0, featuresCol="features", predictionCol="cluster").fit(f.where("split = 'train'"))
        p = m.transform(f.where("split = 'test'")).select(F.lit(f"k{k}").alias("run"), "vec_id", "label", "cluster")
        out = p if out is None else out.unionByName(p)
    return out


@register("hierarchical_clusters")
def hierarchical_clusters(spark, d):
    return CU.bisecting_clusters(_features(spark, d), "features", 4).select("vec_id", "cluster")


@register("project_2d")
def project_2d(spark, d):
    return CU.project_2d(_features(spark, d), "features").select("vec_id", "x", "y")


# --- vectors --------------------------------------------------------------------------------------

@register("mean_pool", """SELECT label, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 6) AS value FROM (
  SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY label, dim""")
def mean_pool(spark, d):
    m = VE.mean_pool(_emb(spark, d), "label", "embedding")
    return m.select("label", "dim", F.round("value", 6).alias("value"))


@register("sample_tokens", f"""WITH vocab AS (SELECT DISTINCT unnest({S.tokenize(S.normalize('text'))}) AS token FROM documents),
ranked AS (SELECT token, row_number() OVER (ORDER BY token) AS rank FROM vocab),
draws AS (SELECT range AS draw, CAST(('0x' || substr(md5('0:' || CAST(range AS VARCHAR)), 1, 8)) AS BIGINT) % (SELECT count(*) FROM vocab) + 1 AS rank FROM range(100))
SELECT d.draw, r.token FROM draws d JOIN ranked r ON d.rank = r.rank""")
def sample_tokens(spark, d):
    vocab = V.distinct_tokens(V.tokenize(C.docs(spark, d)))
    return VE.sample_tokens(vocab, 100, seed=0)


_OCCURRENCES = CLEAN_MAP_CTE + f""", occ AS (SELECT doc_id, pos, toks[pos] AS token FROM (
   SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS pos FROM (SELECT doc_id, {S.tokenize(S.normalize("coalesce(text, '')"))} AS toks FROM documents))),
words AS (SELECT o.doc_id, m.term AS word, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.pos) AS pos
   FROM occ o JOIN clean_map m ON m.token = o.token WHERE m.term IS NOT NULL),
pairs AS (SELECT a.word, b.word AS context, count(*) AS n FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.pos <> b.pos
   AND abs(a.pos - b.pos) <= 3 GROUP BY a.word, b.word)"""


def _clean_tokens(spark, d):
    """The cleaned documents, written: neither the tables they are made from nor their shuffles stay."""
    return C.settled(spark, lambda: C.written(V.clean_tokens(C.docs(spark, d)), "clean_tokens"))


@register("cooccurrence", _OCCURRENCES + " SELECT word, context, n FROM pairs")
def cooccurrence(spark, d):
    """Counts of cleaned words at most 3 positions apart, both ways round."""
    return VE.cooccurrence(_clean_tokens(spark, d), 3)


@register("word_pmi", _OCCURRENCES + """, margins AS (SELECT word, sum(n) AS n FROM pairs GROUP BY word)
SELECT * FROM (SELECT p.word, p.context, p.n, round(ln(p.n * (SELECT sum(n) FROM margins) / (a.n::DOUBLE * b.n)), 6) AS pmi
FROM pairs p JOIN margins a ON a.word = p.word JOIN margins b ON b.word = p.context) WHERE pmi > 1e-6""")
def word_pmi(spark, d):
    """Positive pointwise mutual information of the co-occurring words."""
    tokens = _clean_tokens(spark, d)
    return VE.shifted_pmi(VE.cooccurrence(tokens, 3), margins=VE.margins(tokens, 3)).select(
        "word", "context", "n", F.round("pmi", 6).alias("pmi")).where("pmi > 1e-6")


def _word_vectors(spark, d):
    """The fit's numbers are floats, so its table keeps floats."""
    def build():
        found = VE.word_vectors(_clean_tokens(spark, d), size=200, window=3, min_count=1)
        return found.select("word", F.col("vector").cast("array<float>").alias("vector"))
    return C.fitted(spark, d, "word_vectors", build).select("word", F.col("vector").cast("array<double>").alias("vector"))


@register("word_vectors")
def word_vectors(spark, d):
    """Word vectors (200 dims, window 3, min count 1) over the cleaned corpus."""
    return _word_vectors(spark, d)


@register("sort_words")
def sort_words(spark, d):
    """Whole word vectors ordered by word; ``x0`` is the first component."""
    return _word_vectors(spark, d).select("word", "vector", F.col("vector")[0].alias("x0")).orderBy("word")


@register("slice_rows")
def slice_rows(spark, d):
    """Rows 1..4 of the word-sorted vectors."""
    from ..operators.relational import slice_rows as _slice
    return _slice(_word_vectors(spark, d), [F.col("word")], 1, 5).select("word", "vector", F.col("vector")[0].alias("x0"))


@register("chosen_word_vectors")
def chosen_word_vectors(spark, d):
    """Vectors of 100 sampled tokens, projected to 2-D."""
    wv = _word_vectors(spark, d)
    chosen = VE.sample_tokens(wv.select("word"), 100, seed=0, token="word").select(F.col("token").alias("word")).distinct()
    wv = wv.join(chosen, "word", "left_semi")
    return CU.project_2d(wv.withColumn("features", array_to_vector("vector")), "features").select("word", "x", "y")


def _doc_vectors(spark, d):
    """Paragraph vectors (100 dims, min count 2) of all reviews, the words fitted on the train part only."""
    def build():
        c = SP.split_train_test(C.corpus(spark, d).select("doc_id", "genre"), "doc_id", 0.8, seed=1)
        c = C.written(c, "splits")
        bow = C.settled(spark, lambda: C.written(V.bag_of_words(V.clean_tokens(C.docs(spark, d))), "clean_bow"))
        train = C.written(bow.join(c.where("split = 'train'"), "doc_id", "left_semi"), "train_bow")
        model = VE.fit_paragraph_vectors(train, size=100, min_count=2)
        found = VE.infer_paragraph_vectors(model, bow)
        return c.join(found, "doc_id", "left").select(
            "doc_id", "genre", "split", F.coalesce("vector", F.array_repeat(F.lit(0.0), 100)).alias("vector"))
    return C.fitted(spark, d, "document_vectors", build)


@register("document_vectors")
def document_vectors(spark, d):
    """Paragraph vectors per review, inferred with the words of the train part."""
    return _doc_vectors(spark, d).select("doc_id", "split", "vector")


@register("embed_texts")
def embed_texts(spark, d):
    """Text embeddings through the model hook (stand-in hashing model)."""
    return VE.embed_texts(C.docs(spark, d), "text", VE.hashing_embedder(16)).select("doc_id", "embedding")


# the four networks on vectors of 100: twice as many cells in one layer, as many in each
# direction, two layers of twice as many, two layers of as many
NETWORKS = {"mdl1": RN.Network((200,), activation="relu"), "mdl2": RN.Network((100,), both=True),
            "mdl3": RN.Network((200, 200), activation="relu"), "mdl4": RN.Network((100, 100), activation="relu")}


@register("neural_genre_classifier")
def neural_genre_classifier(spark, d):
    """Recurrent genre classifiers on document vectors read in ten steps of ten; accuracy per model and part."""
    dv = _doc_vectors(spark, d).where("genre is not null")
    mapping = SP.label_index(dv.select(F.col("genre").alias("label")), "label")
    dv = SP.encode_labels(dv.withColumnRenamed("genre", "label"), "label", mapping)
    dv = C.materialize(dv.select("split", "label_index", "vector"))  # the fit and its report read the vectors
    model = RN.fit(dv.where("split = 'train'"), NETWORKS, 100, mapping.count(), rounds=20)
    return M.overfit_gap(RN.predict(dv, model).withColumnRenamed("label_index", "actual"))


# --- topics ------------------------------------------------------------------------------------------

_GENRE_WEIGHTS = "WITH " + S.CORPUS_CTE + """, """ + """
bow AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(TOKS) AS term FROM documents) GROUP BY doc_id, term),
idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM bow GROUP BY term),
tfidf AS (SELECT b.doc_id, b.term, b.n * i.idf AS score FROM bow b JOIN idf i ON b.term = i.term),
ng AS (SELECT genre, count(*) AS n FROM corpus GROUP BY genre),
w AS (SELECT c.genre AS topic, t.term, sum(t.score) / any_value(ng.n) AS weight FROM tfidf t JOIN corpus c ON t.doc_id = c.doc_id
      JOIN ng ON ng.genre = c.genre GROUP BY c.genre, t.term) """.replace("TOKS", S.remove_stop(S.tokenize(S.normalize("text"))))


@register("top_terms_per_topic", _GENRE_WEIGHTS + """SELECT topic, term, round(weight, 6) AS weight, rank FROM (
  SELECT topic, term, weight, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, term) AS rank FROM w) WHERE rank <= 7""")
def top_terms_per_topic(spark, d):
    """Per genre (as topic), the 7 terms with the largest mean TF-IDF in it."""
    bow = C.plain_bow_table(spark, d)
    c = C.corpus(spark, d).select("doc_id", F.col("genre").alias("topic"))
    ng = c.groupBy("topic").agg(F.count(F.lit(1)).alias("ng"))
    # idf is one number per term, so a topic's counts are summed before they meet it
    counts = bow.join(c, "doc_id").groupBy("topic", "term").agg(F.sum("n").alias("n"))
    w = (counts.join(TF.idf_table(bow, C.doc_rows(spark, d)), "term").select("topic", "term", (F.col("n") * F.col("idf")).alias("s"))
         .join(ng, "topic").select("topic", "term", (F.col("s") / F.col("ng")).alias("weight")))
    # rank on 9 decimals so that summation-order noise cannot reorder true ties
    top = TP.top_terms_per_topic(w.withColumn("weight", F.round("weight", 9)), 7)
    return top.select("topic", "term", F.round("weight", 6).alias("weight"), F.col("rank").cast("bigint").alias("rank"))


def _term_counts(spark, d):
    # the texts are dealt by document, so their counts need no shuffle of their own
    texts = C.docs_by_document(spark, d)
    return C.written(V.bag_of_words(texts.select("doc_id", T.clean_doc("text").alias("tokens"))), "term_counts")


@register("lsa_topics")
def lsa_topics(spark, d):
    """SVD topics (k = 5): 10 terms per topic by absolute weight."""
    tw, _, _ = TP.lsa(_term_counts(spark, d), 5)
    return TP.top_terms_per_topic(tw, 10, by_abs=True).select("topic", "rank", "term", "weight")


@register("lsa_positions")
def lsa_positions(spark, d):
    """Document coordinates U * S in the 5 SVD topics; without terms, the origin."""
    _, pos, values = TP.lsa(_term_counts(spark, d), 5)
    every = C.docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))).alias("topic"))
    return every.join(pos, ["doc_id", "topic"], "left").select("doc_id", "topic", F.coalesce("value", F.lit(0.0)).alias("value"))


def _lda(spark, d):
    return TP.lda(_term_counts(spark, d), 5, passes=20, seed=23)


@register("lda_topics")
def lda_topics(spark, d):
    return TP.lda_topic_terms(_lda(spark, d), 10)


@register("lda_mixtures")
def lda_mixtures(spark, d):
    return TP.topic_mixtures(_lda(spark, d), C.docs(spark, d))


@register("topic_similarity")
def topic_similarity(spark, d):
    """Cosine between target reviews in LDA topic space."""
    mix = TP.topic_mixtures(_lda(spark, d), C.docs(spark, d))
    tg = C.corpus(spark, d).join(C.target_ids(spark, d), "descriptor", "left_semi").select("doc_id")
    return SIM.cosine_dense(mix.join(tg, "doc_id", "left_semi"), "doc_id", "mixture")


@register("pairwise_cross", """WITH cent AS (SELECT label AS cid, list(x ORDER BY dim) AS cv FROM (
    SELECT label, dim, avg(x) AS x FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS dim
    FROM embeddings) GROUP BY label, dim) GROUP BY label)
SELECT CAST(a.cid AS BIGINT) AS a, CAST(b.cid AS BIGINT) AS b, round(list_cosine_similarity(a.cv, b.cv), 6) AS sim
FROM cent a JOIN cent b ON a.cid < b.cid""")
def pairwise_cross(spark, d):
    """All pairs of class centroids (cosine), through the block-pair operator."""
    cents = CU.mean_vectors(_emb(spark, d), "label", "embedding")
    return SIM.cosine_dense(cents, "label", "vector").select("a", "b", F.round("sim", 6).alias("sim"))


@register("doc_vector_with_metadata")
def doc_vector_with_metadata(spark, d):
    """k-means (k = 4) predictions keep the document columns: no positional attach."""
    preds, _, _ = _kmeans(spark, d)
    return preds.where("run = 'k4'").select("vec_id", "label", "cluster")
