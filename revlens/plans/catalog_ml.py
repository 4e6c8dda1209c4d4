"""Registered queries: splits, label encoding, metrics, classifiers, scoring hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import classify as CL
from ..operators import metrics as M
from ..operators import split as SP
from ..operators import svm as SVM
from ..operators import tfidf as TF
from . import common as C
from . import sqltext as S
from .registry import register

# Fixed parameters of the prediction fixture: the genre axis and the four models.
GENRES = ["de", "en", "es", "fr"]
MODELS = ["mdl1", "mdl2", "mdl3", "mdl4"]


def _hex(sql_expr: str) -> str:
    return f"CAST(('0x' || {sql_expr}) AS BIGINT)"


def _shex(col):
    return F.conv(col, 16, 10).cast("bigint")


# --- splits and labels -------------------------------------------------------------

@register("split_train_test", "SELECT doc_id, CASE WHEN substr(md5('1:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccc' "
          "THEN 'train' ELSE 'test' END AS split FROM documents")
def split_train_test(spark, d):
    return SP.split_train_test(C.docs(spark, d).select("doc_id"), "doc_id", 0.8, seed=1)


@register("split_train_val_test", "SELECT doc_id, CASE WHEN substr(md5('12:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccc' "
          "THEN 'train' WHEN substr(md5('12:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'e6666666' THEN 'val' "
          "ELSE 'test' END AS split FROM documents")
def split_train_val_test(spark, d):
    return SP.split_train_val_test(C.docs(spark, d).select("doc_id"), "doc_id", 0.8, 0.1, seed=12)


@register("encode_labels", "SELECT doc_id, lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_index "
          "FROM documents WHERE lang IS NOT NULL")
def encode_labels(spark, d):
    docs = C.fixtures.load_table(spark, d, "documents").select("doc_id", F.col("lang").alias("label"))
    mapping = SP.label_index(docs, "label")
    return SP.encode_labels(docs.where(F.col("label").isNotNull()), "label", mapping)


@register("decode_labels", "SELECT doc_id, i AS label_index, (SELECT list(DISTINCT lang ORDER BY lang) FROM documents)[i + 1] AS label "
          "FROM (SELECT doc_id, CAST(doc_id % 4 AS INTEGER) AS i FROM documents)")
def decode_labels(spark, d):
    docs = C.fixtures.load_table(spark, d, "documents")
    mapping = SP.label_index(docs.select(F.col("lang").alias("label")), "label")
    idx = docs.select("doc_id", (F.col("doc_id") % 4).cast("int").alias("label_index"))
    return SP.decode_labels(idx, "label_index", mapping)


# --- the prediction fixture -----------------------------------------------------------

def predictions(spark, d):
    """``(doc_id, model, split, actual, pred, score, label)`` derived from documents:
    actual = lang; pred = actual when the first md5 digit is below 'a', else a genre
    picked by the second digit; label = (true = 'en'); score from md5 digits."""
    docs = C.fixtures.load_table(spark, d, "documents")
    x = docs.select("doc_id", F.col("lang").alias("actual"),
                    F.explode(F.array(*[F.lit(m) for m in MODELS])).alias("model"))  # one row per model
    h = F.md5(F.concat(F.col("model"), F.lit(":"), F.col("doc_id").cast("string")))
    genres = F.array(*[F.lit(g) for g in GENRES])
    pred = F.when(F.substring(h, 1, 1) < "a", F.col("actual")).otherwise(
        F.element_at(genres, (_shex(F.substring(h, 2, 1)) % 4 + 1).cast("int")))
    label = F.when(F.col("actual") == "en", 1).otherwise(0)
    u = _shex(F.substring(h, 3, 6)) / 16777216.0
    x = x.select("doc_id", "model", "actual", pred.alias("pred"), label.alias("label"), u.alias("u"))
    x = x.withColumn("score", (F.col("u") * 3 + F.col("label")) / 4.0).drop("u")  # the classes overlap
    return SP.split_train_test(x, "doc_id", 0.8, seed=1)


PRED_CTE = f"""WITH m AS (SELECT unnest({S.list_lit(MODELS)}) AS model),
x AS (SELECT d.doc_id, m.model, d.lang AS actual, md5(m.model || ':' || CAST(d.doc_id AS VARCHAR)) AS h FROM documents d, m),
predictions AS (
  SELECT doc_id, model, actual,
         CASE WHEN substr(h, 1, 1) < 'a' THEN actual ELSE {S.list_lit(GENRES)}[{_hex('substr(h, 2, 1)')} % 4 + 1] END AS pred,
         CASE WHEN actual = 'en' THEN 1 ELSE 0 END AS label,
         ({_hex('substr(h, 3, 6)')} / 16777216.0 * 3 + CASE WHEN actual = 'en' THEN 1 ELSE 0 END) / 4.0 AS score,
         CASE WHEN substr(md5('1:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split
  FROM x) """


@register("predictions", PRED_CTE + "SELECT doc_id, model, split, actual, pred, label, score FROM predictions")
def predictions_q(spark, d):
    return predictions(spark, d).select("doc_id", "model", "split", "actual", "pred", "label", "score")


@register("accuracy", PRED_CTE + "SELECT model, split, round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy "
          "FROM predictions GROUP BY model, split")
def accuracy(spark, d):
    return M.accuracy(predictions(spark, d), ["model", "split"]).withColumn("accuracy", F.round("accuracy", 6))


@register("confusion_matrix", PRED_CTE + ", g AS (SELECT unnest(" + S.list_lit(GENRES) + ") AS actual) "
          "SELECT g.actual, " + ", ".join(
              f"CAST(count(p.pred) FILTER (WHERE p.pred = '{c}') AS BIGINT) AS {c}" for c in GENRES)
          + " FROM g LEFT JOIN (SELECT * FROM predictions WHERE model = 'mdl1' AND split = 'test') p ON p.actual = g.actual GROUP BY g.actual")
def confusion_matrix(spark, d):
    p = predictions(spark, d).where("model = 'mdl1' AND split = 'test'")
    return M.confusion_matrix(p, C.genres(spark, d))


@register("accuracy_leaderboard", PRED_CTE + "SELECT model, round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy "
          "FROM predictions WHERE split = 'test' GROUP BY model")
def accuracy_leaderboard(spark, d):
    p = predictions(spark, d).where("split = 'test'")
    return M.accuracy_leaderboard(p).withColumn("accuracy", F.round("accuracy", 6))


@register("overfit_gap", PRED_CTE + """SELECT model,
  round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'train'), 6) AS train_accuracy,
  round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'test'), 6) AS test_accuracy,
  round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'train')
      - avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END) FILTER (WHERE split = 'test'), 6) AS gap
FROM predictions GROUP BY model""")
def overfit_gap(spark, d):
    g = M.overfit_gap(predictions(spark, d))
    return g.select("model", *[F.round(c, 6).alias(c) for c in ("train_accuracy", "test_accuracy", "gap")])


_ROC_SQL = PRED_CTE + """, g AS (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM predictions GROUP BY model, score),
c AS (SELECT model, score, pos, neg,
             sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER (PARTITION BY model) AS P, sum(neg) OVER (PARTITION BY model) AS N FROM g) """


@register("roc_points", _ROC_SQL + "SELECT model, round(score, 6) AS score, round(tp / P, 6) AS tpr, round(fp / N, 6) AS fpr FROM c")
def roc_points(spark, d):
    pts = M.roc_points(predictions(spark, d))
    return pts.select("model", F.round("score", 6).alias("score"), F.round("tpr", 6).alias("tpr"),
                      F.round("fpr", 6).alias("fpr"))


@register("roc_auc", _ROC_SQL + "SELECT model, round(sum(neg * (2 * tp - pos)) / (2.0 * any_value(P) * any_value(N)), 6) AS auc "
          "FROM c GROUP BY model")
def roc_auc(spark, d):
    auc = M.roc_auc(M.roc_points(predictions(spark, d)))
    return auc.select("model", F.round("auc", 6).alias("auc"))


@register("argmax_label", PRED_CTE + ", v AS (SELECT doc_id, model, [" + ", ".join(
    _hex(f"substr(md5(model || '/' || CAST(doc_id AS VARCHAR)), {2 * k + 1}, 2)") for k in range(4))
    + "] AS probs FROM predictions) SELECT doc_id, model, CAST(list_position(probs, list_max(probs)) - 1 AS INTEGER) AS argmax FROM v")
def argmax_label(spark, d):
    p = predictions(spark, d)
    h = F.md5(F.concat(F.col("model"), F.lit("/"), F.col("doc_id").cast("string")))
    probs = F.array(*[_shex(F.substring(h, 2 * k + 1, 2)) for k in range(4)])
    return p.select("doc_id", "model", M.argmax_label(probs).cast("int").alias("argmax"))


# --- TF-IDF features fitted on train, Naive Bayes -----------------------------------------

def _labelled_docs(spark, d):
    docs = C.fixtures.load_table(spark, d, "documents").select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("label"))
    return SP.split_train_test(C.fixtures.balanced(docs, "doc_id"), "doc_id", 0.8, seed=1)


def _nb_inputs(spark, d):
    docs = _labelled_docs(spark, d)
    # the bag of words feeds the vocabulary cap, the idf, both parts' features and
    # the class counts: it is written once instead of re-tokenising per branch
    # texts are dealt by document, so that their words need no shuffle to be counted
    texts = C.docs_by_document(spark, d)
    bow = C.written(T.explode_rows(texts, ["doc_id"], CL.sk_tokens("text"), "term")
                    .groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n")), "bow")
    train = docs.select("doc_id", "label", "split").where("split = 'train'")
    train_bow = SP.split_train_test(bow, "doc_id", 0.8, seed=1).where("split = 'train'").drop("split")
    # the L2-normalised features feed fitting, both parts and the feature sums
    feats = C.written(TF.tfidf_l2(train_bow, train, bow, 4000), "features")
    return docs, train, train_bow, feats


_NB_CTE = """WITH c AS (SELECT doc_id, coalesce(text, '') AS text, lang AS label,
  CASE WHEN substr(md5('1:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END AS split FROM documents),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM c),
bow AS (SELECT doc_id, term, count(*) AS n FROM tok GROUP BY doc_id, term),
trb AS (SELECT * FROM bow WHERE doc_id IN (SELECT doc_id FROM c WHERE split = 'train')),
ntr AS (SELECT count(*) AS n FROM c WHERE split = 'train'),
vocab AS (SELECT term FROM trb GROUP BY term ORDER BY sum(n) DESC, term LIMIT 4000),
idf AS (SELECT term, ln((1 + (SELECT n FROM ntr)) / (1 + count(*))) + 1 AS idf FROM trb
        WHERE term IN (SELECT term FROM vocab) GROUP BY term),
raw AS (SELECT b.doc_id, b.term, b.n * i.idf AS score FROM bow b JOIN idf i ON b.term = i.term),
feat AS (SELECT doc_id, term, score / sqrt(sum(score * score) OVER (PARTITION BY doc_id)) AS score FROM raw) """


@register("tfidf_l2", _NB_CTE + "SELECT f.doc_id, c.split, f.term, round(f.score, 6) AS score FROM feat f JOIN c ON f.doc_id = c.doc_id")
def tfidf_l2(spark, d):
    feats = SP.split_train_test(_nb_inputs(spark, d)[3], "doc_id", 0.8, seed=1)
    return feats.select("doc_id", "split", "term", F.round("score", 6).alias("score"))


_NB_SQL = _NB_CTE + """,
fc AS (SELECT c.label, f.term, sum(f.score) AS fc FROM feat f JOIN c ON f.doc_id = c.doc_id WHERE c.split = 'train' GROUP BY c.label, f.term),
w AS (SELECT term, label, ln(fc + 1.0) - ln(1.0) AS w FROM fc),
cls AS (SELECT label, ln(count(*) / (SELECT n FROM ntr)) AS prior FROM c WHERE split = 'train' GROUP BY label),
den AS (SELECT cls.label, prior, ln(coalesce(t.total, 0) + 1.0 * (SELECT count(*) FROM vocab)) AS logden
        FROM cls LEFT JOIN (SELECT label, sum(fc) AS total FROM fc GROUP BY label) t ON t.label = cls.label),
test AS (SELECT doc_id, label FROM c WHERE split = 'test'),
xs AS (SELECT doc_id, sum(score) AS X FROM feat GROUP BY doc_id),
sp AS (SELECT f.doc_id, w.label, sum(f.score * w.w) AS s FROM feat f JOIN w ON f.term = w.term GROUP BY f.doc_id, w.label),
sc AS (SELECT t.doc_id, t.label AS actual, d.label AS cls,
              d.prior + coalesce(xs.X, 0) * (ln(1.0) - d.logden) + coalesce(sp.s, 0) AS score
       FROM test t CROSS JOIN den d LEFT JOIN xs ON xs.doc_id = t.doc_id
       LEFT JOIN sp ON sp.doc_id = t.doc_id AND sp.label = d.label),
best AS (SELECT doc_id, actual, cls AS pred, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cls) AS r FROM sc) """


def _naive_bayes(spark, d):
    docs, train, train_bow, feats = _nb_inputs(spark, d)
    vocab_size = TF.vocabulary_cap(train_bow, 4000).select(F.count(F.lit(1))).scalar()
    feats = SP.split_train_test(feats, "doc_id", 0.8, seed=1)  # a pure function of the key: no join
    train_x = feats.where("split = 'train'").drop("split")
    weights, classes = CL.fit_naive_bayes(train_x, train.select("doc_id", "label"), vocab_size, 1.0)
    test = docs.where("split = 'test'")
    test_x = feats.where("split = 'test'").drop("split")
    pred = CL.predict_naive_bayes(test_x, test.select("doc_id"), weights, classes, 1.0)
    return pred.join(test.select("doc_id", F.col("label").alias("actual")), "doc_id")


@register("naive_bayes", _NB_SQL + "SELECT doc_id, actual, pred FROM best WHERE r = 1")
def naive_bayes(spark, d):
    return _naive_bayes(spark, d).select("doc_id", "actual", "pred")


@register("naive_bayes_accuracy", _NB_SQL + "SELECT round(avg(CASE WHEN actual = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM best WHERE r = 1")
def naive_bayes_accuracy(spark, d):
    return M.accuracy(_naive_bayes(spark, d)).select(F.round("accuracy", 6).alias("accuracy"))


@register("naive_bayes_confusion", _NB_SQL + ", g AS (SELECT unnest(" + S.list_lit(GENRES) + ") AS actual) "
          "SELECT g.actual, " + ", ".join(f"CAST(count(b.pred) FILTER (WHERE b.pred = '{c}') AS BIGINT) AS {c}" for c in GENRES)
          + " FROM g LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON b.actual = g.actual GROUP BY g.actual")
def naive_bayes_confusion(spark, d):
    return M.confusion_matrix(_naive_bayes(spark, d), C.genres(spark, d))


@register("linear_svm")
def linear_svm(spark, d):
    """One-vs-one linear SVMs, C = 1, on the TF-IDF of Naive Bayes; predictions on the test
    part, with the largest relative duality gap of the machines."""
    docs, _, _, feats = _nb_inputs(spark, d)
    docs = docs.where("label is not null").select("doc_id", "label", "split")
    mapping = SP.label_index(docs, "label")
    docs = C.materialize(SP.encode_labels(docs, "label", mapping))
    machines = SVM.fit(feats, docs.where("split = 'train'").select("doc_id", "label_index"))
    test = docs.where("split = 'test'")
    pred = SP.decode_labels(SVM.predict(machines, feats, test), "pred_index", mapping, out="pred")
    return test.join(pred, "doc_id").select("doc_id", F.col("label").alias("actual"), "pred",
                                            F.lit(float(machines.gaps.max(initial=0.0))).alias("gap"))


# --- batch scoring hooks with deterministic stand-in models --------------------------------

# Fixed parameters of the stand-in sentiment scorer (not a real lexicon).
POSITIVE_WORDS = ["good", "great", "best", "love", "excellent", "wonderful", "enjoy", "brilliant", "fun", "and"]
NEGATIVE_WORDS = ["bad", "worst", "awful", "boring", "terrible", "poor", "waste", "hate", "dull", "the"]


def _variants(spark, d):
    c = C.corpus(spark, d)
    c = SP.split_train_test(c, "doc_id", 0.9, seed=42)
    return c.select("doc_id", "split", "genre",
                    F.when(F.split(F.lower("review_type"), " ").getItem(0) == "negative", 0).otherwise(1).alias("label"),
                    T.strip_lower("text").alias("raw_text"),
                    T.clean_non_ascii(T.strip_lower("text")).alias("raw_text_cleaned"),
                    T.join_tokens(T.clean_doc("text")).alias("processed_text"))


_VARIANTS_SQL = "WITH " + S.CORPUS_CTE + f""",
v AS (SELECT doc_id, genre,
        CASE WHEN substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8) < 'e6666666' THEN 'train' ELSE 'test' END AS split,
        CASE WHEN split_part(lower(review_type), ' ', 1) = 'negative' THEN 0 ELSE 1 END AS label,
        {S.strip_lower('text')} AS raw_text,
        {S.clean_non_ascii(S.strip_lower('text'))} AS raw_text_cleaned,
        {S.join_tokens(S.clean_doc('text'))} AS processed_text FROM corpus),
long AS (SELECT doc_id, genre, label, 'raw_text' AS variant, raw_text AS t FROM v WHERE split = 'test'
   UNION ALL SELECT doc_id, genre, label, 'raw_text_cleaned', raw_text_cleaned FROM v WHERE split = 'test'
   UNION ALL SELECT doc_id, genre, label, 'processed_text', processed_text FROM v WHERE split = 'test'),
tk AS (SELECT *, list_filter(string_split(lower(regexp_replace(t, '[^a-zA-Z]+', ' ', 'g')), ' '), lambda w: w <> '') AS toks FROM long) """


def _long_variants(spark, d):
    v = _variants(spark, d).where("split = 'test'")
    cols = ["raw_text", "raw_text_cleaned", "processed_text"]
    return v.select("doc_id", "genre", "label", F.explode(F.array(*[
        F.struct(F.lit(c).alias("variant"), F.col(c).alias("t")) for c in cols])).alias("x")).select(
        "doc_id", "genre", "label", "x.variant", "x.t")


@register("score_sentiment", _VARIANTS_SQL + f"""
SELECT variant, round(avg(CASE WHEN (CASE WHEN len(list_filter(toks, lambda w: list_contains({S.list_lit(NEGATIVE_WORDS)}, w)))
      > len(list_filter(toks, lambda w: list_contains({S.list_lit(POSITIVE_WORDS)}, w))) THEN 0 ELSE 1 END) = label
      THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM tk GROUP BY variant""")
def score_sentiment(spark, d):
    v = _long_variants(spark, d)
    scored = CL.score_texts(v, "t", CL.wordlist_sentiment(POSITIVE_WORDS, NEGATIVE_WORDS))
    scored = scored.withColumn("pred", CL.sentiment_code("prediction.label"))
    return (scored.groupBy("variant")
            .agg(F.round(F.avg(M.correct("label", "pred")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n")))


@register("score_genre", _VARIANTS_SQL + """, cls AS (SELECT list(DISTINCT genre ORDER BY genre) AS names FROM corpus)
SELECT variant, round(avg(CASE WHEN (SELECT names FROM cls)[len(toks) % 4 + 1] = genre THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       count(*) AS n FROM tk GROUP BY variant""")
def score_genre(spark, d):
    v = _long_variants(spark, d)
    mapping = SP.label_index(C.corpus(spark, d).select(F.col("genre").alias("label")), "label")
    scored = CL.score_texts(v, "t", CL.token_count_labels(len(C.genres(spark, d))))
    scored = scored.withColumn("pred_index", CL.label_number("prediction.label"))
    scored = SP.decode_labels(scored, "pred_index", mapping, out="pred")
    return (scored.groupBy("variant")
            .agg(F.round(F.avg(M.correct("genre", "pred")), 6).alias("accuracy"), F.count(F.lit(1)).alias("n")))
