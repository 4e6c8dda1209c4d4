"""Classifiers: relational multinomial Naive Bayes, MLlib models, scoring hooks.

Naive Bayes is written as joins and aggregations so it scales with the
corpus: the model is a ``(label, term, weight)`` table bounded by
classes x capped vocabulary, and scoring is one join on ``term`` plus a
per-document reduction over the (few) classes.
"""

from __future__ import annotations

import re
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType


def sk_tokens(c):
    """Word tokens of the common vectoriser default: lower-cased runs of two or
    more letters/digits/underscores."""
    col = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(F.lower(col), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


# --- multinomial Naive Bayes (relational) -----------------------------------------

def fit_naive_bayes(train_x: DataFrame, train_y: DataFrame, vocab_size, alpha: float = 1.0):
    """Fit on features ``(doc_id, term, score)`` and labels ``(doc_id, label)``.

    Returns ``(weights, classes)``:
    - weights ``(term, label, w)`` with w = ln(fc + alpha) - ln(alpha), only for
      (class, term) cells with a non-zero feature count;
    - classes ``(label, prior, logden)`` with the unsmoothed log prior and
      ln(total_c + alpha * vocab_size).
    ``vocab_size`` may be a number or a scalar Column.
    """
    fc = (train_x.join(train_y, "doc_id")
          .groupBy("label", "term").agg(F.sum("score").alias("fc")))
    weights = fc.select("term", "label", (F.log(F.col("fc") + alpha) - F.log(F.lit(alpha))).alias("w"))
    from pyspark.sql import Window
    totals = fc.groupBy("label").agg(F.sum("fc").alias("total"))
    counts = train_y.groupBy("label").agg(F.count(F.lit(1)).alias("cnt"))
    # the class table has k rows: its total is a window over those k rows
    n = F.sum("cnt").over(Window.partitionBy())
    classes = (counts.join(totals, "label", "left")
               .select("label", F.log(F.col("cnt") / n).alias("prior"),
                       F.log(F.coalesce(F.col("total"), F.lit(0.0)) + F.lit(alpha) * vocab_size).alias("logden")))
    return weights, classes


def predict_naive_bayes(test_x: DataFrame, test_ids: DataFrame, weights: DataFrame,
                        classes: DataFrame, alpha: float = 1.0) -> DataFrame:
    """``(doc_id, pred, log_score)``: argmax over classes (ties -> smaller label).

    score(d, c) = prior_c + X_d (ln alpha - logden_c) + sum_t x_dt w_ct, where
    X_d is the document's feature sum.  The class table (k rows) enters as a
    scalar array; the weight table is bounded by classes x vocabulary.
    """
    sparse = (test_x.join(weights, "term")
              .groupBy("doc_id", "label").agg(F.sum(F.col("score") * F.col("w")).alias("s"))
              .groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "s"))).alias("sp")))
    xsum = test_x.groupBy("doc_id").agg(F.sum("score").alias("X"))
    # the k classes as one array attached to every document through a
    # constant-key broadcast join (one row, bounded by the number of classes)
    cls = (classes.agg(F.sort_array(F.collect_list(F.struct("label", "prior", "logden"))).alias("cls"))
           .withColumn("_one", F.lit(1)))
    la = float(__import__("math").log(alpha))
    docs = (test_ids.select("doc_id").join(xsum, "doc_id", "left").join(sparse, "doc_id", "left")
            .select("doc_id", F.coalesce("X", F.lit(0.0)).alias("X"), "sp", F.lit(1).alias("_one"))
            .join(F.broadcast(cls), "_one"))
    scored = docs.select("doc_id", F.transform("cls", lambda c: F.struct(
        (c["prior"] + F.col("X") * (F.lit(la) - c["logden"])
         + F.coalesce(F.try_element_at(F.col("sp"), c["label"]), F.lit(0.0))).alias("score"),
        c["label"].alias("label"))).alias("cs"))
    best = F.aggregate("cs", F.col("cs")[0], lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))
    return scored.select("doc_id", best["label"].alias("pred"), best["score"].alias("log_score"))


# --- MLlib models (rows-only checks) -------------------------------------------------

def text_features(train: DataFrame, max_features: int = 4000, text: str = "text"):
    """TF-IDF of the token column ``_tok``, fitted on the texts of ``train`` as an
    ML pipeline, cell for cell that of ``tfidf.tfidf_l2``: the ``max_features`` most counted terms (ties in term
    order), idf = ln((1 + n) / (1 + df)) + 1, rows of length 1."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
    from pyspark.ml.linalg import Vectors
    tokens = train.select("doc_id", F.explode_outer(sk_tokens(text)).alias("term")).where("term is not null")
    bow = tokens.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    kept = (bow.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("df"))
            .orderBy(F.desc("n"), "term").limit(max_features).collect())  # the vocabulary: max_features rows
    n = train.count()
    import math
    idf = [math.log((1 + n) / (1 + r["df"])) + 1 for r in kept]
    counts = CountVectorizerModel.from_vocabulary([r["term"] for r in kept], inputCol="_tok", outputCol="_tf")
    return PipelineModel([counts,
                          ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_idf"),
                          Normalizer(inputCol="_idf", outputCol="features", p=2.0)])


def linear_svm(train: DataFrame, test: DataFrame, label_col: str = "label_index",
               C: float = 1.0, max_iter: int = 2000, tol: float = 1e-3):
    """One-vs-rest linear SVMs on TF-IDF features as they are (no
    standardisation); regParam = 1 / (C n).  Fails if a class has not converged
    within ``max_iter`` steps."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LinearSVC, OneVsRestModel
    train, test = (df.withColumn("_tok", sk_tokens("text")) for df in (train, test))
    feats = text_features(train)
    # the solver reads the training features once per step and class: kept for the fit only
    x = feats.transform(train).select(label_col, "features").persist()
    n = x.count()
    models = []
    for index in sorted(r[0] for r in x.select(label_col).distinct().collect()):
        one = x.select("features", F.when(F.col(label_col) == index, 1.0).otherwise(0.0).alias(label_col))
        model = LinearSVC(regParam=1.0 / (C * max(n, 1)), maxIter=max_iter, tol=tol, standardization=False,
                          labelCol=label_col).fit(one)
        if model.summary().totalIterations >= max_iter:
            raise RuntimeError(f"class {index:g} did not converge in {max_iter} steps")
        models.append(model)
    x.unpersist()
    ovr = OneVsRestModel(models).setFeaturesCol("features").setPredictionCol("prediction")
    model = PipelineModel(stages=[feats, ovr])
    return model, model.transform(test)


def mlp_classifier(train: DataFrame, test: DataFrame, layers: list[int], label_col: str = "label_index",
                   features_col: str = "features", max_iter: int = 300, seed: int = 1):
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    mlp = MultilayerPerceptronClassifier(layers=layers, labelCol=label_col, featuresCol=features_col,
                                         maxIter=max_iter, seed=seed)
    x = train.select(label_col, features_col).persist()
    model = mlp.fit(x)
    x.unpersist()
    return model, model.transform(test)


# --- batch scoring hooks -----------------------------------------------------------------

SCORE_SCHEMA = StructType([StructField("label", StringType()), StructField("score", DoubleType())])


def score_texts(df: DataFrame, text_col: str, predict_fn: Callable[[pd.Series], pd.DataFrame],
                out: str = "prediction") -> DataFrame:
    """Apply a user model to a text column in Arrow batches.

    ``predict_fn`` maps a pandas Series of texts to a DataFrame with columns
    ``label`` (string) and ``score`` (double) - e.g. a wrapped pre-trained
    classifier loaded once per Python worker.  Batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.
    """
    udf = F.pandas_udf(lambda s: predict_fn(s)[["label", "score"]], SCORE_SCHEMA)
    return df.withColumn(out, udf(F.col(text_col)))


def _letters(text: str) -> list[str]:
    return re.sub("[^a-zA-Z]+", " ", text or "").lower().split()


def wordlist_sentiment(positive, negative):
    """Deterministic stand-in for a sentiment model: POSITIVE unless negative
    words outnumber positive ones; score = share of positive hits."""
    pos, neg = set(positive), set(negative)

    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            toks = _letters(t)
            p = sum(1 for w in toks if w in pos)
            n = sum(1 for w in toks if w in neg)
            rows.append(("NEGATIVE" if n > p else "POSITIVE", (p + 1.0) / (p + n + 2.0)))
        return pd.DataFrame(rows, columns=["label", "score"])
    return predict


def token_count_labels(num_labels: int):
    """Deterministic stand-in for an untrained multi-class head:
    ``LABEL_{token count mod k}`` with score 1/k."""
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = [(f"LABEL_{len(_letters(t)) % num_labels}", 1.0 / num_labels) for t in texts]
        return pd.DataFrame(rows, columns=["label", "score"])
    return predict


def sentiment_code(label_col) -> "F.Column":
    """'NEGATIVE' -> 0, anything else -> 1."""
    return F.when(F.col(label_col) == "NEGATIVE", 0).otherwise(1)


def label_number(label_col):
    """``LABEL_3`` -> 3 (the last ``_`` field as an integer)."""
    parts = F.split(F.col(label_col), "_")
    return F.element_at(parts, -1).cast("int")
