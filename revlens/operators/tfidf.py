"""TF-IDF in long form ``(doc_id, term, score)`` and the statistics around it.

The document-term matrix is never widened: the long table holds only non-zero
cells, so "means over documents" divide a sum by the document count instead of
averaging the present rows.  Scalars (document counts) enter the plan as
scalar subqueries, so nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as BL


def n_docs(docs: DataFrame):
    """Number of documents as a scalar-subquery Column (includes empty documents)."""
    return docs.select(F.count(F.lit(1))).scalar()


def document_frequency(bow: DataFrame) -> DataFrame:
    """``(term, df)``: documents per term (``bow`` holds one row per (doc, term))."""
    return bow.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def idf_table(bow: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, idf)`` with smoothed idf ln((1+n)/(1+df)) + 1."""
    n = n_docs(docs)
    return (document_frequency(bow)
            .select("term", (F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1).alias("idf")))


def tfidf(bow: DataFrame, docs: DataFrame) -> DataFrame:
    """Raw count x smoothed idf, no normalisation.

    Reads ``bow`` three times, so it should be a written table.
    """
    counts = BL.written(document_frequency(bow), "document_frequency")
    idf = counts.select("term", (F.log((F.lit(1) + n_docs(docs)) / (F.lit(1) + F.col("df"))) + 1).alias("idf"))
    return BL.joined(bow, idf, "term", counts, "df").select("doc_id", "term", (F.col("n") * F.col("idf")).alias("score"))


def l2_normalize(scores: DataFrame) -> DataFrame:
    """Divide each document's scores by its L2 norm (window over one document)."""
    w = Window.partitionBy("doc_id")
    norm = F.sqrt(F.sum(F.col("score") * F.col("score")).over(w))
    return scores.withColumn("score", F.col("score") / norm)


def vocabulary_cap(bow: DataFrame, max_features: int) -> DataFrame:
    """``(term, total)``: the ``max_features`` terms with the largest corpus count
    (ties by term).  A global top-k: each task keeps only its local top-k."""
    tot = bow.groupBy("term").agg(F.sum("n").alias("total"))
    return tot.orderBy(F.desc("total"), F.asc("term")).limit(max_features)


def tfidf_l2(train_bow: DataFrame, train_docs: DataFrame, apply_bow: DataFrame,
             max_features: int | None = 4000) -> DataFrame:
    """Smoothed TF-IDF fitted on ``train_*`` (vocabulary cap and idf), applied to
    ``apply_bow`` and L2-normalised per document over the kept terms."""
    idf = idf_table(train_bow, train_docs)
    if max_features is not None:
        vocab = vocabulary_cap(train_bow, max_features).select("term")
        idf = idf.join(vocab, "term", "left_semi")
    raw = (apply_bow.join(idf, "term")
           .select("doc_id", "term", (F.col("n") * F.col("idf")).alias("score")))
    return l2_normalize(raw)


def mean_by_term(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, mean_score)``: mean over *all* documents (absent cells are zeros)."""
    n = n_docs(docs)
    return scores.groupBy("term").agg((F.sum("score") / n).alias("mean_score"))


def term_stats(bow: DataFrame, docs: DataFrame) -> DataFrame:
    """``(term, df, total, idf, mean_score)`` straight from the counts.

    idf is constant per term, so the sum of a term's TF-IDF over documents is
    idf x (its total count): the mean needs one aggregation by term and no join
    of the scores back to the bag of words.
    """
    n = n_docs(docs)
    g = bow.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("n").alias("total"))
    idf = F.log((F.lit(1) + n) / (F.lit(1) + F.col("df"))) + 1
    return (g.withColumn("idf", idf)
            .withColumn("mean_score", F.col("total") * F.col("idf") / n))


def top_mean_terms(scores: DataFrame, docs: DataFrame, k: int = 10) -> DataFrame:
    return mean_by_term(scores, docs).orderBy(F.desc("mean_score"), F.asc("term")).limit(k)


def prevalent_terms(scores: DataFrame, docs: DataFrame, terms, k: int = 10,
                    digits: int = 2) -> DataFrame:
    """Means of a chosen term list (terms missing from the vocabulary are
    dropped), top ``k``, rounded half-to-even to ``digits`` places."""
    spark = scores.sparkSession
    chosen = spark.createDataFrame([(t,) for t in terms], "term string")
    means = mean_by_term(scores.join(chosen, "term", "left_semi"), docs)
    return (means.orderBy(F.desc("mean_score"), F.asc("term")).limit(k)
            .select("term", F.bround("mean_score", digits).alias("mean_score")))


def corpus_stats(scores: DataFrame, docs: DataFrame) -> DataFrame:
    """Document count, vocabulary size and the mean of the per-term means."""
    n = n_docs(docs)
    return scores.agg(
        n.alias("n_docs"),
        F.countDistinct("term").alias("vocab_size"),
        (F.sum("score") / (n * F.countDistinct("term"))).alias("mean_mean"))


def score_histogram(values: DataFrame, col: str, bins: int = 100,
                    lo: float = 0.0, hi: float = 8.0) -> DataFrame:
    """``(bin, n)``: equal-width bins on [lo, hi]; values outside are dropped and
    ``hi`` itself falls in the last bin."""
    v = F.col(col)
    b = F.least(F.width_bucket(v, F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    return (values.where(v.between(lo, hi)).select(b.cast("bigint").alias("bin"))
            .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))


def top_terms_per_document(scores: DataFrame, k: int | None = None) -> DataFrame:
    """Terms of each document by score desc (term asc on ties), with rank."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), F.asc("term"))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def term_subset(scores: DataFrame, terms: DataFrame) -> DataFrame:
    """Rows of the chosen terms that exist in the vocabulary (semi join)."""
    t = terms.select(F.col(terms.columns[0]).alias("term"))
    return scores.join(t, "term", "left_semi")
