"""Registered queries: bags of words, TF-IDF and the statistics built on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tfidf as TF
from ..operators import vocab as V
from . import common as C
from . import sqltext as S
from .catalog_text import CLEAN_MAP_CTE
from .registry import register

# token rows of the SQL-checkable chain: normalise -> tokenise -> stop words
_TOK = f"SELECT doc_id, unnest({S.remove_stop(S.tokenize(S.normalize('text')))}) AS term FROM documents"
BOW_CTE = f"WITH bow AS (SELECT doc_id, term, count(*) AS n FROM ({_TOK}) GROUP BY doc_id, term), " \
          "nd AS (SELECT count(*) AS n_docs FROM documents), " \
          "idf AS (SELECT term, ln((1 + (SELECT n_docs FROM nd)) / (1 + count(*))) + 1 AS idf FROM bow GROUP BY term), " \
          "tfidf AS (SELECT b.doc_id, b.term, b.n * i.idf AS score FROM bow b JOIN idf i ON b.term = i.term), " \
          "means AS (SELECT term, sum(score) / (SELECT n_docs FROM nd) AS mean_score FROM tfidf GROUP BY term) "


def _scores(spark, d):
    docs = C.doc_rows(spark, d)
    return TF.tfidf(C.plain_bow_table(spark, d), docs), docs


def _means(spark, d):
    """Mean TF-IDF per term over all documents, from the counts (no join back)."""
    return TF.term_stats(C.plain_bow(spark, d), C.doc_rows(spark, d))


@register("bag_of_words", BOW_CTE + "SELECT doc_id, term, n FROM bow")
def bag_of_words(spark, d):
    return C.plain_bow(spark, d)


@register("document_frequency", BOW_CTE + "SELECT term, count(*) AS df FROM bow GROUP BY term")
def document_frequency(spark, d):
    return TF.document_frequency(C.plain_bow(spark, d))


@register("tfidf", BOW_CTE + "SELECT doc_id, term, round(score, 6) AS score FROM tfidf")
def tfidf(spark, d):
    s, _ = _scores(spark, d)
    return s.select("doc_id", "term", F.round("score", 6).alias("score"))


@register("mean_by_term", BOW_CTE + "SELECT term, round(mean_score, 6) AS mean_score FROM means")
def mean_by_term(spark, d):
    return _means(spark, d).select("term", F.round("mean_score", 6).alias("mean_score"))


@register("top_mean_tfidf", BOW_CTE + "SELECT term, round(mean_score, 6) AS mean_score FROM means ORDER BY round(mean_score, 9) DESC, term LIMIT 10")
def top_mean_tfidf(spark, d):
    means = _means(spark, d).withColumn("mean_score", F.round("mean_score", 9))
    return means.orderBy(F.desc("mean_score"), F.asc("term")).limit(10).select(
        "term", F.round("mean_score", 6).alias("mean_score"))


# the chosen-term list of the prevalent-terms report (fixed parameter values);
# 'xyzzy' is absent from the vocabulary and must be dropped
PREVALENT = ["film", "best", "actor", "charact", "the", "and", "ci", "de", "la", "xyzzy"]


@register("prevalent_terms", BOW_CTE + f"""
SELECT term, round_even(mean_score, 2) AS mean_score FROM means
WHERE term IN (SELECT unnest({S.list_lit(PREVALENT)}))
ORDER BY mean_score DESC, term LIMIT 10""")
def prevalent_terms(spark, d):
    chosen = spark.createDataFrame([(t,) for t in PREVALENT], "term string")
    means = _means(spark, d).join(chosen, "term", "left_semi")
    return (means.orderBy(F.desc("mean_score"), F.asc("term")).limit(10)
            .select("term", F.bround("mean_score", 2).alias("mean_score")))


@register("term_subset", BOW_CTE + f"""
SELECT doc_id, term, round(score, 6) AS score FROM tfidf WHERE term IN (SELECT unnest({S.list_lit(PREVALENT)}))""")
def term_subset(spark, d):
    terms = spark.createDataFrame([(t,) for t in PREVALENT], "term string")
    # a term's weight depends on its own rows and the number of documents alone
    s = TF.tfidf(C.written(C.plain_bow_of(spark, d, terms), "bow"), C.doc_rows(spark, d))
    return TF.term_subset(s, terms).select("doc_id", "term", F.round("score", 6).alias("score"))


@register("corpus_stats", BOW_CTE + """
SELECT (SELECT n_docs FROM nd) AS n_docs, count(DISTINCT term) AS vocab_size,
       round(sum(score) / ((SELECT n_docs FROM nd) * count(DISTINCT term)), 6) AS mean_mean FROM tfidf""")
def corpus_stats(spark, d):
    docs = C.doc_rows(spark, d)
    m = _means(spark, d)
    n = TF.n_docs(docs)
    out = m.agg(n.alias("n_docs"), F.count(F.lit(1)).alias("vocab_size"),
                (F.sum("mean_score") / F.count(F.lit(1))).alias("mean_mean"))
    return out.select("n_docs", "vocab_size", F.round("mean_mean", 6).alias("mean_mean"))


@register("score_histogram", BOW_CTE + """
SELECT CAST(least(floor(mean_score / 8.0 * 100) + 1, 100) AS BIGINT) AS bin, count(*) AS n
FROM means WHERE mean_score BETWEEN 0 AND 8 GROUP BY 1""")
def score_histogram(spark, d):
    return TF.score_histogram(_means(spark, d), "mean_score", 100, 0.0, 8.0)


@register("top_terms_per_document", BOW_CTE + """
SELECT doc_id, term, round(score, 6) AS score,
       row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM tfidf""")
def top_terms_per_document(spark, d):
    s, _ = _scores(spark, d)
    return TF.top_terms_per_document(s).select("doc_id", "term", F.round("score", 6).alias("score"),
                                               F.col("rank").cast("bigint").alias("rank"))


@register("vocabulary_cap", BOW_CTE + "SELECT term, sum(n) AS total FROM bow GROUP BY term ORDER BY total DESC, term LIMIT 4000")
def vocabulary_cap(spark, d):
    return TF.vocabulary_cap(C.plain_bow(spark, d), 4000).select("term", F.col("total").cast("bigint").alias("total"))


@register("most_common", BOW_CTE + "SELECT term, sum(n) AS total FROM bow GROUP BY term ORDER BY total DESC, term LIMIT 10")
def most_common(spark, d):
    return TF.vocabulary_cap(C.plain_bow(spark, d), 10).select("term", F.col("total").cast("bigint").alias("total"))


_CLEAN_BOW = CLEAN_MAP_CTE + f""", cbow AS (SELECT o.doc_id, m.term, count(*) AS n
  FROM (SELECT doc_id, unnest({S.tokenize(S.normalize("coalesce(text, '')"))}) AS token FROM documents) o
  JOIN clean_map m ON m.token = o.token WHERE m.term IS NOT NULL GROUP BY o.doc_id, m.term)"""


@register("clean_bag_of_words", _CLEAN_BOW + " SELECT doc_id, term, n FROM cbow")
def clean_bag_of_words(spark, d):
    """Bag of words of the full cleaning chain (lemma + stop words + Porter stem)."""
    return V.clean_bag_of_words(C.docs_by_document(spark, d))


@register("tfidf_clean", _CLEAN_BOW + """, cidf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM cbow GROUP BY term)
SELECT b.doc_id, b.term, round(b.n * i.idf, 6) AS score FROM cbow b JOIN cidf i ON b.term = i.term""")
def tfidf_clean(spark, d):
    """The reference's TF-IDF input: full cleaning chain, then smoothed TF-IDF."""
    docs = C.docs(spark, d)
    # the scores and the document frequencies read the bag: written once
    s = TF.tfidf(C.written(V.clean_bag_of_words(C.docs_by_document(spark, d)), "bow"), docs)
    return s.select("doc_id", "term", F.round("score", 6).alias("score"))
