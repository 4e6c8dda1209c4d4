"""Registered queries that go through files: CSV corpus, sinks, streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.corpus import read_corpus_csv as _read_csv, write_corpus_csv as _write_csv
from ..sources import sinks
from ..streaming import clean_stream, run_available
from ..operators import tfidf as TF
from . import common as C
from . import sqltext as S
from .registry import register


def _scratch(spark, name):
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("read_corpus_csv", "WITH " + S.CORPUS_CTE + " SELECT doc_id, text, genre, title, review_type, descriptor FROM corpus")
def read_corpus_csv(spark, d):
    """The corpus written in the class-corpus CSV layout and read back with the
    declared schema (multi-line quoted text, column names with spaces)."""
    path = _scratch(spark, "corpus-csv")
    c = C.corpus(spark, d).select("doc_id", "text", "title", "genre", "review_type")
    _write_csv(c.withColumn("dsi_title", F.col("title")).withColumn("submission_file", F.concat(F.col("doc_id").cast("string"), F.lit(".csv"))), path)
    return _read_csv(spark, path).select("doc_id", "text", "genre", "title", "review_type", "descriptor")


_BOW = ("WITH bow AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest("
        + S.remove_stop(S.tokenize(S.normalize("text"))) + ") AS term FROM documents) GROUP BY doc_id, term) ")


@register("write_vocabulary", _BOW + "SELECT DISTINCT term AS value FROM bow")
def write_vocabulary(spark, d):
    """Vocabulary written as a sorted text file, read back."""
    path = _scratch(spark, "vocabulary")
    sinks.write_vocabulary(C.plain_bow(spark, d), path)
    return spark.read.text(path)


@register("write_term_scores", _BOW + """, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM bow GROUP BY term)
SELECT b.doc_id, b.term, round(b.n * i.idf, 6) AS score FROM bow b JOIN idf i ON b.term = i.term""")
def write_term_scores(spark, d):
    """Term scores by submission file written and read back."""
    path = _scratch(spark, "term-scores")
    scores = TF.tfidf(C.plain_bow_table(spark, d), C.doc_rows(spark, d))
    scores = scores.select(F.concat(F.col("doc_id").cast("string"), F.lit(".csv")).alias("submission_file"), "term", "score")
    sinks.write_term_scores(scores, path, key="submission_file")
    back = spark.read.option("header", True).schema("submission_file string, term string, score double").csv(path)
    return back.select(F.regexp_replace("submission_file", "[.]csv$", "").cast("bigint").alias("doc_id"), "term", F.round("score", 6).alias("score"))


@register("stream_clean_doc", "SELECT doc_id, " + S.join_tokens(S.clean_doc("coalesce(text, '')")) + " AS processed_text, "
          "CAST(len(" + S.clean_doc("coalesce(text, '')") + ") AS BIGINT) AS n_tokens FROM documents")
def stream_clean_doc(spark, d):
    """clean_doc on a file stream of the documents table (availableNow trigger)."""
    landing = _scratch(spark, "stream-landing")
    sink, ckpt = _scratch(spark, "stream-sink"), _scratch(spark, "stream-ckpt")
    C.docs(spark, d).write.parquet(landing)
    q = clean_stream(spark, landing)
    run_available(q, sink, ckpt)
    return spark.read.parquet(sink)
