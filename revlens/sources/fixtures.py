"""Loaders for the parquet test tables and their mapping onto the review schema.

Mapping (see FIXTURES.md): ``documents.doc_id/text`` are the review id and
text, ``lang`` plays the genre (4 classes), ``source`` the movie title and
``labels.quality`` the review type (1 Positive, 0 Negative, no label null).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relational import with_descriptor

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread a scan over the cluster when it yields too few splits.

    Text work is per row and CPU-bound, so a file written as one row group
    (one split) would run on one core.  Only then is the table hash-partitioned
    on ``key`` (deterministic, so a lost task recomputes the same rows); a large
    input already yields at least ``defaultParallelism`` splits and is left as
    it is - no shuffle of the raw text.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        return df
    return df.repartition(target, key)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, text)`` with a null text read as empty (never the token 'nan')."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    return balanced(docs, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review corpus in the reference's shape, with the descriptor.

    ``labels`` is joined on its unique key ``doc_id`` (a left outer join:
    an unlabeled review keeps a null review type).  Both sides grow with the
    data, so this is a plain shuffle/sort-merge join on a unique key - no skew.
    """
    docs = balanced(load_table(spark, sf_dir, "documents"), "doc_id")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality")
    review = (F.when(F.col("quality") == 1, F.lit("Positive"))
              .when(F.col("quality") == 0, F.lit("Negative")))
    df = (docs.join(labels, "doc_id", "left")
          .select("doc_id",
                  F.coalesce("text", F.lit("")).alias("text"),
                  F.col("lang").alias("genre"),
                  F.col("source").alias("title"),
                  review.alias("review_type")))
    return with_descriptor(df)
