"""A cleaning pipeline over ``documents``: five stages, each one operator.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and
returns them, the last one the token ids.  Extra columns are dropped at the
first stage; null and empty texts, repeated rows and missing ids follow the
rules in each operator's docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.byte_bpe import encode
from revlens.llm.common import Scratch
from revlens.llm.language_id import identify
from revlens.llm.line_dedup import remove_boilerplate
from revlens.llm.mixing import mix
from revlens.llm.ngram_join import jaccard_components

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _matched(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with ``rows`` (id, key, ...) on doc_id and text, nulls equal."""
    keyed = docs.select(*COLUMNS).withColumn("text_key", F.xxhash64("text"))
    return keyed.join(rows, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), how)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; ``lang`` becomes that language."""
    docs = docs.select(*COLUMNS)
    s = Scratch(spark, "pipeline-language")
    # the key stands in for the id: the operator carries it through as it is
    keyed = docs.withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("key"), "source", "lang"))
    told = identify(keyed, labels="lang", host="source", declared="lang", doc_id="row")
    changed = told.where(~F.col("accepted") | ~F.col("language").eqNullSafe(F.col("declared")))
    changed = s.write(changed.select("doc_id.*", "language", "accepted").distinct(), "changed")
    changed = changed.select(F.col("doc_id").alias("id"), "key", F.col("source").alias("at"), F.col("lang").alias("said"), "language", "accepted")
    same = (F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key"))
            & F.col("source").eqNullSafe(F.col("at")) & F.col("lang").eqNullSafe(F.col("said")))
    out = docs.join(changed, same, "left").where(F.coalesce("accepted", F.lit(True)))
    return out.withColumn("lang", F.coalesce("language", "lang")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats of lines that stand on many sources go; ``n_chars`` is that of the text left."""
    out = remove_boilerplate(docs.select(*COLUMNS), min_sites=10, keep=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", size).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by 5-word shingle sets of similarity 0.8 or more, the one with the smallest doc_id stays.

    Of equal doc_ids the smaller text hash stays, and a row without doc_id only
    where no other one is in the group.  Rows that agree in doc_id and text are
    one document: of those the smallest lang, source and n_chars stays.
    """
    docs = docs.select(*COLUMNS)
    s = Scratch(spark, "pipeline-near")
    groups = s.write(jaccard_components(docs, k=5, num=4, den=5, keys=True)
                     .select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "component_id", "component_key"), "groups")
    stays = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("key") == F.col("component_key"))
    gone = s.write(groups.where(~stays).select("id", "key").distinct(), "gone")
    left = _matched(docs, gone, "left_anti")
    again = s.write(groups.where(stays).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "again")
    if not again.head(1):
        return left.select(*COLUMNS)
    least = F.min(F.struct("lang", "source", "n_chars", "text")).alias("least")
    one = _matched(docs, again, "left_semi").groupBy("doc_id", "text_key").agg(least).select("doc_id", "least.*")
    others = left.join(again, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_anti")
    return others.select(*COLUMNS).union(one.select(*COLUMNS))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at target weights: every document once, those of smaller sources up to twice."""
    docs = docs.select(*COLUMNS)
    s = Scratch(spark, "pipeline-mix")
    seen = mix(docs, max_repeats=2.0)
    again = seen.groupBy("source", "doc_id", "text_key").agg(F.max("epoch").alias("times")).where("times > 1")
    again = s.write(again.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), F.col("source").alias("at"), "times"), "again")
    same = (F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key")) & F.col("source").eqNullSafe(F.col("at")))
    out = docs.join(again, same, "left")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1))))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, lang, source, n_tokens, ids."""
    import public_tokenizers
    out = encode(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates),
          ("temperature_mixing", mixing), ("byte_bpe", tokens)]

#: Likelihood models, graph components and merges are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the output of each is written to the shared folder and read again."""
    s = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = s.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
