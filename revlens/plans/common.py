"""Shared inputs of the registered queries (all derived from the given tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.blocks import settled, shuffles_freed, temporary, written
from ..sources import fixtures


def docs(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.documents(spark, d)


def doc_rows(spark: SparkSession, d: str) -> DataFrame:
    """The documents as scanned (for counting: Parquet answers from metadata,
    without the balancing exchange)."""
    return fixtures.load_table(spark, d, "documents").select("doc_id")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.corpus(spark, d)


def plain_tokens(spark: SparkSession, d: str) -> DataFrame:
    """normalise -> tokenise -> stop words (the SQL-checkable cleaning chain)."""
    return docs(spark, d).select(
        "doc_id", T.remove_stop_words(T.tokenize_words(T.normalize_text(F.col("text")))).alias("tokens"))


def plain_bow(spark: SparkSession, d: str) -> DataFrame:
    """Bag of words of the plain chain; stop words are filtered after the
    explode (a codegen'd hash-set test instead of a per-array lambda).

    The texts are dealt by document, so the counts need no shuffle of their own:
    a text is several times smaller than its rows (doc_id, term, n)."""
    return _counts(by_document(spark, fixtures.load_table(spark, d, "documents").select("doc_id", "text")))


def by_document(spark: SparkSession, table: DataFrame) -> DataFrame:
    """Rows with a text, dealt by doc_id to as many partitions as a shuffle has."""
    return table.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def docs_by_document(spark: SparkSession, d: str) -> DataFrame:
    """``docs`` dealt by document, for counts by (doc_id, word)."""
    texts = fixtures.load_table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return by_document(spark, texts)


def plain_occurrences(texts: DataFrame) -> DataFrame:
    """(doc_id, term), one row per word of the plain chain."""
    toks = texts.select("doc_id", T.tokenize_words(T.normalize_text(F.coalesce("text", F.lit("")))).alias("t"))
    return T.explode_rows(toks, ["doc_id"], F.col("t"), "term").where(T.not_stop_word(F.col("term")))


def _counts(texts: DataFrame) -> DataFrame:
    return plain_occurrences(texts).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def plain_bow_table(spark: SparkSession, d: str) -> DataFrame:
    """``plain_bow`` written once, for plans that read it several times."""
    return written(plain_bow(spark, d), "bow")


def plain_bow_of(spark: SparkSession, d: str, terms: DataFrame) -> DataFrame:
    """``plain_bow`` of a few terms (a broadcast column ``term``): other words are
    dropped before anything is counted or shuffled."""
    occ = plain_occurrences(docs(spark, d)).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    return occ.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def target_ids(spark: SparkSession, d: str) -> DataFrame:
    """The target list: the first review (lowest id) of every title, as descriptors."""
    c = corpus(spark, d)
    first = c.groupBy("title").agg(F.min("doc_id").alias("doc_id"))
    return c.join(first.select("doc_id"), "doc_id", "left_semi").select("descriptor")


from ..session import materialize  # noqa: E402,F401


def fitted(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """The table ``build()`` of a fitted model, written to the shared checkpoint
    folder once per application and state of the documents; the queries that
    report on one model read the same table."""
    import hashlib
    from ..session import checkpoint_dir, scratch_path
    checkpoint_dir(spark)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    source = paths(f"{d.rstrip('/')}/documents.parquet")
    status = source.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(source)
    state = f"{d}:{status.getModificationTime()}:{status.getLen()}"
    path = scratch_path(spark, f"fit-{spark.sparkContext.applicationId}-{name}-{hashlib.md5(state.encode()).hexdigest()}")
    done = paths(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        with temporary(spark), shuffles_freed(spark):
            build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def genres(spark: SparkSession, d: str) -> list[str]:
    """The class axis: the distinct genres, sorted (k names)."""
    from ..operators.split import label_index
    docs = fixtures.load_table(spark, d, "documents").select(F.col("lang").alias("label"))
    return [r["label"] for r in label_index(docs, "label").orderBy("index").collect()]
