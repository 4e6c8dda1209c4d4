"""The class-corpus CSV reader and writer (the reference's own input format)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.relational import with_descriptor

# Column names of the corpus file (fixed values) and our names for them.
CSV_COLUMNS = [
    ("Doc_ID", "doc_id", LongType()),
    ("Text", "text", StringType()),
    ("Movie Title", "title", StringType()),
    ("Genre of Movie", "genre", StringType()),
    ("Review Type (pos or neg)", "review_type", StringType()),
    ("DSI_Title", "dsi_title", StringType()),
    ("Submission File Name", "submission_file", StringType()),
]
CSV_SCHEMA = StructType([StructField(src, t) for src, _, t in CSV_COLUMNS])


def read_corpus_csv(spark: SparkSession, path: str, schema: StructType = CSV_SCHEMA) -> DataFrame:
    """Read the UTF-8 corpus CSV (header, quoted multi-line text, doubled quotes)
    with a declared schema, rename to snake_case and add the descriptor.

    No sort: order is applied on output only.  ``multiLine`` files are read one
    file per task, so a corpus should arrive as many files.
    """
    df = (spark.read.schema(schema)
          .option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
          .option("mode", "FAILFAST")
          .csv(path))
    df = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst, _ in CSV_COLUMNS if src in df.columns])
    return with_descriptor(df.withColumn("text", F.coalesce("text", F.lit(""))))


def write_corpus_csv(df: DataFrame, path: str) -> None:
    """Write a corpus in the CSV layout (columns renamed back)."""
    cols = [F.col(dst).alias(src) for src, dst, _ in CSV_COLUMNS if dst in df.columns]
    (df.select(*cols).write.mode("overwrite")
     .option("header", True).option("quote", '"').option("escape", '"').csv(path))
