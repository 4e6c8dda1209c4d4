"""Row-wise cleaning on a stream of incoming reviews.

The cleaning builders are stateless Column expressions, so the same code runs
on a streaming DataFrame: new files in a folder are cleaned as they arrive and
appended to a sink, with progress in a checkpoint folder (exactly-once file
sink, restartable after failure).  Operators that need the whole corpus (IDF,
vocabulary maps) stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import text as T

DOC_SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])


def clean_stream(spark: SparkSession, source_dir: str, schema: StructType = DOC_SCHEMA,
                 fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of ``(doc_id, processed_text, n_tokens)``."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.load(source_dir)
    toks = T.clean_doc(F.coalesce(F.col("text"), F.lit("")))
    return src.select("doc_id", T.join_tokens(toks).alias("processed_text"),
                      F.size(toks).cast("bigint").alias("n_tokens"))


def run_available(stream: DataFrame, sink_dir: str, checkpoint: str, fmt: str = "parquet"):
    """Process everything available now into a file sink and stop."""
    q = (stream.writeStream.format(fmt).option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
