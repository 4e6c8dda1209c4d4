"""Writers for TF-IDF results: per-document term-score files and the vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_term_scores(scores: DataFrame, path: str, key: str = "doc_id") -> None:
    """CSV files of ``key, term, score`` by document and score, highest first.

    Rows are clustered by document with a hash repartition and sorted within
    partitions, so a document's rows stand together in one file; no folder per
    document, and at most a million rows per file.
    """
    (scores.repartition(key).sortWithinPartitions(key, F.desc("score"), F.asc("term"))
     .select(key, "term", "score")
     .write.mode("overwrite").option("header", True).option("maxRecordsPerFile", 1_000_000).csv(path))


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """Sorted distinct terms, one per line (a global sort: range partitioned)."""
    (terms.select("term").distinct().orderBy("term")
     .write.mode("overwrite").text(path))
