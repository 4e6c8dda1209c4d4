"""Deterministic key-hash splits and label encoding.

A split is a pure function of (seed, key): no shuffle, stable under
repartitioning and recomputation after executor loss (``randomSplit`` is not).
Sizes are approximate (each row independently lands below a cut point).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cut_point(fraction: float) -> str:
    """The 8-hex-digit threshold below which ``fraction`` of hashes fall."""
    return format(min(int(fraction * 2 ** 32), 2 ** 32 - 1), "08x")


def hash_key(key: str, seed) -> Column:
    return F.substring(F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string"))), 1, 8)


def split_train_test(df: DataFrame, key: str = "doc_id", train: float = 0.8, seed=1) -> DataFrame:
    h = hash_key(key, seed)
    return df.withColumn("split", F.when(h < cut_point(train), "train").otherwise("test"))


def split_train_val_test(df: DataFrame, key: str = "doc_id", train: float = 0.8,
                         val: float = 0.1, seed=12) -> DataFrame:
    """Three parts; the arguments are honoured (cuts at train and train+val)."""
    h = hash_key(key, seed)
    return df.withColumn("split", F.when(h < cut_point(train), "train")
                         .when(h < cut_point(train + val), "val").otherwise("test"))


def label_index(labels: DataFrame, label: str) -> DataFrame:
    """``(label, index)``: distinct class names sorted ascending -> 0..k-1.

    The window runs over the *distinct* labels only (k rows), never raw rows.
    """
    d = labels.select(F.col(label).alias("label")).where(F.col("label").isNotNull()).distinct()
    return d.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("index"))


def encode_labels(df: DataFrame, label: str, mapping: DataFrame, out: str = "label_index") -> DataFrame:
    """Attach the index of ``label`` from a mapping fitted once (never refitted)."""
    m = mapping.select(F.col("label").alias(label), F.col("index").alias(out))
    return df.join(m, label, "left")


def decode_labels(df: DataFrame, index: str, mapping: DataFrame, out: str = "label") -> DataFrame:
    m = mapping.select(F.col("index").alias(index), F.col("label").alias(out))
    return df.join(m, index, "left")
