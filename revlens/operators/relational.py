"""Projections, filters, joins, set operations and top-k on the corpus.

Everything here is a plain Catalyst plan: filters and projections are pushed
into the parquet scan, joins are equi-joins that adaptive execution may turn
into broadcasts once the real size of a side is known.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# --- projections ------------------------------------------------------------

def review_code(review: Column) -> Column:
    """'P' when the review type is exactly 'Positive', else 'N' (missing too)."""
    return F.when(review.eqNullSafe("Positive"), F.lit("P")).otherwise(F.lit("N"))


def descriptor_col(genre="genre", title="title", review="review_type", doc_id="doc_id") -> Column:
    """``{genre}_{title}_{P|N}_{doc_id}``; null genre/title give a null descriptor."""
    return F.concat(F.col(genre), F.lit("_"), F.col(title), F.lit("_"),
                    review_code(F.col(review)), F.lit("_"), F.col(doc_id).cast("string"))


def with_descriptor(df: DataFrame) -> DataFrame:
    return df.withColumn("descriptor", descriptor_col())


def to_documents(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "text")


def sentiment_label(review: Column) -> Column:
    """0 when the first word of the lower-cased review type is 'negative', else 1."""
    first = F.split(F.lower(review), " ").getItem(0)
    return F.when(first == "negative", F.lit(0)).otherwise(F.lit(1))


def separate_target(df: DataFrame, target: str) -> DataFrame:
    """Features and target side by side: the target renamed ``target``."""
    return df.withColumnRenamed(target, "target")


# --- filters ---------------------------------------------------------------

def filter_in(df: DataFrame, col: str, keys) -> DataFrame:
    """Rows whose ``col`` is in ``keys`` (a Python list or a one-column DataFrame).

    A short literal list becomes an ``IN`` predicate that reaches the scan; a
    DataFrame of keys becomes a left-semi join (no size assumption).
    """
    if isinstance(keys, DataFrame):
        k = keys.select(F.col(keys.columns[0]).alias(col)).distinct()
        return df.join(k, col, "left_semi")
    return df.where(F.col(col).isin(list(keys)))


def filter_not_in(df: DataFrame, col: str, keys: DataFrame) -> DataFrame:
    k = keys.select(F.col(keys.columns[0]).alias(col)).distinct()
    return df.join(k, col, "left_anti")


def subset_by_value(df: DataFrame, col: str, value) -> tuple[DataFrame, DataFrame]:
    """(rows where col == value, the complement); null counts as 'not equal'."""
    return df.where(F.col(col) == value), df.where(~F.col(col).eqNullSafe(value))


def add_flags(df: DataFrame, flags: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Boolean membership columns; a left join per id set (missing -> False)."""
    out = df
    for name, ids in flags.items():
        k = ids.select(F.col(ids.columns[0]).alias(key)).distinct().withColumn(name, F.lit(True))
        out = out.join(k, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))
    return out


# --- joins -----------------------------------------------------------------

def lookup_join(df: DataFrame, dim: DataFrame, key: str, cols: Iterable[str]) -> DataFrame:
    """Many-to-one lookup that fails on a missing key (like a dict lookup).

    A left join followed by a filter that raises on a null match keeps the check
    inside the plan (no extra count action); a filter, unlike a column, cannot be
    pruned.  ``dim`` is not broadcast blindly: adaptive execution switches to a
    broadcast only if its measured size allows.
    """
    cols = list(cols)
    d = dim.select(F.col(key), *cols, F.lit(True).alias("_found"))
    out = df.join(d, key, "left")
    missing = F.raise_error(F.concat(F.lit(f"lookup_join: missing {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.where(F.when(F.col("_found").isNull(), missing.cast("boolean")).otherwise(True)).drop("_found")


# --- set operations ----------------------------------------------------------

def union_distinct(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out.distinct()


# --- sorts and top-k ---------------------------------------------------------

def top_k(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """Global top-k (TakeOrderedAndProject: a per-partition heap, k rows shuffled)."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int | None,
                    rank_col: str = "rank") -> DataFrame:
    """Rank rows inside each group; keep the first ``k`` (all when k is None).

    Uses a partitioned window; with ``k`` set Spark plans a per-partition
    group-limit before the shuffle, so a hot group never ships all its rows.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(rank_col, F.row_number().over(w))
    return out.where(F.col(rank_col) <= k) if k is not None else out


def slice_rows(df: DataFrame, order: list[Column], start: int, stop: int) -> DataFrame:
    """Rows ``start..stop-1`` by position in ``order`` (like ``df[start:stop]``)."""
    return df.orderBy(*order).offset(start).limit(stop - start)


def profile_table(df: DataFrame) -> DataFrame:
    """Column name, type and non-null count, computed in one aggregation pass."""
    aggs = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    counts = df.agg(*aggs)
    stack_args = ", ".join(f"'{f.name}', '{f.dataType.simpleString()}', {i}, c{i}"
                           for i, f in enumerate(df.schema.fields))
    return counts.selectExpr(
        f"stack({len(df.columns)}, {stack_args}) as (column_name, data_type, position, non_null)")
