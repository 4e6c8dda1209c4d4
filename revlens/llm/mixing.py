"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised.
The exponent (1: shares as they are, 0: all sources alike) is bisected until
the weights meet a target entropy or the most repeated source a repetition
limit.  The weights are realised as block permutations: every epoch of a source
is a pass over all its documents, dealt by hash into blocks and shuffled within
them; the last epoch is cut where the source's token budget is used up.

Sources stay a table throughout: one job evaluates a whole grid of exponents,
five bisections at a time.  A block holds about the square root of its source's
documents, so neither a block nor the list of a source's blocks is large.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, only, table

#: Exponents tried in one job, and jobs (32 ** 6 = 2 ** 30 steps).
GRID, ROUNDS = 32, 6


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, text_key, source, tokens): tokens are runs of bytes other than space and 0x09-0x0D."""
    base = only(docs, doc_id=doc_id, text=text, source=source)
    return base.select("doc_id", F.xxhash64("text").alias("text_key"), "source",
                       F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("tokens"))


def source_table(counted: DataFrame) -> DataFrame:
    """(source, docs, tokens, share)."""
    by = counted.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    total = max(by.agg(F.sum("tokens").alias("t")).first()["t"] or 0, 1)
    return by.withColumn("share", F.col("tokens") / total)


def temperature(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = None) -> float:
    """The exponent in [0, 1] nearest to 0 (evenest weights) that keeps to
    ``max_repeats`` (how often the most repeated source is seen while the least
    repeated one is seen once), or the one whose weights have ``entropy`` (in
    nats; 0 or 1 if it is out of reach).  Sources without tokens do not count."""
    if (entropy is None) == (max_repeats is None):
        raise ValueError("give either an entropy or a repetition limit")
    some = sources.where("share > 0").select("share")
    low, high = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        at = some.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
        x = F.lit(low) + F.col("i") * ((high - low) / GRID)
        at = at.withColumn("w", F.pow("share", x)).withColumn("r", F.pow("share", x - 1))
        rows = at.groupBy("i").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.log("w")).alias("wl"),
                                   F.max("r").alias("most"), F.min("r").alias("least")).collect()
        if not rows:
            return 1.0
        if max_repeats is not None:
            good = {r["i"]: r["most"] <= max_repeats * r["least"] for r in rows}
        else:  # entropy falls as the exponent grows
            good = {r["i"]: math.log(r["w"]) - r["wl"] / r["w"] <= entropy for r in rows}
        first = min((i for i in good if good[i]), default=None)
        if first is None:
            return 1.0
        if first == 0:
            return low
        low, high = grid[first - 1], grid[first]
    return high


def weights(sources: DataFrame, exponent: float, budget: float | None = None) -> DataFrame:
    """``sources`` with weight and repeats, the number of passes over a source.

    ``budget`` is the number of tokens of the mixture; None takes the smallest
    one that holds every document at least once.  A source without tokens has
    weight 0 and is passed once.
    """
    w = F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0)
    at = sources.withColumn("w", w)
    sums = at.agg(F.sum("w").alias("w"), F.max(F.when(F.col("w") > 0, F.col("tokens") / F.col("w"))).alias("cover")).first()
    total = sums["w"] or 1.0
    size = budget if budget is not None else (sums["cover"] or 0.0) * total
    at = at.withColumn("weight", F.col("w") / total).drop("w")
    repeats = F.col("weight") * size / F.col("tokens")
    # a pass that is whole but for rounding is whole
    repeats = F.when(F.abs(repeats - F.round(repeats)) < 1e-9, F.round(repeats)).otherwise(repeats)
    return at.withColumn("repeats", F.when(F.col("tokens") > 0, repeats).otherwise(1.0))


def _order(seed: int):
    """Sort key of a document in an epoch."""
    return F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"), F.col("text_key"))


def permutation(counted: DataFrame, planned: DataFrame, seed: int = 0) -> DataFrame:
    """The mixture as rows (doc_id, text_key, source, tokens, epoch, block,
    place, position): every epoch of every document that the plan holds.

    Within an epoch of a source, documents go by block and place; ``position``
    (0 to 1, the share of the source's budget that comes before) interleaves the sources in proportion to their weights.  The last
    epoch of a source ends with the document that reaches its budget.
    """
    s = Scratch(counted.sparkSession, "mixture")
    plan = planned.select(F.col("source").alias("name"), "repeats", F.col("tokens").alias("source_tokens"),
                          F.ceil(F.sqrt("docs")).cast("long").alias("blocks"))
    plan = s.write(plan, "plan")
    docs = counted.join(plan, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    seen = docs.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.greatest(F.ceil("repeats"), F.lit(1)).cast("int"))))
    seen = seen.withColumn("key", _order(seed)).withColumn("block", F.pmod(F.col("key"), F.col("blocks")))
    seen = seen.withColumn("key", F.xxhash64("key", F.lit(1)))
    place = Window.partitionBy("source", "epoch", "block").orderBy("key", "doc_id", "text_key")
    rows = place.rowsBetween(Window.unboundedPreceding, -1)
    seen = s.write(seen.withColumn("place", F.row_number().over(place)).withColumn(
        "before", F.coalesce(F.sum("tokens").over(rows), F.lit(0))), "seen")
    blocks = seen.groupBy("source", "epoch", "block").agg(F.sum("tokens").alias("held"))
    up = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = s.write(blocks.withColumn("start", F.coalesce(F.sum("held").over(up), F.lit(0))).select(
        F.col("source").alias("bs"), F.col("epoch").alias("be"), F.col("block").alias("bb"), "start"), "blocks")
    at = seen.join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("epoch") == F.col("be")) & (F.col("block") == F.col("bb")))
    # rows that agree in source, doc_id and text share their fate
    quota = F.round((F.col("repeats") - F.col("epoch") + 1) * F.col("source_tokens"), 6)
    same = Window.partitionBy("source", "epoch", "block", "doc_id", "text_key")
    at = at.withColumn("before", F.min(F.col("start") + F.col("before")).over(same))
    at = at.where((F.col("epoch") <= F.col("repeats")) | (F.col("before") < quota))
    done = (F.col("epoch") - 1) * F.col("source_tokens") + F.col("before")
    position = F.when(F.col("source_tokens") > 0, done / (F.col("repeats") * F.col("source_tokens"))).otherwise(0.0)
    return at.select("doc_id", "text_key", "source", "tokens", "epoch", F.col("block"), F.col("place"), position.alias("position"))


def mix(docs: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None,
        seed: int = 0, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixture of ``docs`` by source: doc_id, text_key (xxhash64 of the
    text), source, weight, tokens, epoch, block, place, position, one row for
    each time a document is seen.

    With no ``budget`` every document is seen at least once.  Rows without
    source are a source of their own; a null or empty text has no tokens, and a
    source without tokens is passed once; rows without or with equal doc_id are
    documents like any other; an empty table gives none.
    """
    s = Scratch(docs.sparkSession, "mixing")
    counted = s.write(token_counts(docs, doc_id, text, source), "counted")
    sources = s.write(source_table(counted), "sources")
    planned = s.write(weights(sources, temperature(sources, entropy, max_repeats), budget), "planned")
    named = planned.select(F.col("source").alias("name"), "weight")
    out = permutation(counted, planned, seed).join(named, F.col("source").eqNullSafe(F.col("name")))
    return out.select("doc_id", "text_key", "source", "weight", "tokens", "epoch", "block", "place", "position")


def op9_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by source, the most repeated source seen twice while the largest is seen once."""
    return mix(table(spark, sf_dir, "documents"), max_repeats=2.0)


QUERIES = {"op9_temperature_mixing": op9_temperature_mixing}
