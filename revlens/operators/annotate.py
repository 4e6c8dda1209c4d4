"""Token annotations (a parser's output) and named-entity spans.

Annotations are an *input*: any annotator can produce them.  The nested form
``(doc_id, sent_id, tokens array<struct<idx, text, dep, pos>>)`` keeps one
sentence per row so the extractors need no shuffle; ``nest_tokens`` builds it
from a long ``(doc_id, sent_id, idx, text, dep, pos)`` table (one group per
sentence, bounded by the sentence length).

``rule_annotate`` and ``regex_ner`` are deterministic stand-ins for a parser
and an NER model; they exist to drive the extractors on the test tables.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructField, StructType

from ..functions import text as T

# Fixed values of the stand-in annotator: dependency and POS labels by word index
# plus sentence number, so sentences begin anywhere in the cycle.
DEP_CYCLE = ["det", "amod", "compound", "compound", "nsubj", "ROOT", "prep", "agent", "acomp", "punct", "dobj", "nsubj", "pobj"]
POS_CYCLE = ["DET", "ADJ", "NOUN", "NOUN", "NOUN", "VERB", "ADP", "ADP", "ADJ", "PUNCT", "NOUN", "NOUN", "NOUN"]
# Fixed values of the stand-in NER model: entity groups picked by the md5 of the word.
NER_GROUPS = ["PER", "ORG", "LOC", "MISC"]

TOKEN_STRUCT = "struct<idx:int,text:string,dep:string,pos:string>"


def rule_annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """Sentences -> letter-run words -> cyclic dep/pos labels (no shuffle)."""
    deps = T.lit_array(DEP_CYCLE)
    poss = T.lit_array(POS_CYCLE)
    s = T.posexplode_rows(docs, ["doc_id"], T.sentences(F.col(text)), "sent_id", "sentence")
    toks = F.transform(T.words_of("sentence"), lambda w, i: F.struct(
        i.alias("idx"), w.alias("text"),
        F.element_at(deps, (i + F.col("sent_id")) % len(DEP_CYCLE) + 1).alias("dep"),
        F.element_at(poss, (i + F.col("sent_id")) % len(DEP_CYCLE) + 1).alias("pos")))
    return s.select("doc_id", "sent_id", toks.alias("tokens"))


def nest_tokens(long: DataFrame) -> DataFrame:
    """Long annotation rows -> one row per sentence with tokens in idx order."""
    return (long.groupBy("doc_id", "sent_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("idx").cast("int").alias("idx"), "text", "dep", "pos"))).alias("tokens")))


def flatten_tokens(nested: DataFrame) -> DataFrame:
    return T.explode_rows(nested, ["doc_id", "sent_id"], F.col("tokens"), "t").select(
        "doc_id", "sent_id", "t.idx", "t.text", "t.dep", "t.pos")


# --- named entities -----------------------------------------------------------------------

SPAN_SCHEMA = ArrayType(StructType([
    StructField("entity_group", StringType()), StructField("score", FloatType()),
    StructField("word", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

_CAP = re.compile(r"[A-Z][a-z]+")


def regex_ner_predict(texts: pd.Series) -> pd.Series:
    """Stand-in NER model: every capitalised word, grouped by its md5."""
    out = []
    for t in texts:
        spans = []
        for m in _CAP.finditer(t or ""):
            w = m.group(0)
            g = NER_GROUPS[int(hashlib.md5(w.encode()).hexdigest()[0], 16) % 4]
            spans.append({"entity_group": g, "score": 0.99, "word": w, "start": m.start(), "end": m.end()})
        out.append(spans)
    return pd.Series(out)


#: Characters of text that a model is given at a time (one longer text stays whole): its
#: spans are Python objects, some twenty times as large as the text, until they are Arrow.
MODEL_CHARS = 1 << 18


def _text_slices(texts: pd.Series, most: int) -> Iterator[pd.Series]:
    lo, size = 0, 0
    for i, n in enumerate(texts.str.len().fillna(0).astype(int)):
        if size and size + n > most:
            yield texts.iloc[lo:i]
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield texts.iloc[lo:]


def extract_ner(df: DataFrame, text: str, predict_fn=regex_ner_predict) -> DataFrame:
    """Apply an NER model (``pd.Series[str] -> pd.Series[list[dict]]``) to slices of
    the Arrow batches; adds ``spans array<struct<entity_group, score, word, start, end>>``.
    A task's memory depends on ``MODEL_CHARS``, not on the rows of a batch."""
    from ..session import ship_package
    ship_package(df.sparkSession)
    most = MODEL_CHARS

    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for part in _text_slices(texts, most):
                yield predict_fn(part)
    udf = F.pandas_udf(predict, SPAN_SCHEMA)
    return df.withColumn("spans", udf(F.col(text)))


def flatten_ner(df: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Nested spans -> rows ``entity, type, score, start, end``."""
    return (T.posexplode_rows(df, list(keys), F.col("spans"), "span_id", "s")
            .select(*keys, "span_id", F.col("s.word").alias("entity"), F.col("s.entity_group").alias("type"),
                    F.col("s.score").alias("score"), F.col("s.start").alias("start"), F.col("s.end").alias("end")))


def last_per_key(df: DataFrame, key: str, order: list) -> DataFrame:
    """Keep only the last row per key by ``order`` (a later review overwrites)."""
    from pyspark.sql import Window
    w = Window.partitionBy(key).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
