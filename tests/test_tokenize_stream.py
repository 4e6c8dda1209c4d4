"""Tokeniser against a plain-Python definition; streaming cleaning equals batch."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from revlens.functions import text as T
from revlens.functions.words import TREEBANK_SPLITS
from revlens.streaming import clean_stream, run_available

WORDS = ["cannot", "gonna", "wanna", "gotta", "lemme", "gimme", "cannotx", "xgonna", "film", "Can", "not", "a"]


def py_tokens(text):
    norm = re.sub("[^a-zA-Z]+", " ", text).lower()
    out = []
    for w in norm.split():
        out.extend(TREEBANK_SPLITS.get(w, (w,)))
    return out


@settings(max_examples=20, deadline=None)
@given(st.lists(st.lists(st.sampled_from(WORDS + [" ", ",", "\n", "1"]), max_size=12).map("".join),
                min_size=1, max_size=4))
def test_tokenizer_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [list(r[0]) for r in df.orderBy("i").select(T.tokenize_words(T.normalize_text("t"))).collect()]
    assert got == [py_tokens(t) for t in texts]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The wonderful films, truly!"), (2, None), (3, "Séance déjà vu naïve")],
                                 "doc_id long, text string")
    landing = str(tmp_path / "landing")
    docs.repartition(2).write.parquet(landing)
    q = clean_stream(spark, landing, max_files_per_trigger=1)
    run_available(q, str(tmp_path / "sink"), str(tmp_path / "ckpt"))
    got = {r["doc_id"]: r["processed_text"] for r in spark.read.parquet(str(tmp_path / "sink")).collect()}
    want = {r[0]: r[1] for r in docs.select("doc_id", T.join_tokens(T.clean_doc(F.coalesce("text", F.lit("")))))
            .collect()}
    assert got == want
