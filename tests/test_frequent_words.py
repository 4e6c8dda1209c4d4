"""Joins with a table of words: frequent words are broadcast, the rest shuffled."""

import math
from collections import Counter

from revlens.operators import blocks as BL
from revlens.operators import tfidf as TF
from revlens.operators import vectors as VE
from revlens.operators import vocab as V


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_frequent_terms_are_not_shuffled_to_their_weights(spark, monkeypatch):
    monkeypatch.setattr(BL, "BROADCAST_ROWS", 10)
    rows = [(d, t, d + 1) for d in range(12) for t in ("the", "of", f"w{d}", f"v{d // 2}")] + [(99, None, 1)]
    bow = BL.written(spark.createDataFrame(rows, "doc_id long, term string, n long"), "bow")
    docs = spark.range(15)
    df = Counter(t for _, t, _ in rows if t)
    want = sorted((d, t, round(n * (math.log(16 / (1 + df[t])) + 1), 9)) for d, t, n in rows if t)
    got = TF.tfidf(bow, docs)
    assert sorted((d, t, round(s, 9)) for d, t, s in got.collect()) == want
    text = plan(got)
    assert "BroadcastHashJoin" in text and "LeftAnti" in text


def test_counts_of_words_need_no_shuffle_of_rows(spark):
    """The texts are dealt by document once; no exchange is keyed by (doc_id, term)."""
    from __spark_entry__ import queries
    text = plan(queries()["bag_of_words"](spark, "/root/testdata/sf0.001"))
    assert "hashpartitioning(doc_id" in text
    assert not any("hashpartitioning(doc_id" in line and "term" in line for line in text.splitlines())


def test_chosen_terms_are_kept_before_the_count(spark):
    from __spark_entry__ import queries
    from revlens.plans import common as C
    terms = spark.createDataFrame([("the",), ("de",)], "term string")
    plan_ = C.plain_bow_of(spark, "/root/testdata/sf0.001", terms)._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.index("Aggregate") < plan_.index("LeftSemi")  # the join lies below the count
    assert queries()["term_subset"](spark, "/root/testdata/sf0.001").count()


def test_margins_are_the_sums_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(VE, "PIECE", 7)  # several pieces a batch
    docs = [(0, ["a", "b", "a", None, "é", "a"]), (1, []), (2, None), (3, ["b"]), (4, ["z", "z", "a", "b", "c", "d", "e", "z"]), (5, ["a", "b"])]
    tokens = spark.createDataFrame(docs, "doc_id long, tokens array<string>").coalesce(1)
    want = Counter()
    for _, t in docs:
        for i, x in enumerate(t or []):
            for j in range(i + 1, min(i + 4, len(t))):
                if x is not None and t[j] is not None:
                    want[x, t[j]] += 1
                    want[t[j], x] += 1
    counts = VE.cooccurrence(tokens, 3)
    assert {(r.word, r.context): r.n for r in counts.collect()} == dict(want)
    sums = Counter()
    for (word, _), n in want.items():
        sums[word] += n
    assert {r.word: r.n_word for r in VE.margins(tokens, 3).collect()} == dict(sums)
    pmi = sorted(tuple(r) for r in VE.shifted_pmi(counts).collect())
    assert pmi == sorted(tuple(r) for r in VE.shifted_pmi(counts, margins=VE.margins(tokens, 3)).collect()) and pmi
    assert pmi == sorted((b, a, n, x) for a, b, n, x in pmi)
    monkeypatch.setattr(BL, "BROADCAST_ROWS", 6)  # one word of a third of all pairs is frequent, the rest is not
    assert pmi == sorted(tuple(r) for r in VE.shifted_pmi(counts).collect())


def test_the_vocabulary_is_its_own_lexicon(spark):
    vocab = spark.createDataFrame([(w,) for w in ("cats", "cat", "glasses", "glass", "men", "man", "buses", "x")], "token string")
    own = sorted(tuple(r) for r in V.lemma_map(vocab).collect())
    assert own == sorted(tuple(r) for r in V.lemma_map(vocab, vocab).collect())
    assert plan(V.lemma_map(vocab)).count("Scan") == 1


def test_frequent_tokens_are_mapped_in_place(spark, monkeypatch):
    monkeypatch.setattr(BL, "BROADCAST_ROWS", 6)
    docs = spark.createDataFrame([(i, f"running running cats word{chr(97 + i)} cat") for i in range(9)] + [(20, "the"), (21, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in V.clean_tokens(docs).collect()}
    assert got[0] == ["run", "run", "cat", "worda", "cat"] and got[20] == got[21] == [] and len(got) == 11
    bag = {(r.doc_id, r.term): r.n for r in V.clean_bag_of_words(docs).collect()}
    assert bag == {(i, t): n for i, x in got.items() for t, n in Counter(x).items()}
    assert "BroadcastHashJoin" in plan(V.clean_tokens(docs))


def test_features_are_read_as_columns(spark):
    from __spark_entry__ import queries
    text = plan(queries()["tfidf_l2"](spark, "/root/testdata/sf0.001"))
    assert "Scan ExistingRDD" not in text and "FileScan parquet" in text
