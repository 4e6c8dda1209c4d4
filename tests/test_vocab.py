from revlens.operators import vocab as V

PAPER = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster",
         "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat",
         "conditional": "condit", "generalizations": "gener", "oscillators": "oscil", "character": "charact",
         "waste": "wast", "controll": "control", "roll": "roll", "sky": "sky", "adjustment": "adjust"}


def test_lemma_map_uses_lexicon(spark):
    vocab = spark.createDataFrame([(w,) for w in ["films", "film", "glasses", "glass", "women", "boxes", "cities", "zzz"]],
                                  "token string")
    lex = spark.createDataFrame([(w,) for w in ["film", "glass", "woman", "box", "city"]], "w string")
    got = dict(V.lemma_map(vocab, lex).collect())
    assert got["films"] == "film"
    assert got["glasses"] == "glass"
    assert got["women"] == "woman"
    assert got["boxes"] == "box"
    assert got["cities"] == "city"
    assert got["zzz"] == "zzz"


def test_stems_of_the_paper_are_native(spark):
    vocab = spark.createDataFrame([(w,) for w in PAPER], "token string")
    stems = V.stem_map(vocab)
    assert dict(stems.collect()) == PAPER
    assert "Python" not in stems._jdf.queryExecution().executedPlan().toString()


def test_stem_edge_words(spark):
    words = [("yyyyy", "yyyyi"), ("", ""), ("by", "by"), (None, None), ("ing", "ing"), ("yes", "ye"), ("sss", "sss"), ("eed", "eed"),
             ("toyed", "toi"), ("fizzing", "fizz"), ("failing", "fail"), ("trouble", "troubl"), ("sized", "size"), ("adoption", "adopt")]
    df = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(words)], "i int, token string")
    from revlens.functions.porter import porter_stem
    assert [r[0] for r in df.orderBy("i").select(porter_stem("token")).collect()] == [s for _, s in words]


def test_clean_tokens_order_and_empty(spark):
    docs = spark.createDataFrame([(1, "The films were running, the cats ran."), (2, ""), (3, "the and of")],
                                 "doc_id long, text string")
    got = {r[0]: list(r[1]) for r in V.clean_tokens(docs).collect()}
    assert got[2] == [] and got[3] == []
    # films -> film (lexicon = vocabulary has no 'film', so stays 'films') -> stem
    assert got[1] == ["film", "run", "cat", "ran"]


def test_abbreviations_and_initials_do_not_end_sentences(spark):
    import math
    from revlens.operators import vocab as V
    text = ("Dr. Smith met Mr. Brown. They saw J. R. Ewing! It was late (very late.) The end. "
            "St. Lee, e.g. in Rome, said \"no.\" Dr. Who agreed? The end came. No end. The sea. ")
    docs = [(i, text) for i in range(8)] + [(90, None), (91, ""), (92, " . \n"), (93, "The sea the sea the end smith")]
    words = V.sentence_words(spark.createDataFrame(docs, "doc_id long, text string").na.fill(""))
    found = {r["type"]: r for r in V.abbreviations(words).collect()}
    assert {"dr", "mr", "e.g"} <= set(found) and not {"end", "sea", "brown", "rome", "late"} & set(found)
    rows = [(r["type"], r["period"]) for r in words.collect() if r["type"] is not None]
    p = sum(x for _, x in rows) / len(rows)
    n, m = len([1 for t, _ in rows if t == "dr"]), len([1 for t, x in rows if t == "dr" and x])
    ratio = 2 * (m * (math.log(.99) - math.log(p)) + (n - m) * (math.log(.01) - math.log(1 - p)))
    assert n == m == 16 and abs(found["dr"]["score"] - ratio * math.exp(-2)) < 1e-6
    got = {}
    for r in V.learned_sentences(words, V.abbreviations(words)).orderBy("doc_id", "sent_id").collect():
        got.setdefault(r["doc_id"], []).append(r["sentence"])
    assert got[0] == ["Dr. Smith met Mr. Brown.", "They saw J. R. Ewing!", "It was late (very late.)", "The end.",
                      "St. Lee, e.g. in Rome, said \"no.\"", "Dr. Who agreed?", "The end came.", "No end.", "The sea."]
    assert got[92] == ["."] and 90 not in got and 91 not in got and got[93] == ["The sea the sea the end smith"]


def test_learned_sentences_moves_words_by_document_only(spark):
    """No exchange by type, which would bring all uses of a word to one task."""
    from pyspark.sql import functions as F
    from revlens.operators import vocab as V
    words = V.sentence_words(spark.createDataFrame([(i, "Dr. Who came 1 2 3. He left.") for i in range(20)], "doc_id long, text string"))
    known = spark.createDataFrame([("dr", 1)], "type string, n long").where(F.col("n") > 0)
    plan = V.learned_sentences(words, known)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = V.learned_sentences(words, known)
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        assert sorted({r.sentence for r in out.collect()}) == ["Dr. Who came 1 2 3.", "He left."]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
