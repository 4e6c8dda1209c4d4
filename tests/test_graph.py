"""Extraction folds and graph operators on hand-made annotations and edges."""

from pyspark.sql import functions as F

from revlens.operators import annotate as A
from revlens.operators import graph as G


def nested(spark, sents):
    rows = [(1, s, i, t, d, p) for s, toks in enumerate(sents) for i, (t, d, p) in enumerate(toks)]
    long = spark.createDataFrame(rows, "doc_id long, sent_id int, idx int, text string, dep string, pos string")
    return A.nest_tokens(long)


SENTS = [
    [("The", "det", "DET"), ("big", "amod", "ADJ"), ("movie", "compound", "NOUN"), ("star", "compound", "NOUN"),
     ("actor", "nsubj", "NOUN"), ("won", "ROOT", "VERB"), ("in", "prep", "ADP"), ("the", "det", "DET"),
     ("final", "amod", "ADJ"), ("round", "pobj", "NOUN")],
    [("it", "csubj", "PRON"), (",", "punct", "PUNCT"), ("was", "ROOT", "VERB"), ("seen", "ROOT", "VERB"),
     ("by", "agent", "ADP"), ("happy", "amod", "ADJ"), ("fans", "obj", "NOUN")],
    [("no", "det", "DET"), ("subject", "dobj", "NOUN"), ("here", "advmod", "ADV")],
    [("she", "nsubjpass", "PRON"), ("was", "auxpass", "AUX"), ("hit", "ROOT", "VERB"), ("hard", "advmod", "ADJ")],
]


def test_entities_of_hand_made_sentences(spark):
    got = {r["sent_id"]: (r["source"], r["target"]) for r in G.extract_entities(nested(spark, SENTS)).collect()}
    assert got == {0: ("big movie star actor", "final  round"),  # inner double space kept
                   1: ("it", ""), 2: ("", "subject"), 3: ("she", "")}


def test_relation_longest_at_last_root(spark):
    got = {r["sent_id"]: r["edge"] for r in G.extract_relation(nested(spark, SENTS)).collect()}
    assert got[0] == "won in"
    assert got[1] == "seen by happy"
    assert got[2] is None
    assert got[3] == "hit hard"


def test_svo_first_complete(spark):
    sents = [[("a", "nsubj", "X"), ("b", "ROOT", "X"), ("c", "dobj", "X"), ("d", "nsubj", "X")]]
    r = G.extract_svo(nested(spark, sents)).collect()[0]
    assert (r["subject"], r["verb"], r["object"]) == ("a", "b", "c")


def edges(spark, rows):
    return spark.createDataFrame(rows, "source string, target string, edge string")


def test_drop_empty_keeps_null_edge(spark):
    e = edges(spark, [("A", "B", None), ("a", "b", ""), ("", "b", "x"), ("a", "a", "Self"), ("a", "b", "x"), ("a", "b", "x")])
    got = sorted(G.drop_empty_edges(e).collect(), key=str)
    assert ("a", "b", None) in [tuple(r) for r in got]
    assert ("a", "a", "self") in [tuple(r) for r in got]
    assert len(got) == 4  # parallel edges kept


def test_pattern_filter_is_literal_and_keeps_duplicates(spark):
    e = edges(spark, [("a.b", "x", "e"), ("axb", "y", "e"), ("q", "(c)", "e"), ("q", "(c)", "e"), (None, "a.b", "e")])
    pats = spark.createDataFrame([("a.b",), ("(c",)], "p string")
    got = sorted((tuple(r) for r in G.filter_graph_by_patterns(e, pats).collect()), key=str)
    assert got == sorted([("a.b", "x", "e"), ("q", "(c)", "e"), ("q", "(c)", "e"), (None, "a.b", "e")], key=str)


def test_pattern_filter_by_regular_expression(spark):
    e = edges(spark, [("a1", "x", "e"), ("ab", "y2", "e"), ("q", None, "e")])
    none = spark.createDataFrame([], "p string")
    assert [tuple(r) for r in G.filter_graph_by_patterns(e, none, regex=("^a[0-9]$",)).collect()] == [("a1", "x", "e")]
    assert G.filter_graph_by_patterns(e, none, regex=("[0-9]", "^q")).count() == 3


def test_neighborhood_plan_grows_linearly(spark):
    """Each round reads checkpointed rows: one more round adds the same number of scans."""
    e = edges(spark, [(f"n{i}", f"n{i + 1}", "r") for i in range(12)])
    seeds = spark.createDataFrame([("n0",)], "n string")
    scans = []
    for depth in (2, 4, 6):
        out = G.neighborhood(e, seeds, depth)
        assert out.count() == depth
        scans.append(out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD"))
    assert scans[2] - scans[1] == scans[1] - scans[0] <= 4


def test_neighborhood_rounds(spark):
    e = edges(spark, [("a", "b", "r"), ("b", "c", "s"), ("c", "d", "r"), ("x", "y", "r")])
    seeds = spark.createDataFrame([("a",)], "n string")
    one = {tuple(r) for r in G.neighborhood(e, seeds, 1).collect()}
    three = {tuple(r) for r in G.neighborhood(e, seeds, 3).collect()}
    typed = {tuple(r) for r in G.neighborhood(e, seeds, 3, edge_types={"r"}).collect()}
    assert one == {("a", "b", "r")}
    assert three == {("a", "b", "r"), ("b", "c", "s"), ("c", "d", "r")}
    assert typed == {("a", "b", "r")}
    assert G.neighborhood(e, seeds, 0).count() == 0


def test_degree_and_edge_counts_ties(spark):
    e = edges(spark, [("a", "b", "r"), ("b", "c", None), ("c", "a", None)])
    deg = [tuple(r) for r in G.node_degree(e, 2).collect()]
    assert deg == [("a", 2), ("b", 2)]
    ec = [tuple(r) for r in G.edge_type_counts(e, 10).collect()]
    assert ec == [(None, 2), ("r", 1)]


def test_map_edges_and_counts(spark):
    e = edges(spark, [("a", "b", "x"), ("a", "b", "y"), ("a", "b", None)])
    m = G.map_edges(e, "z", {"x", "y"})
    assert sorted((r["edge"] or "") for r in m.collect()) == ["", "z", "z"]
    rc = G.remap_counts(e, m, "z").collect()[0]
    assert (rc["before"], rc["after"]) == (0, 2)


def test_patterns_are_found_in_one_reading_of_long_nodes(spark, monkeypatch):
    """Rows stay as many as the nodes, also with many patterns in several shards."""
    import random
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("ab", k=n))
    nodes = [word(rng.randint(0, 9)) for _ in range(60)] + ["x" * 10_000 + "abba", "y" * 10_000, "\u00e9\U0001f600z"]
    patterns = sorted({word(rng.randint(4, 7)) for _ in range(25)} | {"\U0001f600"})
    df = spark.createDataFrame([(n,) for n in set(nodes)], "node string")
    p = spark.createDataFrame([(x,) for x in patterns], "sub string")
    want = sorted(n for n in set(nodes) if any(x in n for x in patterns))
    found = G.nodes_with_patterns(df, p)
    assert sorted(r["node"] for r in found.collect()) == want and 0 < len(want) < len(set(nodes))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
    monkeypatch.setattr(G, "PATTERN_BYTES", 60)
    monkeypatch.setattr(G, "NODE_BYTES", 5_000)
    assert sorted(r["node"] for r in G.nodes_with_patterns(df, p).collect()) == want
    assert G.nodes_with_patterns(df, p.limit(0)).collect() == []


def test_ner_model_is_given_slices_of_bounded_text(spark, monkeypatch):
    """The spans of a whole Arrow batch are never Python objects at the same time."""
    import pandas as pd
    monkeypatch.setattr(A, "MODEL_CHARS", 1000)

    def given(texts):
        size = int(texts.str.len().fillna(0).sum())
        return pd.Series([[{"entity_group": "PER", "score": 1.0, "word": t, "start": len(texts), "end": size}] for t in texts])
    texts = [None if i % 7 == 3 else "" if i % 7 == 5 else "x" * (5000 if i == 20 else 90 + i) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.spans[0] for r in A.extract_ner(df, "text", given).collect()}
    assert [got[i].word for i in range(60)] == texts
    assert all(s.end <= 1000 or s.start == 1 for s in got.values())
    assert got[20].end == 5000 and max(s.start for s in got.values()) > 1
    assert A.extract_ner(df.where("false"), "text", given).collect() == []
