"""Registered queries: knowledge-graph extraction, edits and queries, NER."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate as A
from ..operators import graph as G
from . import common as C
from . import sqltext as S
from .registry import register

# --- the star-schema graph -----------------------------------------------------------------

_KG_SQL = """WITH kg AS (
  SELECT n.n_name AS source, r.r_name AS target, 'in_region' AS edge FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
  UNION ALL SELECT c.c_name, n.n_name, 'lives_in' FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  UNION ALL SELECT s.s_name, n.n_name, 'based_in' FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey) """


def kg_edges(spark, d):
    t = lambda n: C.fixtures.load_table(spark, d, n)
    nation, region = t("nation"), t("region")
    a = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("source"), F.col("r_name").alias("target"), F.lit("in_region").alias("edge"))
    b = t("customer").join(nation, F.col("c_nationkey") == nation.n_nationkey).select(
        F.col("c_name").alias("source"), F.col("n_name").alias("target"), F.lit("lives_in").alias("edge"))
    c = t("supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey).select(
        F.col("s_name").alias("source"), F.col("n_name").alias("target"), F.lit("based_in").alias("edge"))
    return a.unionByName(b).unionByName(c)


@register("kg_edges", _KG_SQL + "SELECT source, target, edge FROM kg")
def kg_edges_q(spark, d):
    return kg_edges(spark, d)


@register("map_edges", _KG_SQL + "SELECT source, target, CASE WHEN edge IN ('lives_in', 'based_in') THEN 'located_in' ELSE edge END AS edge FROM kg")
def map_edges(spark, d):
    return G.map_edges(kg_edges(spark, d), "located_in", {"lives_in", "based_in"})


@register("map_nodes", _KG_SQL + """SELECT CASE WHEN source IN ('NATION_1', 'NATION_2') THEN 'NATION_X' ELSE source END AS source,
  CASE WHEN target IN ('NATION_1', 'NATION_2') THEN 'NATION_X' ELSE target END AS target, edge FROM kg""")
def map_nodes(spark, d):
    return G.map_nodes(kg_edges(spark, d), "NATION_X", {"NATION_1", "NATION_2"})


@register("remap_counts", _KG_SQL + """SELECT CAST(sum(CASE WHEN edge = 'located_in' THEN 1 ELSE 0 END) AS BIGINT) AS before,
  CAST(sum(CASE WHEN (CASE WHEN edge IN ('lives_in', 'based_in') THEN 'located_in' ELSE edge END) = 'located_in' THEN 1 ELSE 0 END) AS BIGINT) AS after
FROM kg""")
def remap_counts(spark, d):
    kg = kg_edges(spark, d)
    return G.remap_counts(kg, G.map_edges(kg, "located_in", {"lives_in", "based_in"}), "located_in")


@register("node_degree", _KG_SQL + """SELECT node, count(*) AS n FROM (SELECT source AS node FROM kg UNION ALL SELECT target FROM kg)
GROUP BY node ORDER BY n DESC, node NULLS LAST LIMIT 10""")
def node_degree(spark, d):
    return G.node_degree(kg_edges(spark, d), 10)


@register("edge_type_counts", _KG_SQL + "SELECT edge, count(*) AS n FROM kg GROUP BY edge ORDER BY n DESC, edge NULLS LAST LIMIT 10")
def edge_type_counts(spark, d):
    return G.edge_type_counts(kg_edges(spark, d), 10)


@register("frontier_union", _KG_SQL + "SELECT target AS node FROM kg WHERE edge = 'lives_in' UNION SELECT source FROM kg WHERE edge = 'lives_in'")
def frontier_union(spark, d):
    return G.frontier_union(kg_edges(spark, d).where("edge = 'lives_in'"))


def _hood_sql(seed: str, depth: int, types=None) -> str:
    e = "kg" if types is None else f"(SELECT * FROM kg WHERE edge IN ({', '.join(S.q(t) for t in types)}))"
    parts = [f", f0 AS (SELECT {S.q(seed)} AS node)"]
    for i in range(1, depth + 1):
        parts.append(f", r{i} AS (SELECT * FROM {e} WHERE source IN (SELECT node FROM f{i-1}) OR target IN (SELECT node FROM f{i-1}))")
        parts.append(f", f{i} AS (SELECT source AS node FROM r{i} UNION SELECT target FROM r{i})")
    body = " UNION ".join(f"SELECT source, target, edge FROM r{i}" for i in range(1, depth + 1))
    return _KG_SQL + "".join(parts) + " " + body


@register("neighborhood", _hood_sql("EUROPE", 2))
def neighborhood(spark, d):
    seeds = spark.createDataFrame([("EUROPE",)], "node string")
    return G.neighborhood(kg_edges(spark, d), seeds, 2)


@register("neighborhood_typed", _hood_sql("NATION_3", 3, ["in_region", "lives_in"]))
def neighborhood_typed(spark, d):
    seeds = spark.createDataFrame([("NATION_3",)], "node string")
    return G.neighborhood(kg_edges(spark, d), seeds, 3, edge_types={"in_region", "lives_in"})


# --- annotation-driven extraction ----------------------------------------------------------------

_DEPS, _POSS = S.list_lit(A.DEP_CYCLE), S.list_lit(A.POS_CYCLE)
ANNOT_CTE = f"""WITH sents AS (
  SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sent_id, unnest(s) AS sentence
  FROM (SELECT doc_id, {S.sentences("coalesce(text, '')")} AS s FROM documents)),
nested AS (SELECT doc_id, sent_id, list_transform({S.words_of('sentence')}, lambda w, i: struct_pack(
  idx := CAST(i - 1 AS INTEGER), text := w, dep := {_DEPS}[(i - 1 + sent_id) % {len(A.DEP_CYCLE)} + 1], pos := {_POSS}[(i - 1 + sent_id) % {len(A.DEP_CYCLE)} + 1])) AS tokens FROM sents) """


def nested_tokens(spark, d):
    return A.rule_annotate(C.docs(spark, d))


@register("annotated_tokens", ANNOT_CTE + "SELECT doc_id, sent_id, t.idx, t.text, t.dep, t.pos FROM (SELECT doc_id, sent_id, unnest(tokens) AS t FROM nested)")
def annotated_tokens(spark, d):
    return A.flatten_tokens(nested_tokens(spark, d))


# the entity fold in SQL (list_reduce with an initial state)
_ENT_FOLD = """list_reduce(tokens, lambda a, t: CASE WHEN coalesce(t.dep, '') = 'punct' THEN a ELSE (
  WITH_STATE) END, {'ent1': '', 'ent2': '', 'prv_dep': '', 'prv_text': '', 'prefix': '', 'modifier': ''})"""


def _ent_fold_sql() -> str:
    dep = "coalesce(t.dep, '')"
    prefix1 = f"CASE WHEN {dep} = 'compound' THEN (CASE WHEN a.prv_dep = 'compound' THEN a.prv_text || ' ' || t.text ELSE t.text END) ELSE a.prefix END"
    mod1 = f"CASE WHEN suffix({dep}, 'mod') THEN (CASE WHEN a.prv_dep = 'compound' THEN a.prv_text || ' ' || t.text ELSE t.text END) ELSE a.modifier END"
    subj = f"instr({dep}, 'subj') = 2"
    obj = f"instr({dep}, 'obj') = 2"
    ent1 = f"CASE WHEN {subj} THEN ({mod1}) || ' ' || ({prefix1}) || ' ' || t.text ELSE a.ent1 END"
    prefix2 = f"CASE WHEN {subj} THEN '' ELSE ({prefix1}) END"
    mod2 = f"CASE WHEN {subj} THEN '' ELSE ({mod1}) END"
    ent2 = f"CASE WHEN {obj} THEN ({mod2}) || ' ' || ({prefix2}) || ' ' || t.text ELSE a.ent2 END"
    state = (f"{{'ent1': {ent1}, 'ent2': {ent2}, 'prv_dep': {dep}, 'prv_text': t.text, "
             f"'prefix': {prefix2}, 'modifier': {mod2}}}")
    return _ENT_FOLD.replace("WITH_STATE", state)


def _rel_fold_sql() -> str:
    ext = "a.rel || ' ' || t.text"

    def take(n):
        return f"{{'rel': {ext}, 'stage': {n}}}"
    done = "{'rel': a.rel, 'stage': 4}"
    s1 = f"CASE WHEN t.dep = 'prep' THEN {take(2)} WHEN t.dep = 'agent' THEN {take(3)} WHEN t.pos = 'ADJ' THEN {take(4)} ELSE {done} END"
    s2 = f"CASE WHEN t.dep = 'agent' THEN {take(3)} WHEN t.pos = 'ADJ' THEN {take(4)} ELSE {done} END"
    s3 = f"CASE WHEN t.pos = 'ADJ' THEN {take(4)} ELSE {done} END"
    body = (f"CASE WHEN t.dep = 'ROOT' THEN {{'rel': t.text, 'stage': 1}} WHEN a.stage = 1 THEN {s1} "
            f"WHEN a.stage = 2 THEN {s2} WHEN a.stage = 3 THEN {s3} ELSE a END")
    return f"list_reduce(tokens, lambda a, t: {body}, {{'rel': CAST(NULL AS VARCHAR), 'stage': 0}})"


def _svo_fold_sql() -> str:
    root = "CASE WHEN t.dep = 'ROOT' THEN t.text ELSE a.root END"
    e1 = "CASE WHEN t.dep <> 'ROOT' AND t.dep = 'nsubj' THEN t.text ELSE a.ent1 END"
    e2 = "CASE WHEN t.dep <> 'ROOT' AND t.dep <> 'nsubj' AND t.dep = 'dobj' THEN t.text ELSE a.ent2 END"
    new = f"{{'ent1': {e1}, 'root': {root}, 'ent2': {e2}, 'done': ({e1}) <> '' AND ({e2}) <> '' AND ({root}) <> ''}}"
    return f"list_reduce(tokens, lambda a, t: CASE WHEN a.done THEN a ELSE {new} END, {{'ent1': '', 'root': '', 'ent2': '', 'done': false}})"


def _strip_sql(x: str) -> str:
    from ..functions.words import WS_CLASS
    return f"regexp_replace({x}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g')"


_EXTRACT_CTE = ANNOT_CTE + f""", folded AS (SELECT doc_id, sent_id, CASE WHEN len(tokens) = 0 THEN NULL ELSE {_ent_fold_sql()} END AS e,
  CASE WHEN len(tokens) = 0 THEN NULL ELSE {_rel_fold_sql()} END AS r FROM nested),
ext AS (SELECT doc_id, sent_id, coalesce({_strip_sql('e.ent1')}, '') AS source, coalesce({_strip_sql('e.ent2')}, '') AS target,
  r.rel AS edge FROM folded) """


@register("extract_entities", _EXTRACT_CTE + "SELECT doc_id, sent_id, source, target FROM ext")
def extract_entities(spark, d):
    return G.extract_entities(nested_tokens(spark, d))


@register("extract_relation", _EXTRACT_CTE + "SELECT doc_id, sent_id, edge FROM ext")
def extract_relation(spark, d):
    return G.extract_relation(nested_tokens(spark, d))


@register("extract_svo", ANNOT_CTE + f""", f AS (SELECT doc_id, sent_id, CASE WHEN len(tokens) = 0 THEN NULL ELSE {_svo_fold_sql()} END AS s FROM nested)
SELECT doc_id, sent_id, coalesce(s.ent1, '') AS subject, coalesce(s.root, '') AS verb, coalesce(s.ent2, '') AS object FROM f""")
def extract_svo(spark, d):
    return G.extract_svo(nested_tokens(spark, d))


_GRAPH_SELECT = """SELECT doc_id, sent_id, lower(source) AS source, lower(target) AS target, lower(edge) AS edge FROM ext
WHERE (source IS NULL OR lower(source) <> '') AND (target IS NULL OR lower(target) <> '') AND (edge IS NULL OR lower(edge) <> '')"""


@register("build_graph", _EXTRACT_CTE + _GRAPH_SELECT)
def build_graph(spark, d):
    return G.build_graph(nested_tokens(spark, d))


@register("drop_empty_edges", _EXTRACT_CTE + "SELECT count(*) AS n_edges, count(edge) AS n_with_edge FROM (" + _GRAPH_SELECT + ")")
def drop_empty_edges(spark, d):
    g = G.build_graph(nested_tokens(spark, d))
    return g.agg(F.count(F.lit(1)).alias("n_edges"), F.count("edge").alias("n_with_edge"))


# --- named entities ------------------------------------------------------------------------------

_GROUPS = S.list_lit(A.NER_GROUPS)
_NER_CTE = f"""spans AS (SELECT doc_id, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS span_id, unnest(w) AS entity
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+') AS w FROM SRC)),
ner AS (SELECT *, {_GROUPS}[CAST(('0x' || substr(md5(entity), 1, 1)) AS INTEGER) % 4 + 1] AS type FROM spans) """


@register("extract_ner")
def extract_ner(spark, d):
    """NER spans per review through the model hook (stand-in regex model)."""
    c = C.corpus(spark, d).select("doc_id", "title", "text")
    return A.extract_ner(c, "text").select("doc_id", "title", "spans")


@register("flatten_ner", "WITH " + _NER_CTE.replace("SRC", "documents") + "SELECT doc_id, span_id, entity, type FROM ner")
def flatten_ner(spark, d):
    spans = A.extract_ner(C.docs(spark, d), "text")
    return A.flatten_ner(spans).select("doc_id", "span_id", "entity", "type")


@register("last_ner_per_title", "WITH " + S.CORPUS_CTE + ", last AS (SELECT title, arg_max(doc_id, descriptor) AS doc_id FROM corpus GROUP BY title), "
          + _NER_CTE.replace("SRC", "(SELECT c.doc_id, c.text FROM corpus c JOIN last l ON c.doc_id = l.doc_id)")
          + "SELECT l.title, n.doc_id, n.span_id, n.entity, n.type FROM ner n JOIN last l ON n.doc_id = l.doc_id")
def last_ner_per_title(spark, d):
    c = C.corpus(spark, d)
    last = A.last_per_key(c.select("title", "doc_id", "descriptor", "text"), "title", ["descriptor"])
    spans = A.extract_ner(last, "text")
    return A.flatten_ner(spans, keys=("title", "doc_id")).select("title", "doc_id", "span_id", "entity", "type")


ENTITY_TITLE = "src7"


@register("entity_graph", _EXTRACT_CTE.replace("FROM documents)", f"FROM documents WHERE source = '{ENTITY_TITLE}')", 1)
          + ", g AS (" + _GRAPH_SELECT + "), "
          + _NER_CTE.replace("SRC", f"(SELECT * FROM documents WHERE source = '{ENTITY_TITLE}')")
          + ", pats AS (SELECT DISTINCT lower(entity) AS p FROM ner) "
          "SELECT doc_id, sent_id, source, target, edge FROM g "
          "WHERE EXISTS (SELECT 1 FROM pats WHERE contains(g.source, p) OR contains(g.target, p))")
def entity_graph(spark, d):
    one = C.fixtures.balanced(
        C.fixtures.load_table(spark, d, "documents").where(F.col("source") == ENTITY_TITLE).select("doc_id", "text"),
        "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    g = G.build_graph(A.rule_annotate(one))
    words = A.flatten_ner(A.extract_ner(one, "text")).select(F.lower("entity").alias("p"))
    return G.filter_graph_by_patterns(g, words)


@register("filter_graph_by_patterns", _KG_SQL + """, pats AS (SELECT r_name AS p FROM region UNION SELECT 'NATION_1')
SELECT source, target, edge FROM kg WHERE EXISTS (SELECT 1 FROM pats WHERE contains(kg.source, p) OR contains(kg.target, p))""")
def filter_graph_by_patterns(spark, d):
    """Star-schema edges touching any region name or containing 'NATION_1' (literal substrings)."""
    pats = (C.fixtures.load_table(spark, d, "region").select(F.col("r_name").alias("p"))
            .unionByName(spark.createDataFrame([("NATION_1",)], "p string")))
    return G.filter_graph_by_patterns(kg_edges(spark, d), pats)


@register("pattern_join", _EXTRACT_CTE + ", g AS (" + _GRAPH_SELECT + "), "
          "pats AS (SELECT DISTINCT lower(w) AS p FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)) "
          "SELECT doc_id, sent_id, source, target, edge FROM g WHERE EXISTS (SELECT 1 FROM pats WHERE contains(g.source, p) OR contains(g.target, p))")
def pattern_join(spark, d):
    """Corpus graph edges whose ends contain a word of the benchmark items."""
    g = G.build_graph(nested_tokens(spark, d))
    bench = C.fixtures.load_table(spark, d, "benchmark")
    pats = (bench.select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1)).alias("w"))
            .select(F.lower("w").alias("p")))
    return G.filter_graph_by_patterns(g, pats)
