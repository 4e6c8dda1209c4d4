"""Knowledge graphs as edge DataFrames ``(source, target, edge)``.

Extraction folds over each sentence's tokens with ``aggregate`` (pure Catalyst,
one sentence per row, no shuffle).  Graph queries are semi-joins on node
values; iterative expansion checkpoints its frontier to cut lineage.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.words import WS_CLASS


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


# --- extraction ------------------------------------------------------------------------

def _entity_step(acc, t):
    dep = F.coalesce(t["dep"], F.lit(""))
    txt = t["text"]
    after_compound = acc["prv_dep"] == "compound"
    prefix1 = F.when(dep == "compound",
                     F.when(after_compound, F.concat(acc["prv_text"], F.lit(" "), txt)).otherwise(txt)
                     ).otherwise(acc["prefix"])
    modifier1 = F.when(dep.endswith("mod"),
                       F.when(after_compound, F.concat(acc["prv_text"], F.lit(" "), txt)).otherwise(txt)
                       ).otherwise(acc["modifier"])
    # a dependency label "contains subj/obj starting at offset 1" (nsubj, csubj, dobj, pobj, ...)
    is_subj = F.instr(dep, "subj") == 2
    is_obj = F.instr(dep, "obj") == 2
    ent1 = F.when(is_subj, F.concat(modifier1, F.lit(" "), prefix1, F.lit(" "), txt)).otherwise(acc["ent1"])
    prefix2 = F.when(is_subj, F.lit("")).otherwise(prefix1)
    modifier2 = F.when(is_subj, F.lit("")).otherwise(modifier1)
    ent2 = F.when(is_obj, F.concat(modifier2, F.lit(" "), prefix2, F.lit(" "), txt)).otherwise(acc["ent2"])
    new = F.struct(ent1.alias("ent1"), ent2.alias("ent2"), dep.alias("prv_dep"), txt.alias("prv_text"),
                   prefix2.alias("prefix"), modifier2.alias("modifier"))
    # most words are neither compound nor modifier, subject or object: they are only remembered
    other = F.struct(acc["ent1"].alias("ent1"), acc["ent2"].alias("ent2"), dep.alias("prv_dep"), txt.alias("prv_text"),
                     acc["prefix"].alias("prefix"), acc["modifier"].alias("modifier"))
    counts = (dep == "compound") | dep.endswith("mod") | is_subj | is_obj
    return F.when(dep == "punct", acc).when(counts, new).otherwise(other)


def extract_entities(nested: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, source, target)``: last subject and last object of each
    sentence, each prefixed by the pending modifier and compound words."""
    e = F.lit("")
    init = F.struct(e.alias("ent1"), e.alias("ent2"), e.alias("prv_dep"), e.alias("prv_text"),
                    e.alias("prefix"), e.alias("modifier"))
    # the fold is one named column, read twice afterwards (never copied)
    folded = nested.select("doc_id", "sent_id", F.aggregate("tokens", init, _entity_step).alias("_e"))
    return folded.select("doc_id", "sent_id", _strip(F.col("_e.ent1")).alias("source"),
                         _strip(F.col("_e.ent2")).alias("target"))


def _relation_step(acc, t):
    dep, pos, txt = t["dep"], t["pos"], t["text"]
    stage = acc["stage"]
    ext = F.concat(acc["rel"], F.lit(" "), txt)
    as_root = F.struct(txt.alias("rel"), F.lit(1).alias("stage"))

    def take(nxt):
        return F.struct(ext.alias("rel"), F.lit(nxt).alias("stage"))
    done = F.struct(acc["rel"].alias("rel"), F.lit(4).alias("stage"))
    s1 = F.when(dep == "prep", take(2)).when(dep == "agent", take(3)).when(pos == "ADJ", take(4)).otherwise(done)
    s2 = F.when(dep == "agent", take(3)).when(pos == "ADJ", take(4)).otherwise(done)
    s3 = F.when(pos == "ADJ", take(4)).otherwise(done)
    return (F.when(dep == "ROOT", as_root).when(stage == 1, s1).when(stage == 2, s2)
            .when(stage == 3, s3).otherwise(acc))


def extract_relation(nested: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, edge)``: the span ROOT [prep] [agent] [ADJ] at the last
    ROOT of the sentence (longest extension); null when there is no ROOT."""
    init = F.struct(F.lit(None).cast("string").alias("rel"), F.lit(0).alias("stage"))
    r = F.aggregate("tokens", init, _relation_step)
    return nested.select("doc_id", "sent_id", r["rel"].alias("edge"))


def _svo_step(acc, t):
    dep, txt = t["dep"], t["text"]
    root = F.when(dep == "ROOT", txt).otherwise(acc["root"])
    ent1 = F.when((dep != "ROOT") & (dep == "nsubj"), txt).otherwise(acc["ent1"])
    ent2 = F.when((dep != "ROOT") & (dep != "nsubj") & (dep == "dobj"), txt).otherwise(acc["ent2"])
    done = (ent1 != "") & (ent2 != "") & (root != "")
    new = F.struct(ent1.alias("ent1"), root.alias("root"), ent2.alias("ent2"), done.alias("done"))
    return F.when(acc["done"], acc).otherwise(new)


def extract_svo(nested: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, subject, verb, object)``: first complete nsubj/ROOT/dobj."""
    e = F.lit("")
    init = F.struct(e.alias("ent1"), e.alias("root"), e.alias("ent2"), F.lit(False).alias("done"))
    folded = nested.select("doc_id", "sent_id", F.aggregate("tokens", init, _svo_step).alias("_s"))
    return folded.select("doc_id", "sent_id", F.col("_s.ent1").alias("subject"), F.col("_s.root").alias("verb"),
                         F.col("_s.ent2").alias("object"))


def drop_empty_edges(df: DataFrame) -> DataFrame:
    """Lower-case the three columns and drop rows with an empty source, target or
    edge.  Missing values are *not* empty: a null edge (failed relation) stays.

    The test runs inside a generator (a one-element array filtered, then
    exploded) rather than as a Filter: predicate pushdown would otherwise copy
    the expressions that produce the three columns (the extraction folds) into
    the condition and evaluate them twice.
    """
    from ..functions.text import explode_rows
    keys = [c for c in df.columns if c not in ("source", "target", "edge")]
    edge = F.struct(*[F.lower(c).alias(c) for c in ("source", "target", "edge")])

    def keep(e):
        cond = None
        for c in ("source", "target", "edge"):
            x = e[c].isNull() | (e[c] != "")
            cond = x if cond is None else cond & x
        return cond
    x = df.select(*keys, F.filter(F.array(edge), keep).alias("_edges"))
    return explode_rows(x, keys, F.col("_edges"), "_g").select(*keys, "_g.source", "_g.target", "_g.edge")


def build_graph(nested: DataFrame) -> DataFrame:
    """Entities and relation of every sentence (both folds in one projection), then cleaned."""
    e = F.lit("")
    init_e = F.struct(e.alias("ent1"), e.alias("ent2"), e.alias("prv_dep"), e.alias("prv_text"),
                      e.alias("prefix"), e.alias("modifier"))
    init_r = F.struct(F.lit(None).cast("string").alias("rel"), F.lit(0).alias("stage"))
    folded = nested.select("doc_id", "sent_id", F.aggregate("tokens", init_e, _entity_step).alias("_e"),
                           F.aggregate("tokens", init_r, _relation_step).alias("_r"))
    g = folded.select("doc_id", "sent_id", _strip(F.col("_e.ent1")).alias("source"),
                      _strip(F.col("_e.ent2")).alias("target"), F.col("_r.rel").alias("edge"))
    return drop_empty_edges(g)


# --- graph edits -------------------------------------------------------------------------------

def map_edges(df: DataFrame, map_to: str, map_from) -> DataFrame:
    return df.withColumn("edge", F.when(F.col("edge").isin(list(map_from)), F.lit(map_to)).otherwise(F.col("edge")))


def map_nodes(df: DataFrame, map_to: str, map_from) -> DataFrame:
    out = df
    for c in ("source", "target"):
        out = out.withColumn(c, F.when(F.col(c).isin(list(map_from)), F.lit(map_to)).otherwise(F.col(c)))
    return out


def remap_counts(before: DataFrame, after: DataFrame, value: str, cols=("edge",)) -> DataFrame:
    """Rows (summed over ``cols``) equal to ``value`` before and after a remap."""
    def cnt(df):
        return sum((F.sum(F.when(F.col(c) == value, 1).otherwise(0)) for c in cols), F.lit(0))
    a = after.agg(cnt(after).cast("bigint")).scalar()
    return before.agg(cnt(before).cast("bigint").alias("before")).select("before", a.alias("after"))


def node_degree(df: DataFrame, top: int | None = 10) -> DataFrame:
    """Occurrences of each node as source plus as target (null node included)."""
    nodes = df.select(F.col("source").alias("node")).unionAll(df.select(F.col("target").alias("node")))
    out = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return out
    return out.orderBy(F.desc("n"), F.asc_nulls_last("node")).limit(top)


def edge_type_counts(df: DataFrame, top: int | None = 10) -> DataFrame:
    out = df.groupBy("edge").agg(F.count(F.lit(1)).alias("n"))
    if top is None:
        return out
    return out.orderBy(F.desc("n"), F.asc_nulls_last("edge")).limit(top)


def frontier_union(df: DataFrame) -> DataFrame:
    """The set of nodes of an edge set: sources union targets (null dropped)."""
    return (df.select(F.col("target").alias("node")).union(df.select(F.col("source").alias("node")))
            .where(F.col("node").isNotNull()).distinct())


def neighborhood(df: DataFrame, sources: DataFrame, depth: int, edge_types=None) -> DataFrame:
    """Edges reached in ``depth`` undirected rounds from ``sources``, distinct.

    Breadth first: a round follows only the nodes that the round before has
    newly found, so every node is expanded once.  The edges are written once;
    each round's new nodes and edges are checkpointed, so the plan of a round
    does not grow with the depth and a lost executor recomputes one round.
    """
    from ..session import materialize
    if depth < 1:
        return df.limit(0)
    e = materialize(df if edge_types is None else df.where(F.col("edge").isin(list(edge_types))))
    new = materialize(sources.select(F.col(sources.columns[0]).alias("node")).where("node is not null").distinct())
    seen, found = new, None
    for i in range(depth):
        rows = (e.join(new.withColumnRenamed("node", "source"), "source", "left_semi").select(*df.columns)
                .union(e.join(new.withColumnRenamed("node", "target"), "target", "left_semi").select(*df.columns)))
        rows = materialize(rows.distinct())
        found = rows if found is None else found.union(rows)
        if i + 1 < depth:
            new = materialize(frontier_union(rows).join(seen, "node", "left_anti"))
            seen = seen.union(new)
    return found.distinct()


#: Bytes of patterns in one automaton, and of nodes that are read beside one shard of many.
PATTERN_BYTES, NODE_BYTES = 1 << 22, 1 << 26


def nodes_with_patterns(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """The distinct ``node`` strings that contain one of the ``patterns`` (column
    ``sub``, distinct and not empty).

    An Aho-Corasick automaton reads every node once, however many patterns
    there are.  Patterns of up to ``PATTERN_BYTES`` make one automaton; more are
    dealt to shards of about that size, each read by parts of the nodes.
    """
    from ..session import ship_package
    from .blocks import written
    ship_package(nodes.sparkSession)
    size = patterns.agg(F.sum(F.octet_length("sub") + 8)).first()[0] or 0
    shards = -(-size // PATTERN_BYTES)
    if shards <= 1:
        words = patterns.toArrow().column("sub").to_pylist()  # at most PATTERN_BYTES

        def run(it):
            find = _finder(words)
            for b in it:
                yield pa.RecordBatch.from_arrays([b.column(0).filter(find(b.column(0)))], ["node"])
        return nodes.select("node").mapInArrow(run, "node string")

    def beside(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"node": pa.array([], pa.string())})
        found = left.column("node").combine_chunks()
        return pa.table({"node": found.filter(_finder(right.column("sub").to_pylist())(found)).cast(pa.string())})

    nodes = written(nodes.select("node"), "nodes")
    parts = max(1, -(-(nodes.agg(F.sum(F.octet_length("node"))).first()[0] or 0) // NODE_BYTES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))
    dealt = nodes.withColumn("part", F.pmod(F.xxhash64("node"), F.lit(int(parts))).cast("int")).withColumn("shard", every(shards))
    there = patterns.withColumn("shard", F.pmod(F.xxhash64("sub"), F.lit(int(shards))).cast("int")).withColumn("part", every(parts))
    return dealt.groupBy("shard", "part").cogroup(there.groupBy("shard", "part")).applyInArrow(beside, "node string").distinct()


def _finder(patterns: list[str]):
    """A function from strings to whether they contain a pattern."""
    import ahocorasick
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p, True)
    if patterns:
        automaton.make_automaton()
    return lambda texts: pa.array([bool(patterns) and next(automaton.iter(t), None) is not None for t in texts.to_pylist()], pa.bool_())


def filter_graph_by_patterns(df: DataFrame, patterns: DataFrame, regex: tuple[str, ...] = ()) -> DataFrame:
    """Edges whose source or target contains any of the patterns (literal
    substrings, exact) or matches any regular expression of ``regex``.

    Work is done on *distinct* node values: each is read once against all
    patterns and the matching nodes are semi-joined back to the edges.
    """
    from ..session import materialize
    # the distinct patterns are read twice (size, search) and the edges four times: written once
    p = materialize(patterns.select(F.col(patterns.columns[0]).alias("sub")).where(
        F.col("sub").isNotNull() & (F.col("sub") != "")).distinct())
    df = materialize(df)
    nodes = frontier_union(df)
    hit = nodes_with_patterns(nodes, p)
    for r in regex:
        hit = hit.union(nodes.where(F.col("node").rlike(r)).select("node"))
    hit = materialize(hit.distinct())
    s = df.join(hit.withColumnRenamed("node", "source"), "source", "left_semi").select(*df.columns)
    t = df.join(hit.withColumnRenamed("node", "target"), "target", "left_semi").select(*df.columns)
    # (source hit) + (target hit and source not hit): every matching row once,
    # parallel edges kept, a null source handled by the anti join
    return s.union(t.join(hit.withColumnRenamed("node", "source"), "source", "left_anti").select(*df.columns))
