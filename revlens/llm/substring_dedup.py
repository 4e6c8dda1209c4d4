"""Substring deduplication by compacting the de Bruijn graph of word windows.

The edges of the graph are the ``span``-word windows (k-mers) of the texts.  A
window's *anchor* is its smallest q-word hash; equal windows have equal
anchors, so the consecutive windows of one anchor occurrence, a path without
branches, travel together as one row (anchor, content hash, document, start,
number of windows).  Anchors of a single document can repeat nothing and go at
once.  Occurrences of the same content are one path; only anchors with several
contents branch, and only their contents, not their occurrences, are unfolded
into single windows to find each window's first document.  Back on the
documents, consecutive windows with consecutive source coordinates compact into
long spans, and every span is verified against the words at its source before
it is removed.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, arrow_ddl, only, record_batch, table, text_slices

#: Words hashed for an anchor.
Q = 8
#: Low bits of an anchor's sort key that hold its position (ties go to the left).
POSITION = 30
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 2**64)

_RUNS = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("key", pa.int64()), ("s", pa.int32()),
                   ("n", pa.int32())])
_WINDOWS = pa.schema([("w", pa.int64()), ("a", pa.int64()), ("c", pa.int64()), ("j", pa.int32())])
_DIGESTS = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("at", pa.int32()), ("len", pa.int32()), ("digest", pa.binary())])
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("text", pa.string())])


def _sums(h: np.ndarray) -> np.ndarray:
    out = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(W.mix(h + W.U(0x632BE59BD9B4E019)) * W._power(_BASE, len(h)), out=out[1:])
    return out


def _content(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hash of the words lo..hi-1, the same wherever they stand."""
    return W.mix((sums[hi] - sums[lo]) * W._power(_INVERSE, len(sums))[lo] + (hi - lo).astype(np.uint64))


def _anchors(words: W.Words, span: int):
    """(first word, anchor position, gram hashes) of every window, in order."""
    counts = words.counts
    room = np.repeat(words.first[1:], counts) - np.arange(len(words.hash))
    first = np.flatnonzero(room >= span)
    g = W.grams(words, Q)
    if not len(first):
        return first, first, g
    mask = W.U((1 << POSITION) - 1)
    low = (g & ~mask) | np.arange(len(g), dtype=np.uint64)
    width, have = span - Q + 1, 1
    while have * 2 <= width:  # smallest key of 2, 4, 8, ... grams
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
    return first, (low[first] & mask).astype(np.int64), g


def _runs(span: int):
    def run(it):
        for b in text_slices(it):
            words = W.split(b.column("text"), lower=False)
            first, anchor, g = _anchors(words, span)
            if not len(first):
                continue
            head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            tail = np.r_[head[1:], len(first)] - 1
            s, e, p = first[head], first[tail], anchor[head]
            content = _content(_sums(words.hash), s, e + span) + (p - s).astype(np.uint64)
            doc = np.searchsorted(words.first, s, "right") - 1
            ids, keys = (b.column(x).to_numpy(zero_copy_only=False)[doc] for x in ("doc_id", "key"))
            yield record_batch(_RUNS, g[p].view(np.int64), content.view(np.int64), ids, keys, s - words.first[doc], tail - head + 1)
    return run


def _windows(span: int):
    """Window hashes of the runs (a, c, s, n) asked for in each document."""
    def run(it):
        for b in it:
            asked = b.column("asked")
            for i in range(b.num_rows):
                rows = asked[i].as_py()
                words = W.split(b.column("text").slice(i, 1), lower=False)
                sums = _sums(words.hash)
                n = np.array([r["n"] for r in rows])
                row = np.repeat(np.arange(len(rows)), n)
                j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.array([r["s"] for r in rows])[row] + j
                w = _content(sums, at, at + span)
                yield record_batch(_WINDOWS, w.view(np.int64), np.array([r["a"] for r in rows])[row],
                                   np.array([r["c"] for r in rows])[row], j)
    return run


def _digests(it):
    """Digests of the word ranges asked for in each document."""
    for b in it:
        ids, keys, ats, lens, out = [], [], [], [], []
        asked = b.column("asked")
        for i, (doc, key, text) in enumerate(zip(*(b.column(x).to_pylist() for x in ("doc_id", "key", "text")))):
            w = text.encode().split()
            for r in asked[i].as_py():
                ids.append(doc)
                keys.append(key)
                ats.append(r["at"])
                lens.append(r["len"])
                out.append(hashlib.sha1(b" ".join(w[r["at"]:r["at"] + r["len"]])).digest())
        yield record_batch(_DIGESTS, ids, keys, ats, lens, out)


def _kept(with_text: bool):
    def run(it):
        for b in it:
            texts, cut = b.column("text"), b.column("cut")
            n, removed, sha, kept_text = [], [], [], []
            for i in range(b.num_rows):
                words = (texts[i].as_py() or "").encode().split()  # bytes.split() parts at space and 0x09-0x0D
                ranges = cut[i].as_py()
                kept = words
                if ranges:
                    mark = np.zeros(len(words) + 1, np.int64)
                    for r in ranges:
                        mark[r["at"]] += 1
                        mark[r["at"] + r["len"]] -= 1
                    kept = list(compress(words, np.cumsum(mark[:-1]) == 0))
                joined = b" ".join(kept)
                n.append(len(words))
                removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode() if with_text else None)
            yield record_batch(_OUT, b.column("doc_id"), n, removed, sha, kept_text)
    return run


def _asked(requests: DataFrame, docs: DataFrame, *fields: str) -> DataFrame:
    """Documents with the list of their requests (doc_id, key, fields...)."""
    lists = requests.groupBy("doc_id", "key").agg(F.collect_list(F.struct(*fields)).alias("asked"))
    return docs.join(lists, ["doc_id", "key"])


def remove_repeats(docs: DataFrame, span: int = 50, doc_id: str = "doc_id", text: str = "text",
                   with_text: bool = True) -> DataFrame:
    """Remove every word covered by a window of ``span`` words that also starts
    in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 and, ``with_text``, the kept
    words joined by one space; one row per input row.  A null text has no
    words.  Rows with equal doc_ids never remove from each other, but each is a
    text of its own that loses words and serves as a source; rows without
    doc_id neither lose words nor are a source.  Other columns are ignored; an
    empty table gives none.
    """
    if span < Q:
        raise ValueError(f"a span has at least {Q} words")
    spark = docs.sparkSession
    s = Scratch(spark, "substrings")
    texts = only(docs, doc_id=doc_id, text=text)
    # the key tells texts of one doc_id apart; equal rows share it and are looked at once
    again = _repeats(texts)
    texts = texts.withColumn("key", F.xxhash64("text") if again else F.lit(0).cast("long"))
    sources = texts.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    if again:
        sources = s.write(sources.dropDuplicates(["doc_id", "key"]), "sources")
    runs = s.write(sources.mapInArrow(_runs(span), arrow_ddl(_RUNS)), "runs")
    # grouped tables are written before they are joined: the join can then split a hot anchor
    shared = s.write(runs.groupBy("a").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("a"),
                     "shared")
    found = s.write(runs.join(shared, "a", "left_semi"), "found")
    s.drop("runs")
    paths = s.write(found.groupBy("a", "c").agg(F.min(F.struct("doc_id", "key", "s")).alias("at"), F.max("doc_id").alias("last"),
                                                F.first("n").alias("n")), "paths")
    branching = s.write(paths.groupBy("a").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("a"), "branching")
    # paths that never branch: the first document holds all their windows
    single = paths.join(branching, "a", "left_anti").where("at.doc_id < last").select(
        "a", "c", F.lit(0).alias("j"), "n", F.col("at.doc_id").alias("src"), F.col("at.key").alias("src_key"), F.col("at.s").alias("src_at"))
    # the others, window by window
    unfold = paths.join(branching, "a", "left_semi").select("at.doc_id", "at.key", "a", "c", "at.s", "n")
    windows = s.write(_asked(unfold, sources, "a", "c", "s", "n").select("text", "asked")
                      .mapInArrow(_windows(span), arrow_ddl(_WINDOWS)), "windows")
    placed = windows.join(paths.select("a", "c", "at", "last"), ["a", "c"])
    firsts = placed.groupBy("w").agg(F.min(F.struct("at.doc_id", "at.key", (F.col("at.s") + F.col("j")).alias("s"))).alias("first"))
    several = placed.select("w", "a", "c", "j", "last").join(firsts, "w").where("first.doc_id < last").select(
        "a", "c", "j", F.lit(1).alias("n"), F.col("first.doc_id").alias("src"), F.col("first.key").alias("src_key"), F.col("first.s").alias("src_at"))
    marks = s.write(single.union(several), "marks")
    hits = found.select("a", "c", "doc_id", "key", "s").join(marks, ["a", "c"]).where("src < doc_id").select(
        "doc_id", "key", (F.col("s") + F.col("j")).alias("at"), "n", "src", "src_key", "src_at")
    spans = s.write(_compacted(hits, span), "spans")
    for name in ("shared", "branching", "found", "paths", "windows", "marks"):
        s.drop(name)
    wanted = spans.select("doc_id", "key", "at", "len").union(spans.select("src", "src_key", "src_at", "len")).distinct()
    digests = s.write(_asked(wanted, sources, "at", "len").select("doc_id", "key", "text", "asked")
                      .mapInArrow(_digests, arrow_ddl(_DIGESTS)), "digests")
    own = digests.withColumnRenamed("digest", "own")
    there = digests.select(F.col("doc_id").alias("src"), F.col("key").alias("src_key"), F.col("at").alias("src_at"), "len", F.col("digest").alias("there"))
    sure = spans.join(own, ["doc_id", "key", "at", "len"]).join(there, ["src", "src_key", "src_at", "len"]).where("own = there")
    cut = s.write(sure.groupBy("doc_id", "key").agg(F.collect_list(F.struct("at", "len")).alias("cut")), "cut")
    for name in ("spans", "digests", "sources"):
        s.drop(name)
    out = texts.join(cut, ["doc_id", "key"], "left").mapInArrow(_kept(with_text), arrow_ddl(_OUT))
    return out if with_text else out.drop("text")


def _repeats(texts: DataFrame) -> bool:
    return bool(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("doc_id is not null and n > 1").head(1))


def _compacted(hits: DataFrame, span: int) -> DataFrame:
    """Runs of windows that continue each other both in the document and at the
    source become one span (doc_id, key, at, len in words, src, src_key, src_at)."""
    order = Window.partitionBy("doc_id", "key").orderBy("at")
    before = F.lag(F.struct((F.col("at") + F.col("n")).alias("at"), "src", "src_key", (F.col("src_at") + F.col("n")).alias("src_at"))).over(order)
    new = F.when(before == F.struct("at", "src", "src_key", "src_at"), 0).otherwise(1)
    part = hits.withColumn("new", new).withColumn("path", F.sum("new").over(order))
    return part.groupBy("doc_id", "key", "path").agg(
        F.min("at").alias("at"), (F.sum("n") + (span - 1)).cast("int").alias("len"),
        F.first("src").alias("src"), F.first("src_key").alias("src_key"), F.min("src_at").alias("src_at")).drop("path")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words over all of ``documents``."""
    return remove_repeats(table(spark, sf_dir, "documents"), span=50, with_text=False)


QUERIES = {"op5_substring_dedup": op5_substring_dedup}

ORACLE_SQL = {"op5_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM win JOIN first USING (k) WHERE first < doc_id),
cut AS (SELECT doc_id, list(pos) AS cut FROM gone GROUP BY doc_id),
kept AS (SELECT d.doc_id, len(w) AS n, len(coalesce(cut, [])) AS n_removed,
                CASE WHEN cut IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(cut, i)), lambda i: w[i]) END AS k
         FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept
"""}
