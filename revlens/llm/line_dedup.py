"""Line deduplication by cross-site spread.

Every line gets a HyperLogLog sketch of the sites it stands on; sketches merge
by aggregation, so a line that holds a third of all rows is a few kilobytes per
task.  A line spread over at least ``min_sites`` sites is boilerplate.  The
sketch decides where its estimate is far from the threshold; lines whose
estimate is within the sketch's error get an exact distinct count.  Of every
boilerplate line the first occurrence stays (smallest doc_id, then position),
so no content is lost from the corpus.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_ddl, only, record_batch, table

#: log2 of the sketch's registers, and the number of standard errors taken as "near".
LG_K, ERRORS = 12, 5

_OUT = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, site, pos, line): lines that have a non-blank character; ``line`` is a hash of the
    line without the blanks around it."""
    split = docs.select("doc_id", "text_key", "site", F.posexplode_outer(F.split("text", "\n")).alias("pos", "raw"))
    bare = F.trim(F.col("raw"), F.lit(" \t\r"))
    return split.where(bare != "").select("doc_id", "text_key", "site", "pos", F.xxhash64(bare).alias("line"))


def spread_lines(lines: DataFrame, min_sites: int) -> DataFrame:
    """Hashes of the lines (line, site) that stand on at least ``min_sites`` different sites; a null site is none."""
    error = ERRORS * 1.04 / math.sqrt(1 << LG_K)
    low, high = math.floor(min_sites * (1 - error)) - 1, math.ceil(min_sites * (1 + error)) + 1
    sketched = (lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.count("site").alias("n"))
                .where(F.col("n") >= min_sites)
                .select("line", F.hll_sketch_estimate("sketch").alias("sites")).where(F.col("sites") >= low))
    sketched = Scratch(lines.sparkSession, "line-spread").write(sketched, "sketched")
    near = sketched.where(F.col("sites") <= high).select("line")
    exact = (lines.join(near, "line", "left_semi").where("site is not null").select("line", "site").distinct()
             .groupBy("line").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites))
    return sketched.where(F.col("sites") > high).select("line").union(exact.select("line"))


def _without(it):
    for b in it:
        texts, cut = b.column("text").to_pylist(), b.column("cut").to_pylist()
        n, removed, out = [], [], []
        for text, gone in zip(texts, cut):
            lines = text.split("\n") if text is not None else []
            n.append(len(lines))
            removed.append(len(gone or ()))
            if gone:
                gone = set(gone)
                text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            out.append(text)
        yield record_batch(_OUT, b.column("doc_id"), n, removed, out)


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, doc_id: str = "doc_id", text: str = "text",
                       site: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove repeats of lines that stand on ``min_sites`` or more sites.

    Returns doc_id, n_lines, n_removed, text (the lines that stay) and the
    input's ``keep`` columns, one row per input row.  Lines are cut at ``\\n``
    and compared without blanks around them; blank lines always stay.  A null
    text stays null and has no lines; a null site counts as none.  Rows that
    agree in doc_id and text are one document.  A row without doc_id comes
    before all others.  An empty table gives none.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "lines")
    base = only(docs, doc_id=doc_id, text=text, site=site, **{f"kept_{i}": c for i, c in enumerate(keep)})
    base = base.withColumn("text_key", F.xxhash64("text"))
    lines = s.write(_lines(base), "lines")
    wide = s.write(spread_lines(lines, min_sites), "wide")
    hits = s.write(lines.join(wide, "line").select("line", "doc_id", "text_key", "pos"), "hits")
    s.drop("lines")
    first = s.write(hits.groupBy("line").agg(F.min(F.struct("doc_id", "text_key", "pos")).alias("first")), "first")
    gone = (hits.join(first, "line").where(F.struct("doc_id", "text_key", "pos") != F.col("first"))
            .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("pos")).alias("cut")))
    gone = s.write(gone.withColumnsRenamed({"doc_id": "id", "text_key": "key"}), "gone")
    s.drop("hits")
    s.drop("first")
    joined = base.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left")
    extra = [f"kept_{i}" for i in range(len(keep))]
    schema = arrow_ddl(_OUT) + "".join(f", `{c}` {base.schema[c].dataType.simpleString()}" for c in extra)
    out = joined.select("doc_id", "text", "cut", *extra).mapInArrow(_carry(extra), schema)
    return out.withColumnsRenamed(dict(zip(extra, keep)))


def _carry(extra: list[str]):
    def run(it):
        for b in it:
            for out in _without([b]):
                yield pa.RecordBatch.from_arrays([*out.columns, *(b.column(c) for c in extra)],
                                                 names=[*out.schema.names, *extra])
    return run


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on 10 or more sources, over all of ``documents``."""
    return remove_boilerplate(table(spark, sf_dir, "documents"), min_sites=10)


QUERIES = {"op1_line_dedup": op1_line_dedup}

ORACLE_SQL = {"op1_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS b FROM lines),
wide AS (SELECT b FROM bare WHERE b <> '' GROUP BY b HAVING count(DISTINCT source) >= 10),
ranked AS (
  SELECT bare.*, wide.b IS NOT NULL AND row_number() OVER (PARTITION BY bare.b ORDER BY doc_id, pos) > 1 AS gone
  FROM bare LEFT JOIN wide ON bare.b = wide.b),
per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(p.n_lines, 0) AS n_lines, coalesce(p.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE p.text END AS text
FROM documents d LEFT JOIN per_doc p USING (doc_id)
"""}
