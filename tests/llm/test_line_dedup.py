import os

import duckdb
import pytest
from pyspark.sql import functions as F

from revlens.llm import line_dedup as L

SCHEMA = "doc_id long, text string, source string"


def got(df):
    return {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in df.collect()}


def test_spread_and_first_occurrence(rows):
    docs = [(i, f"own {i}\n  shared\t\nfew", f"s{i}") for i in range(4)] + [(9, "few\n\nshared\nshared", None)]
    docs[3] = (3, "own 3\nshared", "s3")
    out = got(L.remove_boilerplate(rows(SCHEMA, docs), min_sites=4))
    assert out == {0: (3, 0, "own 0\n  shared\t\nfew"), 1: (3, 1, "own 1\nfew"), 2: (3, 1, "own 2\nfew"),
                   3: (2, 1, "own 3"), 9: (4, 2, "few\n")}


def test_edge_rows(rows):
    assert L.remove_boilerplate(rows(SCHEMA, [])).collect() == []
    docs = [(1, None, "a"), (2, "", "a"), (3, "x", "a"), (3, "x", "a"), (None, "x", "b"), (4, "x\ny", "c"), (4, "x", "d")]
    df = rows(SCHEMA + ", n_lines int, line int, site int", [(*d, 1, 1, 1) for d in docs])
    out = [tuple(r) for r in L.remove_boilerplate(df, min_sites=2, keep=("source", "site")).collect()]
    key = lambda r: (r[0] or 0, str(r[3]), r[4])
    assert sorted(out, key=key) == sorted(
        [(1, 0, 0, None, "a", 1), (2, 1, 0, "", "a", 1), (3, 1, 1, "", "a", 1), (3, 1, 1, "", "a", 1),
         (None, 1, 0, "x", "b", 1), (4, 2, 1, "y", "c", 1), (4, 1, 1, "", "d", 1)], key=key)


@pytest.mark.parametrize("sites", [1000])
def test_sketch_far_from_and_near_the_threshold(spark, sites):
    """Lines on 900 to 1,100 sites: sketches alone would err near 1,000."""
    n = [900, 990, 999, 1000, 1001, 1010, 1100]
    lines = None
    for i, k in enumerate(n):
        part = spark.range(k * 2).select(F.lit(i).cast("long").alias("line"), F.concat(F.lit("s"), F.col("id") % k).alias("site"))
        lines = part if lines is None else lines.union(part)
    assert {r.line for r in L.spread_lines(lines, sites).collect()} == {i for i, k in enumerate(n) if k >= sites}


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf, 'documents.parquet')}'")
    want = {r[0]: r[1:] for r in con.execute(L.ORACLE_SQL["op1_line_dedup"]).fetchall()}
    out = got(L.op1_line_dedup(spark, sf))
    assert out == want and sum(r[1] for r in out.values())
