from collections import Counter, defaultdict

import public_tokenizers as P
import pytest

import corpus_pipeline as C

from .brute import jaccard_components, shingles
from .test_byte_bpe import B  # noqa: F401

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage at the smallest size, each written and read again."""
    sf = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    s = C.Scratch(spark, "pipeline-test")
    for name, stage in C.STAGES:
        after = s.write(stage(spark, docs, sf), name)
        out.append((name, docs.collect(), after.collect(), docs, after))
        docs = after
    return {name: rest for name, *rest in out}


def test_order_and_columns(spark, stages):
    assert [n for n, _ in C.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "temperature_mixing", "byte_bpe"]
    for name, (_, _, before, after) in stages.items():
        if name != "byte_bpe":
            assert after.dtypes == before.dtypes


def test_language_stage_keeps_clean_documents(stages):
    before, after, *_ = stages["language_id"]
    assert len(after) >= .99 * len(before)
    assert {r.doc_id: r.text for r in after}.items() <= {r.doc_id: r.text for r in before}.items()


def test_line_stage(stages):
    before, after, *_ = stages["line_dedup"]
    sites = defaultdict(set)
    for r in before:
        for x in r.text.split("\n"):
            sites[x.strip(" \t\r")].add(r.source)
    seen, want = set(), {}
    for r in sorted(before, key=lambda r: r.doc_id):
        kept = []
        for x in r.text.split("\n"):
            k = x.strip(" \t\r")
            if k and len(sites[k]) >= 10:
                if k in seen:
                    continue
                seen.add(k)
            kept.append(x)
        want[r.doc_id] = "\n".join(kept)
    assert {r.doc_id: r.text for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after if r.text != {b.doc_id: b.text for b in before}[r.doc_id])


def test_near_duplicate_stage(stages):
    before, after, *_ = stages["ngram_jaccard_join"]
    want = {d for d, (_, c) in jaccard_components([(r.doc_id, r.text) for r in before], 5, 4, 5).items() if c == d}
    assert {r.doc_id for r in after} == want and len(after) == len(want)
    assert all(shingles(r.text, 5) is not None for r in after)


def test_mixing_stage(stages):
    before, after, *_ = stages["temperature_mixing"]
    n = Counter(r.doc_id for r in after)
    assert set(n) == {r.doc_id for r in before} and set(n.values()) <= {1, 2}
    assert {r.doc_id: tuple(r) for r in after} == {r.doc_id: tuple(r) for r in before}


def test_token_stage(stages):
    before, after, *_ = stages["byte_bpe"]
    v = B.Vocabulary(open(P.path("byte_bpe_50k.tiktoken"), "rb").read())
    assert Counter((r.doc_id, v.decode(r.ids).decode()) for r in after) == Counter((r.doc_id, r.text) for r in before)
    assert all(r.n_tokens == len(r.ids) for r in after)


def test_edge_rows(spark, rows):
    data = [(1, None, None, None, None), (1, None, None, None, None), (None, "", "en", "a", 0), (2, "a b c d e f", "en", "a", 11),
            (2, "a b c d e f", "en", "a", 11), (3, "the cat sat on the mat " * 20, "en", None, 460), (None, "the cat sat on a mat " * 20, "fr", "b", 1)]
    for table in (data, []):
        docs = rows(SCHEMA + ", text_key int, key int, id int, n int", [(*d, 1, 1, 1, 1) for d in table])
        for name, stage in C.STAGES:
            out = stage(spark, docs, "")
            got = out.collect()
            assert not table or name == "language_id" or len(got) >= len({d[0] for d in table if d[0]}) - 1
            assert table or not got


def test_near_duplicates_of_repeated_and_missing_ids(spark, rows):
    """Exactly one row of every component stays, and no row of another one goes."""
    key = lambda t: spark.range(1).select(C.F.xxhash64(C.F.lit(t))).first()[0]
    long = lambda w: " ".join(f"{w}{i}" for i in range(60))
    x, y, z, u, v = (long(w) for w in "xyzuv")
    near = lambda t: t + " more"
    data = [(3, y), (7, y), (7, x),                       # (7, x) stands alone
            (9, z), (9, z), (9, near(z)),                 # repeats and a near copy under one id
            (None, u), (None, near(u)), (None, u),        # copies without id
            (11, v), (None, v), (None, near(v)),          # a null id goes before any other
            (20, ""), (20, ""), (21, ""), (None, None), (None, None)]  # empty texts link with nothing
    table = [(d, t, "en", f"s{i}", len(t or "")) for i, (d, t) in enumerate(data)]
    z_kept, u_kept = min((z, near(z)), key=key), min((u, near(u)), key=key)
    source = lambda d, t: min(f"s{i}" for i, row in enumerate(data) if row == (d, t))
    want = [(3, y), (7, x), (9, z_kept), (None, u_kept), (11, v), (20, ""), (21, ""), (None, None)]
    out = C.near_duplicates(spark, rows(SCHEMA, table), "").collect()
    assert Counter((r.doc_id, r.text, r.source) for r in out) == Counter((d, t, source(d, t)) for d, t in want)


def test_run(spark, stages):
    out = C.run(spark, "/root/testdata/sf0.01")
    assert Counter((r.doc_id, r.n_tokens) for r in out.collect()) == Counter((r.doc_id, r.n_tokens) for r in stages["byte_bpe"][1])
