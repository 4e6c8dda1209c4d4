import random

import pytest

from revlens.llm import substring_dedup as S

from .brute import remove_repeats

SCHEMA = "doc_id long, text string"


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def passages(seed, n=60):
    """Texts that share passages of lengths around the span, some changed by a word, some periodic."""
    r = random.Random(seed)
    fresh = lambda k: [f"v{r.randrange(10**6)}" for _ in range(k)]
    pool = [fresh(k) for k in (8, 11, 12, 13, 20, 40, 41, 60, 150)] + [["a", "b"] * 15, ["z"] * 40]
    out = []
    for i in range(n):
        t = fresh(r.randrange(5))
        for _ in range(r.randrange(4)):
            p = list(r.choice(pool))
            if r.random() < .3:
                p[r.randrange(len(p))] = "changed"
            lo = r.choice([0, 0, 1, 3])
            t += p[lo:] + fresh(r.randrange(6))
        out.append((i * 3, "\n ".join(t)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(rows, seed):
    docs = passages(seed)
    assert got(S.remove_repeats(rows(SCHEMA, docs), span=12)) == remove_repeats(docs, 12)


def test_edge_rows(rows):
    p = " ".join(f"p{i}" for i in range(12))
    docs = [(1, None), (2, ""), (3, p), (4, "x " + p + " y"), (5, p + " " + p)]
    df = rows("doc_id long, text string, a long, s long, at long", [(*d, 1, 1, 1) for d in docs])
    assert got(S.remove_repeats(df, span=12)) == remove_repeats(docs, 12)
    kept = {r.doc_id: r.text for r in S.remove_repeats(df, span=12).collect()}
    assert kept == {1: "", 2: "", 3: p, 4: "x y", 5: ""}
    assert S.remove_repeats(rows(SCHEMA, []), span=12).collect() == []
    # equal doc_ids and rows without one
    again = S.remove_repeats(rows(SCHEMA, [(3, p), (3, p), (None, p), (4, p)]), span=12).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in again) == [(-1, 0), (3, 0), (3, 0), (4, 12)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equal_ids_with_different_texts(rows, seed):
    """Every row of a doc_id loses words by its own text and is a source of its own."""
    docs = [(None if d % 17 == 0 else d // 9, t) for d, t in passages(seed, 90)]
    docs += [docs[0], docs[0], (5, None), (5, None), (5, ""), (0, "short")]
    first = {}
    for d, t in docs:
        w = (t or "").split()
        for i in range(len(w) - 11 if d is not None else 0):
            key = tuple(w[i:i + 12])
            first[key] = min(first.get(key, d), d)
    want = []
    for d, t in docs:
        w = (t or "").split()
        gone = {j for i in range(len(w) - 11) if d is not None and first[tuple(w[i:i + 12])] < d for j in range(i, i + 12)}
        want.append((-1 if d is None else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    out = S.remove_repeats(rows(SCHEMA, docs), span=12).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.text) for r in out) == sorted(want)
    assert sum(x[2] for x in want) > 0


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(S.op5_substring_dedup(spark, sf)) == remove_repeats(docs, 50)
