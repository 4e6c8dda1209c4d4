import math
import random
from collections import Counter, defaultdict

import pytest

from revlens.llm import mixing as M

from .brute import WORD

SCHEMA = "doc_id long, text string, source string"


def corpus(seed=1):
    r = random.Random(seed)
    out, i = [], 0
    for source, n in (("big", 300), ("mid", 60), ("small", 12), (None, 5)):
        for _ in range(n):
            out.append((i, " ".join("w" * r.randrange(1, 5) for _ in range(r.randrange(1, 30))), source))
            i += 1
    return out


def shares(docs):
    n = Counter()
    for _, t, s in docs:
        n[s] += len(WORD.findall(t or ""))
    return {s: x / sum(n.values()) for s, x in n.items()}, n


def solve(p, good):
    low, high = 0.0, 1.0
    if good(0.0):
        return 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if good(mid) else (mid, high)
    return high


def entropy_of(p, x):
    w = [v ** x for v in p.values()]
    return -sum(v / sum(w) * math.log(v / sum(w)) for v in w)


@pytest.mark.parametrize("limit", [1.0, 1.5, 4.0, 1e9])
def test_repetition_limit(rows, limit):
    docs = corpus()
    p, tokens = shares(docs)
    x = solve(p, lambda x: max(v ** (x - 1) for v in p.values()) <= limit * min(v ** (x - 1) for v in p.values()))
    out = M.mix(rows(SCHEMA + ", tokens int, epoch int, name int", [(*d, 1, 1, 1) for d in docs]), max_repeats=limit if limit < 1e9 else 50.0).collect()
    if limit == 1e9:
        x = solve(p, lambda x: max(v ** (x - 1) for v in p.values()) <= 50 * min(v ** (x - 1) for v in p.values()))
    w = {s: v ** x for s, v in p.items()}
    w = {s: v / sum(w.values()) for s, v in w.items()}
    size = max(tokens[s] / w[s] for s in w)
    used, longest = Counter(), max(len(WORD.findall(t)) for _, t, _ in docs)
    epochs = defaultdict(Counter)
    for r in out:
        assert math.isclose(r.weight, w[r.source], rel_tol=1e-6)
        used[r.source] += r.tokens
        epochs[r.source, r.epoch][r.doc_id] += 1
    for s in w:
        assert w[s] * size - 1e-3 <= used[s] <= w[s] * size + longest + 1e-3
        whole = {d for d, _, source in docs if source == s}
        repeats = w[s] * size / tokens[s]
        for e in range(1, int(repeats + 1e-6) + 1):
            assert set(epochs[s, e]) == whole
        assert all(set(c.values()) == {1} for (source, _), c in epochs.items() if source == s)
    for source in w:
        position = sorted(r.position for r in out if r.source == source)
        assert 0 <= position[0] and position[-1] < 1 + 1e-9


def test_entropy_target_and_budget(rows):
    docs = corpus(2)
    p, tokens = shares(docs)
    for target in (0.0, .9, 1.2, 9.0):
        df = rows(SCHEMA, docs)
        sources = M.source_table(M.token_counts(df))
        x = M.temperature(sources, entropy=target)
        want = solve(p, lambda x: entropy_of(p, x) <= target) if entropy_of(p, 1) <= target else 1.0
        assert math.isclose(x, want, abs_tol=1e-6)
    total = sum(tokens.values())
    out = M.mix(rows(SCHEMA, docs), entropy=1.2, budget=total / 2).collect()
    used = Counter()
    for r in out:
        used[r.source] += r.tokens
    w = {r.source: r.weight for r in out}
    assert all(w[s] * total / 2 - 1e-3 <= used[s] <= w[s] * total / 2 + 30 for s in w)
    assert len(out) < 400


def test_blocks_are_permuted(rows):
    docs = corpus(3)
    out = M.mix(rows(SCHEMA, docs), max_repeats=4.0, seed=5).collect()
    again = M.mix(rows(SCHEMA, docs[::-1]), max_repeats=4.0, seed=5).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)
    first, second = ([r.doc_id for r in sorted(out, key=lambda r: r.position) if r.source == "mid" and r.epoch == e] for e in (1, 2))
    assert first != sorted(first) and first[:len(second)] != second and len(first) == 60
    sizes = Counter((r.epoch, r.block) for r in out if r.source == "big")
    assert len(sizes) > 10 and max(sizes.values()) < 60


def test_edge_rows(rows):
    assert M.mix(rows(SCHEMA, []), max_repeats=2.0).collect() == []
    docs = [(1, None, "a"), (2, "", "a"), (3, "x y", "b"), (3, "x y", "b"), (None, "z", None), (4, None, None)]
    out = M.mix(rows(SCHEMA, docs), max_repeats=1.0).collect()
    assert Counter((r.doc_id, r.source, r.tokens, r.epoch) for r in out) == Counter(
        [(1, "a", 0, 1), (2, "a", 0, 1), (3, "b", 2, 1), (3, "b", 2, 1), (None, None, 1, 1), (4, None, 0, 1)])
    assert {(r.source, round(r.weight, 9)) for r in out} == {("a", 0.0), ("b", .8), (None, .2)}
    with pytest.raises(ValueError):
        M.mix(rows(SCHEMA, docs))


def test_query_holds_every_document(spark):
    out = M.op9_temperature_mixing(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id for r in out} == set(range(1000)) and {r.epoch for r in out} <= {1, 2}
