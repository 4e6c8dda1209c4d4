import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from revlens.llm import prefix_trie as P

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(data):
    turns = defaultdict(list)
    for conv, turn, role, text in data:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(x)] for c, x in turns.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    return out


def expected(convs):
    """{sequence of turns: row}, every conversation walked from the root."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for key in nodes:
        if key:
            children[key[:-1]].append(key)

    def below(key):
        leaves, saved, todo = 0, 0, [key]
        while todo:
            k = todo.pop()
            leaves += not children[k]
            saved += (len(nodes[k]) - 1) * (len(k[-1][1].encode()) if k else 0)
            todo += children[k]
        return leaves, saved

    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        leaves, saved = below(key)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children[key]), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def answer(df):
    return sorted((tuple(r[c] for c in P.OUT) for r in df.collect()), key=str)


def trie(rows, data, **more):
    return answer(P.prefix_trie(*P.grafted(rows(TURNS, data)), **more))


def talks(n=60, seed=1):
    rng = random.Random(seed)
    return [(c, k, rng.choice("ua"), rng.choice(["", "é", "yes", "no, never"])) for c in range(n) for k in range(rng.randint(1, 9))]


@pytest.mark.parametrize("most", [P.CONTAINER, 30])
def test_trie_equals_brute_force_whatever_bursts(spark, rows, most):
    data = talks()
    assert trie(rows, data, most=most) == expected(rebuilt(data))


def test_a_hot_beginning_and_many_equal_conversations(spark, rows):
    data = [(c, k, "u", f"same {k}") for c in range(150) for k in range(4)] + [(c, 9, "a", f"own {c}") for c in range(0, 150, 3)]
    assert trie(rows, data, most=40) == expected(rebuilt(data))


def test_a_conversation_longer_than_its_chunks(spark, rows, monkeypatch):
    monkeypatch.setattr(P, "ENDS", 2)
    data = [(c, k, "u", f"{k}" if k < 90 else f"{c} {k}") for c in (0, 1, 2, 12) for k in range(100)] + [(3, 0, "u", "0"), (4, 0, "u", "0")]
    for most in (60, 5):
        assert trie(rows, data, most=most, chunk=8) == expected(rebuilt(data))


def test_numbers_of_one_conversation_do_not_need_one_task(spark, rows):
    data = [(7, k % 50, "u", f"{k:04d}") for k in range(1000)] + [(8, None, "a", "first"), (8, 0, "a", "then")]
    got = {(r["conv"], r["pos"]) for r in P.positions(rows("conv long, turn long, role string, text string", data)).collect()}
    assert got == {(7, k) for k in range(1, 1001)} | {(8, 1), (8, 2)}


def test_edge_rows(spark, rows):
    data = [(None, 1, "u", "lost"), (0, 2, None, None), (0, None, "u", "first"), (0, 1, "a", "x" * 1_000_000), (5, 1, "u", "tie b"),
            (5, 1, "u", "tie a"), (5, 1, "u", "tie a"), (6, 1, "u", ""), (6, 1, "", "u"), (-3, 1, "u", "negative"), (11, 1, "u", "short")]
    wide = rows(TURNS, data).selectExpr("*", "1 as conv", "2 as pos", "3 as chunk", "4 as size")
    convs = rebuilt([r for r in data if r[0] != -3])
    # a negative number's remainder has its sign, as in SQL
    h = zlib.crc32(b"-3") % 9
    convs[-3] = convs_of(data, 0)[:h] + convs_of(data, -3)[h:]
    assert answer(P.prefix_trie(*P.grafted(wide))) == expected(convs)
    assert trie(rows, []) == [] and trie(rows, [(None, 1, "u", "x")]) == []


def convs_of(data, conv):
    return [t[2:] for t in sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in data if r[0] == conv)]


def test_turnless_conversations_belong_to_the_root(spark, rows):
    # conversations without a base whose own turns all lie before h
    data = [(c, 1, "u", "only") for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1]
    got = trie(rows, data)
    assert got == expected(rebuilt(data)) and len(got) == 1 and got[0][3] == len(data)
