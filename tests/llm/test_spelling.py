import zlib
from collections import Counter

import pytest

from revlens.llm import spelling as S
from tests.llm import brute

VOCABULARY = "word string, n long"


def one_edit(a, b):
    """Exactly one letter inserted, deleted or replaced, by plain comparison."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def expected(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return out


def answer(df):
    got = [r for r in df.collect()]
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def words_of(documents):
    counts = Counter()
    for doc, text in documents:
        for run in brute.re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def some_words(n=300, letters="abÉ", least=3, most=9, seed=3):
    import random
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(least, most))): rng.choice([1, 2, 15, 300, 5000]) for _ in range(n)}


@pytest.mark.parametrize("blocks", [1 << 22, 7])
def test_variants_equal_brute_force_also_in_many_passes(spark, rows, monkeypatch, blocks):
    monkeypatch.setattr(S, "PASS_BLOCKS", blocks)
    counts = some_words()
    assert answer(S.variants(rows(VOCABULARY, list(counts.items())))) == expected(counts)


def test_a_full_filter_only_adds_candidates(spark, rows, monkeypatch):
    monkeypatch.setattr(S, "BITS", 1)
    counts = some_words(seed=4)
    assert answer(S.variants(rows(VOCABULARY, list(counts.items())))) == expected(counts)


def test_long_words_other_scripts_and_chains_of_forms(spark, rows):
    long = "ab" * 40_000
    counts = {long: 2, long[:-1]: 30, long[:100] + "x" + long[101:]: 1, "straße": 1, "strasse": 2, "strase": 100, "日本語": 1, "日本": 10,
              "😀😀": 1, "😀": 10, "aaaa": 1, "aaa": 10, "aa": 100, "a": 1000, "x" * 63: 1, "x" * 64: 10, "x" * 65: 100, "x" * 66: 1000}
    got = answer(S.variants(rows(VOCABULARY, list(counts.items()))))
    assert got == expected(counts)
    assert got["aaaa"][:2] == ("aaa", "a") and got["x" * 63][1] == "x" * 66


def test_edge_rows(spark, rows):
    data = [("tie", 1), ("tia", 10), ("tib", 10), (None, 5), ("", 5), ("null", None), ("same", 2), ("same", 3)]
    df = rows(VOCABULARY, data).selectExpr("word", "n", "1 as form", "2 as other", "3 as root")
    assert answer(S.variants(df)) == expected({"tie": 1, "tia": 10, "tib": 10, "same": 5})
    assert answer(S.variants(df))["tie"][0] == "tia"
    assert S.variants(rows(VOCABULARY, [])).collect() == []


def test_query_equals_brute_force_on_documents(spark, rows, tmp_path):
    base = ["Straßenbahn fährt LANGSAM weiter", "strassenbahn Strasenbahn straßenbahn", "élégance elegance ×times÷ abcdefg-hijklmn"]
    data = [(i, " ".join([base[i % 3]] * 3 + [f"Wort{'x' * (i % 5)}schatz"])) for i in range(200)]
    data += [(None, base[0]), (7, None), (8, ""), (9, "y" * 300_000), (10, "y" * 300_000), (11, "Kurz kurz")]
    rows("doc_id long, text string", data).write.parquet(str(tmp_path / "documents.parquet"))
    got = answer(S.op11_spelling_variants(spark, str(tmp_path)))
    assert got == expected(words_of(data))
