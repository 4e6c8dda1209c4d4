import math
import random

import numpy as np
import pyarrow as pa
import pytest

from revlens.llm import language_id as L

SYLLABLES = {"en": ["the", "ing", "er", "wh", "on"], "de": ["sch", "ung", "ein", "ß", "kei"], "fr": ["eau", "oi", "tion", "ç", "ê"]}


def corpus(seed, n=240):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = ["".join(r.choice(SYLLABLES[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.choice([1, 3, 30]))]
        host = r.choice([f"{lang}.example", f"{lang}.example", "mixed.example", None])
        out.append((i, " ".join(words), r.choice([lang, lang, f"{lang.upper()}-XX", "xx", None]), host, host and host.split(".")[1], lang))
    return out


SCHEMA = "doc_id long, text string, declared string, host string, suffix string, label string"


def brute(docs, known, logs, strength=20.0):
    """The same posteriors, one document after another."""
    k = len(known) + 1
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    ll, alone = [], []
    for _, text, *_ in docs:
        b = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        x = np.zeros(k)
        for i in range(len(b) - 2):
            x += logs[((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 16]
        ll.append(x / 3)
        alone.append(soft(x / 3) if len(b) > 2 else soft(np.r_[np.zeros(k - 1), 60]))
    tag = [t if t in known else None for t in ((d or "").strip().lower().split("-")[0] for _, _, d, *_ in docs)]
    whole = (sum(alone) + 1) / (len(docs) + k)
    said = np.full((k, len(known)), .5)
    for t, a in zip(tag, alone):
        if t:
            said[:, known.index(t)] += a
    said /= said.sum(1, keepdims=True)

    def prior(host, suffix):
        p = whole
        for i, key in ((4, suffix), (3, host)):
            if key is not None:
                same = [a for d, a in zip(docs, alone) if d[4] == suffix and (i == 4 or d[3] == host)]
                p = (sum(same) + strength * p) / (len(same) + strength)
        return p
    out = {}
    for d, x, a, t in zip(docs, ll, alone, tag):
        post = a
        if len((d[1] or "").encode()) > 2:
            post = soft(x + np.log(prior(d[3], d[4])) + (np.log(said[:, known.index(t)]) if t else 0))
        out[d[0]] = ((known + ["und"])[int(post.argmax())], float(post.max()))
    return out


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(rows, seed):
    docs = corpus(seed) + [(900, None, "en", "en.example", "example", None), (901, "", None, None, None, None), (902, "a", "de", "x", None, None),
                           (903, "\x01\x02\x03\x04\x05\x06\x07\x08" * 9, "en", "en.example", "example", None), (904, "ung", None, "z", "q", None)]
    df = rows(SCHEMA + ", n int, ll int, prior int, tag int", [(*d, 1, 1, 1, 1) for d in docs])
    known, logs = L.fit(df.select("text", "label"))
    out = L.identify(df, None, "host", "declared", "suffix", model=(known, logs)).collect()
    want = brute(docs, known, logs)
    assert {r.doc_id: r.language for r in out} == {d: x for d, (x, _) in want.items()}
    assert all(math.isclose(r.probability, want[r.doc_id][1], rel_tol=1e-9) for r in out)
    told = {r.doc_id: r for r in out}
    assert not any(told[i].accepted for i in (900, 901, 902, 903)) and told[903].language == "und"
    assert all(told[d[0]].accepted and told[d[0]].language == d[5] for d in docs[:240] if len(d[1]) > 30)


def test_evidence_decides_ambiguous_text(rows):
    docs = corpus(3) + [(901, "qqqzzz", None, "de.example", "example", None), (902, "qqqzzz", "fr", "new", "example", None)]
    df = rows(SCHEMA, docs)
    model = L.fit(df.select("text", "label"))
    model[1][:, -1] -= 3  # "und" would explain it best
    out = {r.doc_id: r.language for r in L.identify(df, None, "host", "declared", "suffix", model=model).collect()}
    assert out[901] == "de" and out[902] == "fr"


def test_trigrams_stay_inside_texts():
    texts = pa.array(["abcd", None, "a", "", "AB", "bcdE", "xyz"])
    bucket, offsets = L.trigrams(texts)
    assert np.diff(offsets).tolist() == [2, 0, 0, 0, 0, 2, 1]
    alone = np.concatenate([L.trigrams(texts.slice(i, 1))[0] for i in range(7)])
    assert bucket.tolist() == alone.tolist() and bucket[1] == bucket[2]


def test_edge_tables(rows):
    assert L.identify(rows(SCHEMA, []), "label", "host", "declared", "suffix").collect() == []
    out = L.identify(rows(SCHEMA, [(1, "abc def", None, None, None, None), (1, "abc def", None, None, None, None)]), "label", "host").collect()
    assert [(r.doc_id, r.language, r.accepted) for r in out] == [(1, "und", False)] * 2
    picked = L.identify(rows(SCHEMA, corpus(5)), "label", "host", languages=("en",)).collect()
    assert {r.language for r in picked if r.accepted} == {"en"}


def test_held_out_accuracy(spark):
    """Text models of one half tell the languages of the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where("doc_id % 2 = 0").selectExpr("text", "lang as label"))
    out = L.identify(docs.where("doc_id % 2 = 1"), None, "source", model=model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.language == r.lang for r in out]) > .98


def test_query_keeps_documents(spark):
    out = L.op8_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == 1000 and np.mean([r.accepted and r.language == r.declared for r in out]) > .99


def test_address_and_markup(rows):
    urls = {"http://WWW.Example.DE:80/a?b=c": ("www.example.de", "de"), "https://u:p@x.co.uk./": ("x.co.uk", "uk"), "//a.fr": ("a.fr", "fr"),
            "http://10.0.0.1/x.de": ("10.0.0.1", None), "http://[::1]:8/": ("[::1]", None), "http://localhost/": ("localhost", None),
            "mailto:a@b.de": (None, None), "": (None, None), None: (None, None)}
    host, suffix = L.address(L.F.col("u"))
    got = rows("u string", [(u,) for u in urls]).select("u", host.alias("h"), suffix.alias("s")).collect()
    assert {r.u: (r.h, r.s) for r in got} == urls
    pages = {'<!DOCTYPE html><html lang="fr"><style>p{}</style><script>var t="</p>"</script><p>l&eacute; <b>a</b></p>': ("fr", "l a"),
             "<HTML class='a lang=xx' data-lang=yy xml:lang = de-AT><p>x < y</p>": ("de-AT", "x < y"),
             "<!--<html lang=en>--><html>z": (None, "z"), "no markup": (None, "no markup"), "": (None, ""), None: (None, None)}
    declared, text = L.markup(L.F.col("h"))
    got = rows("h string", [(h,) for h in pages]).select("h", declared.alias("d"), text.alias("t")).collect()
    assert {r.h: (r.d, r.t) for r in got} == pages


def test_label_is_no_second_evidence(rows):
    """A label that the text contradicts must not outvote it through the declared language."""
    docs = [(d[0], d[1], d[5], d[3]) for d in corpus(3)]
    df = rows("doc_id long, text string, lang string, host string", docs)
    alone = {r.doc_id: (r.language, r.probability) for r in L.identify(df, "lang", "host").collect()}
    both = L.identify(df, "lang", "host", declared="lang").collect()
    assert {r.doc_id: (r.language, r.probability) for r in both} == {d: (x, pytest.approx(p)) for d, (x, p) in alone.items()}
    assert {r.doc_id: r.declared for r in both} == {d[0]: d[2] for d in docs}


def test_page_query_uses_every_evidence(spark, tmp_path):
    words = {"en": "the whering on ther ", "de": "die schung einkei ung "}
    docs = [(i, words[x] * 9, x) for i, x in enumerate(["en", "de"] * 20)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    page = lambda lang, x: f"<html{lang}><p>{x}</p></html>"
    pages = [(i, f"http://h{i % 3}.example.de/{i}", page("", words["de"] * 9)) for i in range(60)]
    pages += [(i, f"http://h{i % 3}.example.com/{i}", page(" lang=en", words["en"] * 9)) for i in range(60, 120)]
    # texts that tell nothing: by the suffix of a new host, and by the markup of one without address
    pages += [(200, "http://new.example.de/", page("", "qqq")), (201, "http://new.example.com/", page("", "qqq")),
              (202, None, page(" lang='en-GB'", "qqq")), (202, None, page(" lang='en-GB'", "qqq")), (203, "http://10.0.0.1/", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = L.op8_page_language_id(spark, str(tmp_path)).collect()
    assert len(out) == len(pages)
    share = {r.doc_id: r for r in out}
    assert share[10].language == "de" and share[70].language == "en" and share[70].declared == "en"
    assert share[200].language == "de" and share[201].language == "en" and share[202].language == "en"
    assert share[203].language == "und"


def test_page_query(spark):
    out = L.op8_page_language_id(spark, "/root/testdata/sf0.01").collect()
    assert len(out) == 250 and np.mean([r.accepted and r.language == r.declared for r in out]) > .95
