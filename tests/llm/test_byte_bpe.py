import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from revlens.llm import byte_bpe as B

SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def vocabulary(request):
    path = P.path(request.param)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(4)
    spans = ["<|endoftext|>", "it's We'll 'd", "  \n\t  x", "  y", "𝄞é漢字かな한글", "١٢٣ ½ Ⅷ", "\x1c\x85​﻿", "aaaaaaa" * 9, "ababababa" * 11,
             "ha" * 700, "!" * 333, " " * 50, "\r\n\r\n", "zzz" + "́" * 40, "0" * 99, "The quick brown fox", "Donaudampfschifffahrt"]
    out = ["", " ", *spans]
    alphabet = "abcdeinorst AEI'.,é漢\n\t 0123"
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 400))) for _ in range(150)]
    out += ["".join(r.sample(spans, 5)) for _ in range(100)]
    out += ["".join(chr(r.randrange(32, 0x2FFF)) for _ in range(200)) for _ in range(30)]
    return out


def test_equals_library(vocabulary):
    path, library = vocabulary
    encoder = B.Encoder(B.Vocabulary(open(path, "rb").read()), P.PATTERN)
    for (text,), ids in ((r, i) for r, i in encoder.encode(((t,), t) for t in texts())):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert encoder.vocabulary.decode(ids) == text.encode()


def test_ranks_out_of_order(monkeypatch):
    """Merges may make a pair of lower rank than their own; small limits flush and forget often."""
    monkeypatch.setattr(B, "NEW_PIECES", 5)
    monkeypatch.setattr(B, "REMEMBERED", 9)
    r = random.Random(8)
    for _ in range(30):
        tokens = [bytes([i]) for i in range(256)]
        r.shuffle(tokens)
        more = list({bytes(r.choice(b"abc") for _ in range(r.randrange(2, 6))) for _ in range(40)})
        r.shuffle(more)
        ranks = {t: i for i, t in enumerate(tokens + more)}
        data = b"\n".join(base64.b64encode(t) + b" %d" % i for t, i in ranks.items())
        library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        encoder = B.Encoder(B.Vocabulary(data), r"\S+|\s+")
        docs = [" ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 40))) for _ in range(3)) for _ in range(20)]
        assert [i.tolist() for _, i in encoder.encode((None, d) for d in docs)] == [library.encode_ordinary(d) for d in docs]


def test_operators_and_edge_rows(rows, vocabulary):
    path, library = vocabulary
    data = [(1, None, 7), (2, "", 7), (3, "a b", None), (3, "a b", 8), (None, "long " * 9000, 9)]
    df = rows("doc_id long, text string, ids int", data)
    out = B.encode(df, path, P.PATTERN)
    got = sorted((r.doc_id or 0, r.n_tokens, r.ids) for r in out.collect())
    assert got == sorted((d or 0, len(i), i) for d, t, _ in data for i in [library.encode_ordinary(t or "")])
    back = sorted((r.doc_id or 0, bytes(r.data)) for r in B.decode(out, path).collect())
    assert back == sorted((d or 0, (t or "").encode()) for d, t, _ in data)
    kept = B.encode(df.withColumnRenamed("ids", "other"), path, P.PATTERN, keep=("other", "text"))
    assert sorted((r.doc_id or 0, r.text or "", r.other or 0) for r in kept.collect()) == sorted((d or 0, t or "", o or 0) for d, t, o in data)
    assert B.encode(rows(SCHEMA, []), path, P.PATTERN).collect() == [] == B.digests(rows(SCHEMA, []), path, P.PATTERN).collect()


def test_query_equals_library(spark):
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sf = "/root/testdata/sf0.01"
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = {}
    for d, t in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode_ordinary(t)
        want[d] = (len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode()))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op6_byte_bpe(spark, sf).collect()}
    assert got == want


def test_workers_give_memory_back(monkeypatch):
    """Spark keeps Python workers; what a task has freed goes back to the system when it ends."""
    import pyarrow as pa
    from revlens.llm import common, ngram_join
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    texts = pa.array(["a b c d e f", None, ""])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), texts], ["doc_id", "text_key", "text"])
    got = list(ngram_join._features(4)(iter([batch])))
    assert calls == [1] and sum(b.num_rows for b in got) == 6
    monkeypatch.undo()
    common.give_back()
