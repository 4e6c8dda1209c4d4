import base64
import gzip
import hashlib

from revlens.llm import warc as A

SCHEMA = "page_id long, url string, html string"


def want(pages):
    """{page_id: (bytes, digest, type, refers_to)}"""
    first = {}
    for p, _, h in sorted(pages):
        first.setdefault(h or "", p)
    return {p: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                "response" if first[h or ""] == p else "revisit", None if first[h or ""] == p else first[h or ""])
            for p, _, h in pages}


def got(df):
    return {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()}


def round_trip(spark, df, path, **kw):
    A.write_archives(df, path, **kw)
    return A.read_archives(spark, path)


def test_round_trip(spark, rows, tmp_path):
    pages = [(1, "http://a/", "é€𝄞" * 3000), (2, "http://b/\r\nX: y", "x"), (3, None, None), (4, "", ""), (5, "u", "x"), (0, "z", "x"),
             (6, "v", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n0\r\n\r\n"), (7, "w", "é€𝄞" * 3000), (8, "w", "a" * 1000)]
    df = rows(SCHEMA + ", sha1 int", [(*p, 1) for p in pages])
    for i, size in enumerate((64, 1000, 1 << 20)):
        out = round_trip(spark, df, f"{tmp_path}/{i}", segment_bytes=size, chunk=100)
        assert got(out) == want(pages)
        assert {r.status for r in out.collect()} == {"ok"}


def test_edge_rows(spark, rows, tmp_path):
    df = rows(SCHEMA, [(1, "a", "x"), (1, "a", "x"), (1, "b", "y"), (None, "c", "y"), (None, "c", "z")])
    out = sorted(((r.page_id, r.record_type, r.refers_to) for r in round_trip(spark, df, f"{tmp_path}/w").collect()), key=str)
    assert out == sorted([(1, "response", None), (1, "response", None), (None, "revisit", 1), (None, "response", None)], key=str)
    small = rows(SCHEMA, [(1, "a", "xx"), (2, "a", "xx"), (3, "a", "xxx"), (4, "a", "xxx")])
    out = got(round_trip(spark, small, f"{tmp_path}/small", revisit_bytes=3))
    assert [out[i][2] for i in (1, 2, 3, 4)] == ["response", "response", "response", "revisit"]


def test_equal_payloads_of_other_urls(spark, rows, tmp_path):
    """Rows that agree in page_id and payload but not in the url are pages of their own, in segments too."""
    pages = [(1, "a", "x" * 99), (1, "b", "x" * 99), (1, None, "x" * 99), (2, "a", "x" * 99), (2, "c", "x" * 99), (None, "d", "y"), (None, "e", "y")]
    for i, size in enumerate((64, 1 << 16)):
        out = round_trip(spark, rows(SCHEMA, pages), f"{tmp_path}/{i}", segment_bytes=size, chunk=10).collect()
        assert sorted(((r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to, r.status) for r in out), key=str) == sorted(
            ((p, u, len(h), "revisit" if p == 2 else "response", 1 if p == 2 else None, "ok") for p, u, h in pages), key=str)
        heads = [h for f in (tmp_path / str(i)).glob("*.gz") for h, _ in A.records(f.read_bytes())]
        ids = [h["warc-record-id"] for h in heads]
        assert len(set(ids)) == len(ids) and {h["warc-refers-to"] for h in heads if "warc-refers-to" in h} <= set(ids)


def test_damaged_archives(spark, tmp_path):
    """Segments in any order and file are reassembled; a lost, cut or altered one is told."""
    html = "h" * 500
    sha = hashlib.sha1(html.encode()).hexdigest()
    recs = lambda page: [r + A.END for r in A._records(page, "u", html, sha, None, 200, 50)]
    assert len(recs(1)) > 3
    one, two, three, four = recs(1), recs(2), recs(3), recs(4)
    del two[2]
    three[1] = three[1].replace("hhh", "xhh", 1)
    files = {"a": one[::2] + two, "b": one[1::2][::-1] + three, "c": four[::-1] + [one[1]]}
    for n, part in files.items():
        data = "".join(part).encode()
        (tmp_path / f"{n}.warc.gz").write_bytes(b"".join(gzip.compress(p.encode()) for p in part) if n == "a" else data)
    (tmp_path / "d.warc").write_bytes("".join(A._records(5, "u", "abc", hashlib.sha1(b"abc").hexdigest(), None, 9999, 50)).encode()[:-9])
    out = {r.page_id: (r.status, r.payload_bytes) for r in A.read_archives(spark, str(tmp_path)).collect()}
    assert out == {1: ("ok", 500), 2: ("incomplete", None), 3: ("other digest", 500), 4: ("ok", 500), 5: ("incomplete", None)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got(A.op4_warc(spark, sf)) == want(pages)
