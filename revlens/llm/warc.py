"""WARC archives: writing pages as records and reading archives back.

Writing: a page is a ``response`` record whose block is an HTTP response with a
chunked body, or, when another page has the same payload, a ``revisit`` of the
page with the smallest page_id.  Blocks longer than ``segment_bytes`` are cut
into a first record and ``continuation`` records.  The archives are written by
Spark itself (records end in CRLF CRLF, the text writer's line separator).

Reading: archives are parsed record by record; continuation records are grouped
by their origin's identifier, ordered by segment number, verified against the
total length, and only then is the chunked transfer framing decoded.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_ddl, only, record_batch, table

VERSION = "WARC/1.1"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_RECORD = pa.schema([("value", pa.string())])
_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                   ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("status", pa.string()),
                   ("origin", pa.string()), ("segment", pa.int64()), ("total", pa.int64()), ("head", pa.binary()),
                   ("block", pa.binary())])


def digest32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _record(headers: list[tuple[str, object]], block: str) -> str:
    """A record without its ending."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    return f"{VERSION}\r\n{lines}Content-Length: {len(block.encode())}\r\n\r\n{block}"


def _records(page_id, url, html, sha1, refers_to, segment_bytes: int, chunk: int, twin: str | None = None):
    digest = digest32(sha1)
    name = lambda page: f"<urn:page:{'' if page is None else page}:{digest}>"
    own = name(page_id) if twin is None else f"{name(page_id)[:-1]}.{twin}>"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "") or None
    common = [("WARC-Record-ID", own), ("WARC-Target-URI", uri),
              ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http;msgtype=response"),
              ("WARC-Payload-Digest", f"sha1:{digest}")]
    status = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        block = f"{status}Content-Length: {len(html.encode())}{END}"
        yield _record([("WARC-Type", "revisit"), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))], block)
        return
    body = "".join(f"{len((c := html[i:i + chunk]).encode()):x}\r\n{c}\r\n" for i in range(0, len(html), chunk))
    block = f"{status}Transfer-Encoding: chunked{END}{body}0{END}"
    if len(block.encode()) <= segment_bytes:
        yield _record([("WARC-Type", "response"), *common], block)
        return
    size = max(1, segment_bytes // 4)  # characters of at most four bytes
    parts = [block[i:i + size] for i in range(0, len(block), size)]
    for n, part in enumerate(parts, 1):
        if n == 1:
            yield _record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"{own[:-1]}:{n}>"),
                           ("WARC-Segment-Number", n), ("WARC-Segment-Origin-ID", own),
                           ("WARC-Segment-Total-Length", len(block.encode()) if n == len(parts) else None)], part)


def _written(segment_bytes: int, chunk: int):
    def run(it):
        for b in it:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha1", "refers_to", "twin")]
            out, size = [], 0
            for *row, twin in zip(*columns):
                for r in _records(*row, segment_bytes, chunk, twin):
                    out.append(r)
                    size += len(r)
                if size > 1 << 24:
                    yield record_batch(_RECORD, out)
                    out, size = [], 0
            if out:
                yield record_batch(_RECORD, out)
    return run


def write_archives(pages: DataFrame, path: str, segment_bytes: int = 1 << 16, chunk: int = 8192,
                   revisit_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per page (and its continuations) as gzip WARC files under ``path``.

    The payload is the html in UTF-8; null is empty.  Of pages with equal
    payloads of at least ``revisit_bytes`` the one with the smallest page_id is
    the response, the others revisit it.  Rows that agree in page_id,
    url and payload are one page and written once (of several urls, all but
    the smallest have its hash in the record's identifier); a null page_id comes after all
    others; a null url is left out.  An empty table gives no archive.
    """
    spark = pages.sparkSession
    s = Scratch(spark, "warc-digests")
    base = only(pages, page_id=page_id, url=url, html=html).withColumn("html", F.coalesce("html", F.lit("")))
    base = base.withColumn("sha1", F.sha1("html"))
    digests = s.write(base.select("page_id", "sha1", F.octet_length("html").alias("bytes")), "digests")
    same = digests.groupBy("sha1").agg(F.min("page_id").alias("first"), F.min("bytes").alias("bytes"),
                                       F.count(F.lit(1)).alias("n")).where(f"n > 1 and bytes >= {int(revisit_bytes)}")
    refers = (digests.select("page_id", "sha1").join(same.select("sha1", "first"), "sha1")
              .where(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
              .select(F.col("page_id").alias("id"), F.col("sha1").alias("key"), F.col("first").alias("refers_to")))
    refers = s.write(refers, "refers")
    if digests.groupBy("page_id", "sha1").agg(F.count(F.lit(1)).alias("n")).where("n > 1").head(1):
        # the smallest url has the plain identifier, which revisits refer to
        least = (base.select("page_id", "sha1", "url").distinct().groupBy("page_id", "sha1")
                 .agg(F.min(F.struct("url")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
        least = s.write(least.select(F.col("page_id").alias("of"), F.col("sha1").alias("with"), F.col("least.url").alias("plain")), "twins")
        base = (base.dropDuplicates(["page_id", "url", "sha1"])
                .join(least, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha1") == F.col("with")), "left")
                .withColumn("twin", F.when(F.col("with").isNotNull() & ~F.col("url").eqNullSafe(F.col("plain")), F.hex(F.xxhash64("url")))))
    else:
        base = base.withColumn("twin", F.lit(None).cast("string"))
    rows = base.join(refers, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("sha1") == F.col("key")), "left")
    (rows.select("page_id", "url", "html", "sha1", "refers_to", "twin")
     .mapInArrow(_written(segment_bytes, chunk), arrow_ddl(_RECORD))
     .write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", 10_000).text(path))
    s.drop("digests")
    s.drop("refers")
    s.drop("twins")


def _inflated(content: bytes, step: int = 1 << 20):
    """Pieces of an archive's bytes, gzip (one member or many) or plain."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content:
        z = zlib.decompressobj(31)
        while content and not z.eof:
            piece, content = content[:step], content[step:]
            yield z.decompress(piece)
        content = z.unused_data + content


class _Buffer:
    """Bytes of an archive, taken from its pieces as they are needed."""

    def __init__(self, pieces):
        self.pieces, self.data, self.at = pieces, b"", 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.data, self.at = self.data[self.at:] + piece, 0
        return True

    def until(self, mark: bytes):
        while (end := self.data.find(mark, self.at)) < 0:
            if not self.more():
                return None
        out, self.at = self.data[self.at:end], end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) - self.at < n and self.more():
            pass
        out, self.at = self.data[self.at:self.at + n], min(len(self.data), self.at + n)
        return out


def records(content: bytes):
    """(headers, block) of every record of an archive; a cut last block stays short."""
    buffer = _Buffer(_inflated(content))
    while (head := buffer.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = buffer.take(int(headers.get("content-length") or 0))
        yield headers, block
        buffer.take(4)


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        try:
            size = int(body[at:end].split(b";")[0], 16) if end >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or len(body) < end + 4 + size:
            return None
        if size == 0:
            return b"".join(out)
        out.append(body[end + 2:end + 2 + size])
        at = end + 4 + size


def _payload(block: bytes):
    """(HTTP headers, payload or None) of a record's block."""
    head, _, body = block.partition(b"\r\n\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    return headers, unchunked(body) if headers.get("transfer-encoding", "").lower() == "chunked" else body


def _page(urn: str | None):
    parts = (urn or "").strip("<>").split(":")
    return int(parts[2]) if len(parts) > 2 and parts[2] else None


def _result(headers: dict, block: bytes, status: str | None = None) -> tuple:
    """Row of a whole record, without the segment columns."""
    declared = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    kind = headers.get("warc-type")
    http, payload = _payload(block)
    if status is None and kind == "revisit":
        size, digest, status = int(http.get("content-length") or 0), declared, "ok"
    elif status is None and payload is not None:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        status = "ok" if digest == declared else "other digest"
    else:
        size, digest, status = None, None, status or "broken framing"
    return (_page(headers.get("warc-record-id")), size, digest, kind, _page(headers.get("warc-refers-to")),
            headers.get("warc-target-uri"), status)


def _parsed(it):
    for b in it:
        for content in b.column("content"):
            rows, size = [], 0
            for headers, block in records(content.as_py()):
                number = headers.get("warc-segment-number")
                if number is None:
                    whole = len(block) == int(headers.get("content-length") or 0)
                    rows.append((*_result(headers, block, None if whole else "incomplete"), None, None, None, None, None))
                else:
                    origin = headers.get("warc-segment-origin-id") or headers.get("warc-record-id")
                    total = headers.get("warc-segment-total-length")
                    head = "\r\n".join(f"{k}: {v}" for k, v in headers.items()).encode() if number == "1" else None
                    rows.append((*[None] * 7, origin, int(number), int(total) if total else None, head, block))
                    size += len(block)
                if len(rows) >= 10_000 or size > 1 << 24:
                    yield record_batch(_READ, *map(list, zip(*rows)))
                    rows, size = [], 0
            if rows:
                yield record_batch(_READ, *map(list, zip(*rows)))


def _reassembled(it):
    for b in it:
        rows = []
        for origin, parts in zip(b.column("origin").to_pylist(), b.column("parts")):
            parts = {p["segment"]: p for p in parts.as_py()}  # a repeated segment counts once
            block = b"".join(parts[n]["block"] for n in sorted(parts))
            head = parts.get(1, {}).get("head") or f"warc-record-id: {origin}".encode()
            headers = {k: v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n"))}
            whole = sorted(parts) == list(range(1, len(parts) + 1)) and parts[len(parts)]["total"] == len(block)
            rows.append((*_result(headers, block, None if whole else "incomplete"), None, None, None, None, None))
        yield record_batch(_READ, *map(list, zip(*rows))) if rows else record_batch(_READ, *[[]] * len(_READ))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit record under ``path``: page_id,
    payload_bytes, payload_digest, record_type, refers_to, url, status.

    ``status`` is ok, or what is wrong: "incomplete" (segments or bytes are
    missing, or the total length differs), "broken framing", "other digest"
    (the payload is not the one declared); the payload columns are null for the
    first two.  A revisit reports the size and digest that its record declares.
    """
    s = Scratch(spark, "warc-records")
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = s.write(files.mapInArrow(_parsed, arrow_ddl(_READ)), "parsed")
    result = [f.name for f in _READ][:7]
    whole = parsed.where("origin is null").select(*result)
    segments = parsed.where("origin is not null")
    joined = (segments.groupBy("origin").agg(F.collect_list(F.struct("segment", "total", "head", "block")).alias("parts"))
              .mapInArrow(_reassembled, arrow_ddl(_READ)).select(*result))
    return whole.union(joined)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ``pages`` as archives, then read the archives back."""
    s = Scratch(spark, "archives")
    pages = table(spark, sf_dir, "pages")
    write_archives(pages, f"{s.base}/warc")
    if not pages.head(1):
        return spark.createDataFrame([], arrow_ddl(_READ)).select([f.name for f in _READ][:7])
    return read_archives(spark, f"{s.base}/warc")


QUERIES = {"op4_warc": op4_warc}

ORACLE_SQL = {"op4_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
first AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(p.h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN p.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id = first THEN NULL ELSE first END AS refers_to, p.url, 'ok' AS status
FROM p JOIN first ON p.h = first.h
"""}
