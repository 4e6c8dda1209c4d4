"""Secret scans with structural confirmation.

Plain patterns give the base spans: assignments to a password-like name, cloud
access key ids and long hexadecimal strings.  Beside them, base64, hexadecimal
and dotted candidates are decoded and reported only if what they decode to has
the structure of a secret: a DER private key whose nested lengths add up, an
OpenSSH key container whose length-prefixed strings fill it, or a signed token
whose header names an algorithm that fits the length of its signature.  The
outer length also tells where a wrapped key ends.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ddl, only, record_batch, table, text_slices
from ..session import ship_package

# The base patterns, each with the least length of what it must hold.
ASSIGN = re.compile("""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # of the maximal runs those of 24 or more
ASSIGNED, ACCESS_ID = 6, 20
#: All kinds, in the order of equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "der", "ssh", "jwt")
BASE = KINDS[:3]

# Candidates of the structural kinds.  A wrapped one goes on over line breaks, also escaped ones.
_BASE64 = re.compile(r"(?:(?<![A-Za-z0-9+/_\\-])|(?<=\\n))[A-Za-z0-9+/_-]{40,}+(?:(?:\r?\n|(?:\\r)?\\n)[ \t]*+[A-Za-z0-9+/]++)*+={0,2}")
_HEXDUMP = re.compile(r"(?<![0-9A-Za-z])30[0-9a-fA-F]{58,}+")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(ey[A-Za-z0-9_-]++)\.(ey[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)(?!\.[A-Za-z0-9_-])")
_BREAK = re.compile(r"(?:\s|\\[rn])+")
# Bytes of a signature by algorithm (RSA: at least).
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64}
_RSA, _RSA_LEAST = {"RS256", "RS384", "RS512", "PS256", "PS384", "PS512"}, 128
_OPENSSH = b"openssh-key-v1\0"
_INTEGER, _BITS, _OCTETS, _NULL, _OID, _SEQUENCE = 2, 3, 4, 5, 6, 0x30
_ENCRYPTION = bytes.fromhex("2a864886f70d01")  # the arc of password-based encryption schemes

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("kinds", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())),
                     ("ends", pa.list_(pa.int64())), ("details", pa.list_(pa.string()))])


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first byte, byte after the last) of the DER element at ``at``, None
    where its length is not minimal or passes ``end``."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n, at = int.from_bytes(data[at:at + k]), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= end else None


def _elements(data: bytes, at: int, end: int, most: int = 16) -> list[tuple[int, int, int]] | None:
    """The elements that exactly fill at..end, None where they do not."""
    out = []
    while at < end:
        e = _header(data, at, end)
        if e is None or len(out) == most:
            return None
        out.append(e)
        at = e[2]
    return out


def der_key(data: bytes) -> tuple[str, int] | None:
    """(kind of private key, its length in bytes) if ``data`` starts with one."""
    outer = _header(data, 0, len(data))
    parts = _elements(data, *outer[1:]) if outer and outer[0] == _SEQUENCE else None
    if not parts or len(parts) < 2:
        return None
    tags = [t for t, _, _ in parts]
    value = [data[a:b] for _, a, b in parts]
    length = [len(v) for v in value]

    def algorithm(k):
        inner = _elements(data, *parts[k][1:])
        return bool(inner) and inner[0][0] == _OID and inner[0][2] - inner[0][1] >= 3 and value[k][2:]

    kind = None
    if tags[0] == _INTEGER and value[0] in (b"\0", b"\1"):
        if tags[:9] == [_INTEGER] * 9 and length[1] >= 64 and length[3] > 4 and max(length[4:9]) <= length[1] and min(length[4:9]) > 4:
            kind = "rsa"
        elif tags == [_INTEGER] * 6 and length[1] >= 64 and length[2] >= 20 and 0 < length[5] <= length[2]:
            kind = "dsa"
        elif tags[1] == _OCTETS and value[0] == b"\1" and 16 <= length[1] <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
            kind = "ec"
        elif tags[1:3] == [_SEQUENCE, _OCTETS] and algorithm(1) and length[2] >= 16 and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
            kind = "pkcs8"
    elif tags == [_SEQUENCE, _OCTETS] and algorithm(0) and algorithm(0).startswith(_ENCRYPTION) and length[1] >= 16:
        kind = "pkcs8-encrypted"
    return kind and (kind, outer[2])


def ssh_key(data: bytes) -> tuple[str, int] | None:
    """(cipher, length in bytes) if ``data`` starts with an OpenSSH private key."""
    if not data.startswith(_OPENSSH):
        return None
    at = len(_OPENSSH)

    def string():
        nonlocal at
        n = int.from_bytes(data[at:at + 4])
        if at + 4 + n > len(data):
            raise ValueError("too short")
        at += 4 + n
        return data[at - n:at]

    try:
        cipher, kdf, options = string(), string(), string()
        count, at = int.from_bytes(data[at:at + 4]), at + 4
        if not 1 <= count <= 16 or (cipher == b"none") != (kdf == b"none") or (kdf == b"none" and options):
            return None
        public = [string() for _ in range(count)]
        private = string()
    except ValueError:
        return None
    if any(len(p) < 16 for p in public) or len(private) < 16 or len(private) % 8:
        return None
    if cipher == b"none" and private[:4] != private[4:8]:  # the two check numbers
        return None
    return cipher.decode("ascii", "replace"), at


def _json(part: str):
    try:
        return json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, RecursionError):
        return None


def signed_token(header: str, payload: str, signature: str) -> str | None:
    """The algorithm of a signed token, None where the three parts are none."""
    head = _json(header)
    name = head.get("alg") if isinstance(head, dict) else None
    if not isinstance(name, str) or not isinstance(_json(payload), dict) or len(signature) % 4 == 1:
        return None
    n = len(signature) * 3 // 4
    return name if _SIGNATURE.get(name) == n or name in _RSA and n >= _RSA_LEAST else None


def _keys(text: str):
    """(kind, start, end, detail) of base64 private keys."""
    for m in _BASE64.finditer(text):
        found = m.group()
        if not found.startswith(("M", "b3BlbnNzaC1rZXktdjEA")):  # a sequence's tag, the container's name
            continue
        packed = _BREAK.sub("", found).rstrip("=").replace("-", "+").replace("_", "/")
        if len(packed) % 4 == 1:  # never the end of an encoding; a following line may have joined
            packed = packed[:-1]
        data = base64.b64decode(packed + "=" * (-len(packed) % 4))
        kind, key = ("ssh", ssh_key(data)) if found[0] == "b" else ("der", der_key(data))
        if key:
            # the characters that hold the key's bytes, and the padding after them
            left, at = -(-key[1] * 4 // 3), 0
            while left:
                gap = _BREAK.match(found, at)
                at, left = (gap.end(), left) if gap else (at + 1, left - 1)
            while at < len(found) and found[at] == "=":
                at += 1
            yield kind, m.start(), m.start() + at, key[0]


def _dumps(text: str):
    for m in _HEXDUMP.finditer(text):
        found = m.group()
        key = der_key(binascii.unhexlify(found[:len(found) & ~1]))
        if key:
            yield "der", m.start(), m.start() + 2 * key[1], key[0]


def spans(text: str) -> list[tuple[str, int, int, str]]:
    """All spans of a text by start, then kind as listed, in code points."""
    out = [("assign", *m.span(), m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGNED]
    out += [("access", *m.span(), "") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_ID]
    out += [("hex", *m.span(), "") for m in HEX.finditer(text)]
    out += _keys(text)
    out += _dumps(text)
    for m in _TOKEN.finditer(text):
        name = signed_token(*m.groups())
        if name:
            out.append(("jwt", *m.span(), name))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scanned(it):
    for b in text_slices(it):
        found = [spans(t or "") for t in b.column("text").to_pylist()]
        columns = [[[s[k] for s in row] for row in found] for k in range(4)]
        yield record_batch(_SCHEMA, b.column("doc_id"), *columns)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every whole text: doc_id and ``spans``, an array of (kind,
    start, end, detail) by start, then kind (``KINDS``); offsets are code
    points, ends exclusive.  ``detail`` is the assigned name, the kind of key,
    the cipher or the token's algorithm.

    One row per input row, with an empty array for a text that is null, empty
    or has none; repeated rows and null ids stay.  Spans of different kinds may
    overlap.  Other columns are ignored; an empty table gives none.
    """
    ship_package(docs.sparkSession)
    found = only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(_scanned, arrow_ddl(_SCHEMA))
    zipped = F.arrays_zip(F.col("kinds").alias("kind"), F.col("starts").alias("start"), F.col("ends").alias("end"),
                          F.col("details").alias("detail"))
    return found.select("doc_id", zipped.alias("spans"))


def listing(found: Column) -> Column:
    """kind:start:end of an array of spans, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all of ``documents``."""
    found = scan(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *(number(k) for k in BASE), F.sha2(listing(base).cast("binary"), 256).alias("base_sha256"),
                        listing(F.col("spans")).alias("spans"))


QUERIES = {"op13_secret_scan": op13_secret_scan}
