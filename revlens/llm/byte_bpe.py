"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Texts are cut by the tokenizer's pattern; every distinct piece of a task's
texts is encoded once.  All those pieces are merged together: an inverted index
holds, for the rank of each token pair, the positions where the pair stands;
ranks are taken in increasing order, every position of a rank is merged in one
vector operation, and only the pairs with the two touched neighbours are looked
up again.  A word's pairs merge lowest rank first and leftmost first, so the
tokens are those of merging each piece on its own.

Encoding is a map over the documents: no shuffle, and memory bounded by the
limits below whatever a task reads.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_ddl, give_back, only, record_batch, ship_package, table, thrifty

#: Distinct pieces replayed together, pieces held for texts that wait for it, and encoded pieces remembered.
NEW_PIECES, WAITING, REMEMBERED = 1 << 17, 6_000_000, 1_500_000
NO_RANK = np.int32(2**31 - 1)

_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class Vocabulary:
    """Ranks of byte strings, and the ranks that joining two tokens gives."""

    def __init__(self, data: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.bytes = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.names = [str(i).encode() for i in range(self.size)]
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        joins = sorted((self.ranks[t[:i]] * self.size + self.ranks[t[i:]], r) for t, r in self.ranks.items()
                       for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks)
        self.joins = np.array([k for k, _ in joins] + [2**62], np.int64)
        self.joined = np.array([r for _, r in joins] + [NO_RANK], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.joins, key)
        return np.where(self.joins[at] == key, self.joined[at], NO_RANK)

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


def replay(vocabulary: Vocabulary, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces (flat ids, offsets)."""
    whole = [vocabulary.ranks.get(p, -1) for p in pieces]
    lengths = np.array([len(p) if w < 0 else 1 for p, w in zip(pieces, whole)], np.int64)
    offsets = np.r_[0, np.cumsum(lengths)]
    raw = np.frombuffer(b"".join(p if w < 0 else b"\0" for p, w in zip(pieces, whole)), np.uint8)
    token = vocabulary.single[raw]
    known = np.array(whole, np.int64)
    token[offsets[:-1][known >= 0]] = known[known >= 0]  # a piece that is a token needs no merge
    n = len(token)
    word = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[offsets[1:][lengths > 0] - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[offsets[:-1][lengths > 0]] = -1
    rank = np.full(n, NO_RANK, np.int32)  # of the pair that starts at each position
    starts = np.flatnonzero(after >= 0)
    rank[starts] = vocabulary.pair_ranks(token[starts], token[starts + 1])

    index: dict[int, list] = {}
    heap: list[int] = []

    def put(positions: np.ndarray) -> None:
        ranks = rank[positions]
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, at in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts) if len(cuts) else [positions]):
            if r in index:
                index[r].append(at)
            else:
                index[r] = [at]
                heapq.heappush(heap, r)

    starts = starts[rank[starts] != NO_RANK]
    if len(starts):
        put(starts)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[rank[at] == r]
        if not len(at):
            continue
        w = word[at]
        repeated = np.flatnonzero(w[1:] == w[:-1]) + 1
        if len(repeated):  # of one word only the leftmost now: its merge may make a pair of lower rank
            rest = at[repeated]
            at = np.delete(at, repeated)
            index[r] = [rest]
            heapq.heappush(heap, r)
        gone = after[at]
        right = after[gone]
        token[at] = r
        rank[gone] = NO_RANK
        after[at] = right
        has = right >= 0
        before[right[has]] = at[has]
        rank[at] = NO_RANK
        a = at[has]
        rank[a] = vocabulary.pair_ranks(token[a], token[right[has]])
        left = before[at]
        left = left[left >= 0]
        rank[left] = vocabulary.pair_ranks(token[left], token[after[left]])
        token[gone] = -1
        new = np.concatenate([a, left])
        new = new[rank[new] != NO_RANK]
        if len(new):
            put(new)
    alive = token >= 0
    return token[alive], np.r_[0, np.cumsum(alive)][offsets]


class Encoder:
    """Encodes texts of one task; remembers the tokens of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.find = vocabulary, regex.compile(pattern).findall
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pieces(self, text: str) -> np.ndarray:
        number = self.number
        return np.array([number.setdefault(p, len(number)) for p in self.find(text)], np.int32)

    @property
    def new(self) -> int:
        return len(self.number) - len(self.start)

    def learn(self) -> None:
        """Encode the pieces that are not yet."""
        if self.new:
            fresh = [p.encode() for p in list(self.number)[len(self.start):]]
            ids, offsets = replay(self.vocabulary, fresh)
            self.start = np.r_[self.start, len(self.ids) + offsets[:-1]]
            self.length = np.r_[self.length, np.diff(offsets)]
            self.ids = np.r_[self.ids, ids]
            del fresh, ids, offsets
            give_back()

    def tokens(self, pieces: np.ndarray) -> np.ndarray:
        n = self.length[pieces]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.start[pieces] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts):
        """(row, token ids) of (row, text) pairs, in order."""
        waiting, held = [], 0
        for row, text in texts:
            pieces = self.pieces(text or "")
            waiting.append((row, pieces))
            held += len(pieces)
            if held > WAITING or self.new > NEW_PIECES:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting):
        self.learn()
        for row, pieces in waiting:
            yield row, self.tokens(pieces)
        if len(self.number) > REMEMBERED:
            self._forget()


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """One vocabulary per Python worker."""
    data = shared.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(data)
    return _LOADED[key]


def _texts(it, columns):
    for b in it:
        for row in zip(*(b.column(c) for c in columns), b.column("text")):
            yield row[:-1], row[-1].as_py()


def _shared(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary file: its size does not grow with the data
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text",
           keep: tuple[str, ...] = ()) -> DataFrame:
    """Token ids (doc_id, n_tokens, ids) of every text by the ranks file at
    ``path``, each match of ``pattern`` separately, without special tokens, and
    the input's ``keep`` columns.  A null or empty text has no tokens; every
    input row gives one row, whatever its doc_id; an empty table gives none.
    """
    ship_package(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)
    kept = [f"kept_{i}" for i in range(len(keep))]
    base = only(docs, doc_id=doc_id, text=text, **dict(zip(kept, keep)))
    fields = ["doc_id", *kept]
    ddl = "doc_id long, n_tokens long, ids array<int>" + "".join(f", {k} {base.schema[k].dataType.simpleString()}" for k in kept)

    def run(it):
        first = next(it, None)
        if first is None:
            return
        kinds = [first.schema.field(f).type for f in fields]
        rows = _texts(_chain(first, it), fields)
        encoder = Encoder(_vocabulary(shared), pattern)
        out, size = [], 0
        for row in encoder.encode(rows):
            out.append(row)
            size += len(row[1])
            if size > 1 << 20:
                yield _encoded(out, fields, kinds)
                out, size = [], 0
        yield _encoded(out, fields, kinds)
    return base.mapInArrow(thrifty(run), ddl).withColumnsRenamed(dict(zip(kept, keep)))


def _chain(first, it):
    yield first
    yield from it


def _encoded(rows, fields, kinds) -> pa.RecordBatch:
    lengths = [len(ids) for _, ids in rows]
    flat = np.concatenate([ids for _, ids in rows]) if rows else np.zeros(0, np.int32)
    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.array(flat, pa.int32()))
    columns = [pa.array([r[i].as_py() for r, _ in rows], k) for i, k in enumerate(kinds)]
    return pa.RecordBatch.from_arrays([columns[0], pa.array(lengths, pa.int64()), ids, *columns[1:]],
                                      names=["doc_id", "n_tokens", "ids", *fields[1:]])


def decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """The bytes (doc_id, data) of token ids; null ids are no tokens.  An id
    outside the vocabulary fails the job."""
    ship_package(encoded.sparkSession)
    shared = _shared(encoded.sparkSession, path)

    def run(it):
        v = _vocabulary(shared)
        for b in it:
            data = [v.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(data, pa.binary())], names=["doc_id", "data"])
    return only(encoded, doc_id=doc_id, ids=ids).mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space) and
    decoded_sha256 (of the bytes that the ids decode to) of every row."""
    ship_package(docs.sparkSession)
    shared = _shared(docs.sparkSession, path)

    def run(it):
        v = _vocabulary(shared)
        encoder = Encoder(v, pattern)
        out = []
        for (doc,), ids in encoder.encode(_texts(it, ["doc_id"])):
            ids = ids.tolist()
            out.append((doc.as_py(), len(ids), hashlib.sha256(b" ".join([v.names[i] for i in ids])).hexdigest(),
                        hashlib.sha256(v.decode(ids)).hexdigest()))
            if len(out) >= 1000:
                yield record_batch(_DIGESTS, *map(list, zip(*out)))
                out = []
        yield record_batch(_DIGESTS, *(map(list, zip(*out)) if out else [[]] * 4))
    return only(docs, doc_id=doc_id, text=text).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(thrifty(run), arrow_ddl(_DIGESTS))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by the public byte-level vocabulary of 50,256 ranks."""
    import public_tokenizers
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_byte_bpe": op6_byte_bpe}
