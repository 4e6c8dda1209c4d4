"""Vectorised words of a batch of texts.

A word is a maximal run of bytes other than space and 0x09-0x0D.  All of them
are ASCII, so splitting UTF-8 bytes and splitting characters agree.  Words get
64-bit polynomial hashes over a table of random byte values: prefix sums of
``value[byte] * B**position`` (mod 2**64) give every word's hash from two
look-ups, with no Python loop over words or documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(0x5EED)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 2**64)
#: Bytes hashed at a time; a chunk ends at a space, so only a longer word makes a longer chunk.
CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


@dataclass
class Words:
    """Words of a batch: ``start``/``end`` byte offsets in ``data``, ``hash``;
    words of document ``d`` are ``first[d]:first[d + 1]``."""

    data: np.ndarray
    text_offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64) \
        if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo, hi = offsets[0], offsets[-1]
    return raw[lo:hi], offsets - lo


def split(texts: pa.Array, lower: bool) -> Words:
    """All words of a batch of texts (``lower``: hash with A-Z lower-cased)."""
    data, offsets = utf8(texts)
    n = len(data)
    space = SPACES[data]
    # a word starts after a space or at a text's first byte, and ends before a space or at the text's end
    inside = ~space
    begins = inside.copy()
    begins[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[heads] = inside[heads]
    ends = inside.copy()
    ends[:-1] &= space[1:]
    tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    ends[tails] = inside[tails]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    hashes = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):  # chunks of about CHUNK bytes, whole words each
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, "right")))
        a, b = start[lo], end[hi - 1]
        part = data[a:b]
        value = BYTE_VALUES[LOWER[part] if lower else part] * _power(BASE, b - a)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(value, out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        hashes[lo:hi] = (sums[e] - sums[s]) * _power(INVERSE, b - a)[s] + (e - s).astype(np.uint64)
        lo = hi
    return Words(data, offsets, start, end, mix(hashes), first)


_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = powers(base, max(n, CHUNK))
        if len(have) <= 1 << 24:
            _POWERS[base] = have
    return have[:n]


def grams(words: Words, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on; meaningless where fewer
    than ``k`` words of the same document are left."""
    h = words.hash
    out = np.zeros(len(h), np.uint64)
    if not len(h):
        return out
    for j in range(k):
        c = U(pow(BASE, 3 * j + 5, 2**64))
        m = len(h) - j
        if m > 0:
            out[:m] += h[j:] * c
    return mix(out)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of every document: (values sorted within
    each document, offsets).  A document of 1 to k-1 words has one shingle, its
    whole sequence; one without words has none."""
    n_docs = len(words.first) - 1
    counts = words.counts
    g = grams(words, k)
    room = np.repeat(words.first[1:], counts) - np.arange(len(g))
    take = room >= k
    short = np.flatnonzero((counts > 0) & (counts < k))
    doc = np.repeat(np.arange(n_docs), counts)[take]
    val = g[take]
    if len(short):
        # length-tagged hash of the whole short sequence
        extra = np.zeros(len(short), np.uint64)
        for i, d in enumerate(short):
            x = np.full(1, counts[d], np.uint64)
            for at in range(words.first[d], words.first[d + 1]):
                x = mix(x * U(31) + words.hash[at:at + 1])
            extra[i] = x[0]
        doc = np.concatenate([doc, short])
        val = np.concatenate([val, extra])
    order = np.lexsort((val, doc))
    doc, val = doc[order], val[order]
    new = np.ones(len(val), bool)
    new[1:] = (val[1:] != val[:-1]) | (doc[1:] != doc[:-1])
    doc, val = doc[new], val[new]
    return val, np.searchsorted(doc, np.arange(n_docs + 1))
