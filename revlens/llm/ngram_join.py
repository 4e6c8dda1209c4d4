"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct k-word shingles; the *tokens* of the join
are those shingles.  Two sets x, y with J(x, y) >= t lack at most
``e(x) = floor((1 - t)|x|)`` of x's tokens, so with one global order (rare
tokens first) the prefixes of ``e + 1`` tokens share a token.  Rare tokens are
indexed singly.  A set with at most ``e`` rare tokens has its prefix extended
over its *frequent* tokens, which are indexed as combinations: the frequent
tokens are dealt by hash into parts of a few tokens, one part must itself reach
Jaccard t (the parts' ``intersection - t * union`` add up), and that part's
prefix of ``e(part) + 2`` tokens then shares a two-token combination, or, in a
part too small for any difference, the combination of all its tokens.

* Frequent tokens come from mergeable Misra-Gries counts over all documents.
  The counts only choose which tokens are called frequent; the join is exact
  for any choice.
* Sets are compared once: equal sets are one class from the start.  Within the
  documents of a signature, links are first sought to one centre and to each
  set's most promising partners; all pairs still in different components are
  then tested, so a group of copies costs its size, not its square.
* Every candidate pair that the sizes and bucket counts of its sets (a bound of the
  intersection that is never too small) cannot rule out is verified on its texts.

Sets and tokens are identified by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, arrow_ddl, in_buckets, only, record_batch, runs, table, text_slices, thrifty
from .components import components

#: Entries of a Misra-Gries summary: per task, and of the merged table that is broadcast (2 MB).
TASK_TOKENS, FREQUENT_TOKENS = 1 << 16, 1 << 18
#: A token counted at least so often is frequent.
FREQUENT = 16
#: Frequent tokens in a part, on average.
PART = 4
#: Sets from which a signature's group is compared in place, and sets of one block of it.
LARGE_GROUP, GROUP_BLOCK = 16, 2048
#: Partners that a set of a large group proposes in each round before all remaining pairs are tested.
PROMISING = (1, 4)
#: Smallest signatures of large groups that a set names, and of these the ones told apart in a group.
NAMED, MARKS = 8, 64

_FEATURES = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
                       ("digest", pa.binary()), ("token", pa.int64()), ("count", pa.int64())])
_SIGNATURES = pa.schema([("sig", pa.int64()), ("node", pa.int64())])
_PROPOSED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("n", pa.int64())])
_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("united", pa.int64())])


def node_hash(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash per set (order-free sum of mixed tokens, mixed with the size)."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(W.mix(values ^ W.U(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    return W.mix(sums[offsets[1:]] - sums[offsets[:-1]] + np.diff(offsets).astype(np.uint64) * W.U(0x9E3779B97F4A7C15))


def digest(values: np.ndarray) -> bytes | None:
    """Counts of the set's tokens in about |set| / 2 hash buckets, four bits each;
    None if a count has more.  The smaller counts of two sets, bucket by bucket,
    add up to no less than their intersection."""
    m = max(2, 1 << max(0, (len(values) - 1).bit_length() - 1))
    counts = np.bincount((W.mix(values) & W.U(m - 1)).astype(np.int64), minlength=m)
    return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes() if counts.max(initial=0) < 16 else None


def counts_of(d: bytes) -> np.ndarray:
    """The bucket counts of a digest."""
    p = np.frombuffer(d, np.uint8)
    return np.stack([p & 15, p >> 4], 1).ravel()


def most_shared(x: bytes | None, y: bytes | None) -> int | None:
    """Upper bound of the intersection of two sets, from their digests."""
    if x is None or y is None:
        return None
    x, y = counts_of(x), counts_of(y)
    while len(x) != len(y):  # fold the longer one
        x, y = (x, y) if len(x) > len(y) else (y, x)
        x = x.reshape(2, -1).sum(0)
    return int(np.minimum(x, y).sum())


class Summary:
    """Misra-Gries counts: at most ``size`` tokens, each counted low by at most
    the subtracted total."""

    def __init__(self, size: int):
        self.size, self.pending, self.waiting = size, [], 0
        self.tokens, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, tokens: np.ndarray) -> None:
        self.pending.append(tokens)
        self.waiting += len(tokens)
        if self.waiting > 1 << 18:
            self.fold()

    def fold(self) -> None:
        if self.pending:
            t, c = np.unique(np.concatenate(self.pending), return_counts=True)
            self.pending, self.waiting = [], 0
            t = np.concatenate([self.tokens, t])
            c = np.concatenate([self.counts, c])
            order = np.argsort(t, kind="stable")
            t, c = t[order], c[order]
            heads = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
            self.tokens, self.counts = t[heads], np.add.reduceat(c, heads) if len(heads) else c
        if len(self.tokens) > self.size:
            least = np.partition(self.counts, len(self.counts) - self.size - 1)[len(self.counts) - self.size - 1]
            keep = self.counts > least
            self.tokens, self.counts = self.tokens[keep], self.counts[keep] - least


def _features(k: int):
    def run(it):
        summary, seen = Summary(TASK_TOKENS), set()
        for b in text_slices(it):
            values, offsets = W.shingle_sets(W.split(b.column("text"), lower=True), k)
            sizes, nodes = np.diff(offsets), node_hash(values, offsets)
            new = np.array([not (x in seen or seen.add(x)) for x in nodes.tolist()], bool)
            summary.add(values[np.repeat(new, sizes)])
            none = pa.nulls(b.num_rows, pa.int64())
            yield record_batch(_FEATURES, b.column("doc_id"), b.column("text_key"), nodes.view(np.int64), sizes,
                               [digest(values[offsets[i]:offsets[i + 1]]) for i in range(b.num_rows)], none, none)
        summary.fold()
        none = pa.nulls(len(summary.tokens), pa.int64())
        yield record_batch(_FEATURES, none, none, none, none, pa.nulls(len(none), pa.binary()), summary.tokens.view(np.int64), summary.counts)
    return thrifty(run)


def _parts_of(n: int) -> int:
    """Number of parts for a set of n tokens (a power of two)."""
    return 1 << max(0, (int(n) // PART).bit_length() - 1)


def _combinations(x: np.ndarray, num: int, den: int, parts: int, out: list) -> None:
    """Signatures of the frequent tokens ``x`` (sorted) dealt into ``parts``."""
    part = (W.mix(x ^ W.U(parts)) & W.U(parts - 1)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    x, part = x[order], part[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        f, p = hi - lo, np.array([int(part[lo]) * 2 * parts + 1], np.uint64)
        if f * (den - num) < num:  # a partner's part is equal
            out.append(W.mix(W.mix(x[lo:hi]).sum(keepdims=True) + p * W.U(0xD6E8FEB86659FD93)))
        else:
            prefix = x[lo:lo + f * (den - num) // den + 2]
            i, j = np.triu_indices(len(prefix), 1)
            out.append(W.mix(W.mix(prefix[i]) + prefix[j] * W.U(0xC2B2AE3D27D4EB4F) + p))


def _signatures(k: int, num: int, den: int, frequent):
    def run(it):
        heavy, seen = frequent.value, set()
        filter_ = np.zeros(1 << 20, bool)
        filter_[(heavy & W.U((1 << 20) - 1)).astype(np.int64)] = True
        for b in text_slices(it):
            values, offsets = W.shingle_sets(W.split(b.column("text"), lower=True), k)
            sizes, nodes = np.diff(offsets), node_hash(values, offsets)
            new = np.array([n > 0 and not (x in seen or seen.add(x)) for x, n in zip(nodes.tolist(), sizes.tolist())], bool)
            maybe = np.flatnonzero(filter_[(values & W.U((1 << 20) - 1)).astype(np.int64)])
            often = np.zeros(len(values), bool)
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, values[maybe]), len(heavy) - 1)
                often[maybe] = heavy[at] == values[maybe]
            rare_before = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~often, out=rare_before[1:])
            spare = sizes * (den - num) // den  # e
            rare = rare_before[offsets[1:]] - rare_before[offsets[:-1]]
            rank = rare_before[:-1] - np.repeat(rare_before[offsets[:-1]], sizes)
            take = ~often & (rank <= np.repeat(spare, sizes)) & np.repeat(new, sizes)
            sig, node = [values[take]], [np.repeat(nodes, sizes)[take]]
            for d in np.flatnonzero(new & (rare <= spare)):
                lo, hi, n = offsets[d], offsets[d + 1], int(sizes[d])
                found = []
                # a partner has n * t to n / t tokens, so it may use another number of parts
                for parts in sorted({_parts_of(m) for m in (-(-n * num // den), n, n * den // num)}):
                    _combinations(values[lo:hi][often[lo:hi]], num, den, parts, found)
                sig += found
                node.append(np.full(sum(map(len, found)), nodes[d]))
            yield record_batch(_SIGNATURES, np.concatenate(sig).view(np.int64), np.concatenate(node).view(np.int64))
    return thrifty(run)


def _possible(num: int, den: int):
    def run(it):
        for b in it:
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            shared = [most_shared(x, y) for x, y in zip(b.column("da").to_pylist(), b.column("db").to_pylist())]
            keep = [s is None or den * s >= num * (int(x) + int(y) - s) for s, x, y in zip(shared, na, nb)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return thrifty(run)


def _possible_in_groups(num: int, den: int, best: int | None):
    """Pairs of different components in a signature's group that sizes and
    digests allow; with ``best``, for each set only its most promising partners
    of no smaller size, and beside the pairs (a, b) the sets of pairs that are not
    proposed (a, no b, sig, n): no other ones can still link in this group.  Two sets
    that both name a smaller signature meet in that signature's group, so sets that
    share many signatures are one pair, not one a group."""
    def run(it):
        out, left, held = [], [], 0
        for group in runs(it, ["sig", "one", "two"]):
            pairs, rest = _group_pairs(group, num, den, best)
            out.append(pairs)
            left.append(rest)
            held += len(pairs) + len(rest)
            if held > 1 << 20:
                yield _pair_batch(out, left)
                out, left, held = [], [], 0
        yield _pair_batch(out, left)
    return thrifty(run)


def _pair_batch(pairs: list, left: list) -> pa.RecordBatch:
    p = np.unique(np.concatenate([*pairs, np.zeros((0, 2), np.int64)]), axis=0)
    r = np.concatenate([*left, np.zeros((0, 3), np.int64)])
    of_pairs, of_sets = np.arange(len(p) + len(r)) >= len(p), np.arange(len(p) + len(r)) < len(p)
    return record_batch(_PROPOSED, np.r_[p[:, 0], r[:, 0]], pa.array(np.r_[p[:, 1], r[:, 0]], mask=of_pairs),
                        pa.array(np.r_[p[:, 0], r[:, 1]], mask=of_sets), pa.array(np.r_[p[:, 0], r[:, 2]], mask=of_sets))


def _in_few(num: int, den: int, most: int):
    """Pairs of different components whose sizes allow the threshold, in groups
    of fewer than ``most`` rows that come sorted by signature."""
    def run(it):
        last = np.zeros((4, 0), np.int64)  # rows whose group may go on
        for b in it:
            x = np.hstack([last, np.stack([b.column(c).to_numpy() for c in ("sig", "node", "n", "root")])])
            sig, node, n, root = x
            out = [np.zeros((0, 2), np.int64)]
            for d in range(1, min(most, len(sig))):
                i = np.flatnonzero(sig[d:] == sig[:-d])
                if not len(i):
                    break
                i = i[i + d >= last.shape[1]]
                i = i[(root[i] != root[i + d]) & (np.minimum(n[i], n[i + d]) * den >= np.maximum(n[i], n[i + d]) * num)]
                out.append(np.stack([np.minimum(node[i], node[i + d]), np.maximum(node[i], node[i + d])], 1))
            last = x[:, max(0, len(sig) - most + 1):]
            p = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])
    return thrifty(run)


def _group_pairs(group: pa.Table, num: int, den: int, best: int | None) -> tuple[np.ndarray, np.ndarray]:
    n = group.column("n").to_numpy()
    order = np.argsort(n, kind="stable")
    n = n[order]
    node, root, block = (group.column(c).to_numpy()[order] for c in ("node", "root", "block"))
    digests = group.column("digest").take(pa.array(order)).to_pylist()
    one, two = group.column("one")[0].as_py(), group.column("two")[0].as_py()
    marks = _marks(group.column("named").combine_chunks().take(pa.array(order)), group.column("sig")[0].as_py())
    upto = np.searchsorted(n, n * den // num, "right")  # partners of a size that is not less
    lengths = np.array([0 if d is None else 2 * len(d) for d in digests])
    found, rest = [], np.zeros(len(n), bool)
    matrix, row_of, wide = None, None, -1
    for i in range(len(n)):
        j = np.arange(i + 1, upto[i])
        j = j[root[j] != root[i]]
        if one != two:
            j = j[block[j] != block[i]]
        j = j[(marks[j] & marks[i]) == 0]
        if not len(j):
            continue
        bound = np.full(len(j), n[i])  # all of the smaller set
        sure = (lengths[j] == 0) | (lengths[i] == 0)
        at = np.flatnonzero(~sure)
        if len(at):
            if lengths[i] != wide:  # sizes ascend, so each number of buckets comes once
                wide = lengths[i]
                rows = np.flatnonzero((lengths == wide) | (lengths == 2 * wide))
                matrix = np.stack([c if len(c) == wide else c.reshape(2, -1).sum(0, dtype=np.uint8)
                                   for c in (counts_of(digests[r]) for r in rows)])
                row_of = np.full(len(n), -1)
                row_of[rows] = np.arange(len(rows))
            step = max(1, (1 << 22) // wide)  # at most 4 MB of counts at a time
            for lo in range(0, len(at), step):
                part = at[lo:lo + step]
                bound[part] = np.minimum(matrix[row_of[j[part]]], matrix[row_of[i]]).sum(1, dtype=np.int64)
        likely = bound / (n[i] + n[j] - bound)
        keep = np.flatnonzero(sure | (den * bound >= num * (n[i] + n[j] - bound)))
        if best is not None and len(keep) > best:
            keep = keep[np.argsort(-likely[keep], kind="stable")]
            rest[i] = rest[j[keep[best:]]] = True
            keep = keep[:best]
        j = j[keep]
        found.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1))
    sig = np.full(int(rest.sum()), group.column("sig")[0].as_py(), np.int64)
    return np.concatenate([*found, np.zeros((0, 2), np.int64)]), np.stack([node[rest], sig, n[rest]], 1)


def _marks(named: pa.ListArray, sig: int) -> np.ndarray:
    """A bit for each of the signatures below ``sig`` that most sets name, by set."""
    sets = np.repeat(np.arange(len(named)), np.diff(named.offsets.to_numpy()))
    values = named.flatten().to_numpy()
    sets, values = sets[values < sig], values[values < sig]
    each, at, count = np.unique(values, return_inverse=True, return_counts=True)
    bit = np.zeros(len(each), np.uint64)
    top = np.argsort(-count, kind="stable")[:MARKS]
    bit[top] = np.uint64(1) << np.arange(len(top), dtype=np.uint64)
    out = np.zeros(len(named), np.uint64)
    np.bitwise_or.at(out, sets, bit[at])
    return out


def _verified(k: int, num: int, den: int):
    def run(it):
        last: tuple = (None, None)
        for b in it:
            a, bs = b.column("a").to_numpy(), b.column("b").to_numpy()
            ta, tb = b.column("text_a"), b.column("text_b")
            out = []
            for i in range(len(a)):
                if last[0] != a[i]:  # rows come sorted by a
                    last = (a[i], W.shingle_sets(W.split(ta.slice(i, 1), lower=True), k)[0])
                y = W.shingle_sets(W.split(tb.slice(i, 1), lower=True), k)[0]
                shared = len(np.intersect1d(last[1], y, assume_unique=True))
                united = len(last[1]) + len(y) - shared
                if den * shared >= num * united:
                    out.append((a[i], bs[i], shared, united))
            yield record_batch(_LINKS, *(list(c) for c in zip(*out))) if out else record_batch(_LINKS, [], [], [], [])
    return thrifty(run)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5,
                       doc_id: str = "doc_id", text: str = "text", keys: bool = False) -> DataFrame:
    """Components of the documents whose k-word shingle sets have a Jaccard
    similarity of at least ``num / den`` (0.75 or more).

    Returns doc_id, n_shingles (set size), component_id (smallest doc_id that
    links reach, itself included), one row per input row.  A null or empty
    text, or one of spaces only, has an empty set, which links with nothing.
    Rows with equal doc_ids are documents of their own that carry the same id.
    A null doc_id takes part but is never a component's id unless all its
    members lack one.  With ``keys``, text_key (xxhash64 of the text) and
    component_key are added: (doc_id, text_key) names a row, and (component_id,
    component_key) the component's smallest one, rows without doc_id last.
    Other columns are ignored; an empty table gives none.
    """
    if 4 * num < 3 * den or num > den:
        raise ValueError("the threshold must be from 0.75 to 1")
    spark = docs.sparkSession
    s = Scratch(spark, "ngram-join")
    texts = only(docs, doc_id=doc_id, text=text)
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    both = s.write(keyed.mapInArrow(_features(k), arrow_ddl(_FEATURES)), "features")
    features = both.where(F.col("node").isNotNull())
    heavy = [r[0] for r in both.where(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("c"))
             .where(F.col("c") >= FREQUENT).orderBy(F.desc("c"), "token").limit(FREQUENT_TOKENS).select("token").collect()]
    frequent = spark.sparkContext.broadcast(np.sort(np.array(heavy, np.int64).view(np.uint64)))

    rows = s.write(texts.select("text").mapInArrow(_signatures(k, num, den, frequent), arrow_ddl(_SIGNATURES)), "signatures")
    shared = (rows.groupBy("sig").agg(F.min("node").alias("centre"), F.max("node").alias("z"), F.count(F.lit(1)).alias("size"))
              .where("centre <> z").drop("z"))
    shared = s.write(shared, "groups")  # written, so that the join can split a hot signature
    found = s.write(rows.join(shared, "sig"), "shared")
    s.drop("signatures")
    s.drop("groups")
    classes = features.where("n > 0").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key", "n", "digest")).alias("at"))
    classes = s.write(classes.select("node", "at.*"), "classes")

    near = _candidates(found.select(F.col("centre").alias("a"), F.col("node").alias("b")), classes, num, den)
    near = s.write(near, "near")
    links = s.write(_links(s, "near-texts", near, classes, keyed, k, num, den), "links")
    label, tested, linked = components(links), near, links.select("a", "b")
    # first each set's most promising partners, which joins most of a large group; then whatever is left, all of it
    sized = found.join(classes.select("node", "n"), "node")
    left = sized.where(F.col("size") >= LARGE_GROUP).select("sig", "node", "n")
    for step, best in enumerate((*PROMISING, None)):
        open_ = _open(s, f"open{step}", left, label)  # a group of one component stays so
        proposed = s.write(_between(open_, classes, num, den, best), f"proposed{step}")
        left = proposed.where(F.col("b").isNull()).select("sig", F.col("a").alias("node"), "n").distinct()
        far = proposed.where(F.col("b").isNotNull()).select("a", "b")
        if best is None:
            far = far.union(_candidates(_between_few(sized.where(F.col("size") < LARGE_GROUP), label, num, den), classes, num, den))
        far = s.write(far.distinct().join(tested, ["a", "b"], "left_anti"), f"far{step}")
        more = s.write(_links(s, f"texts{step}", far, classes, keyed, k, num, den), f"more{step}")
        tested = tested.union(far)
        if more.head(1):
            linked = linked.union(more.select("a", "b"))
            label = components(linked)
    node_root = s.write(label, "roots")
    for name in ("shared", "near", "links", "near-texts", *(f"{n}{i}" for n in ("open", "proposed", "far", "texts", "more") for i in range(len(PROMISING) + 1))):
        s.drop(name)
    rooted = features.join(node_root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if keys:
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
        least = (rooted.where("n > 0").groupBy("root").agg(first.alias("first"))
                 .select("root", F.col("first.doc_id").alias("component_id"), F.col("first.text_key").alias("component_key")))
        linked = F.col("n") > 0
        return (rooted.join(least, "root", "left")
                .select("doc_id", "text_key", F.col("n").alias("n_shingles"),
                        F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                        F.when(linked, F.col("component_key")).otherwise(F.col("text_key")).alias("component_key")))
    least = (rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")))
    # classes of one document need no join: the smallest ids of roots come back only where there are links or copies
    return (rooted.join(least, "root", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def _candidates(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct pairs a < b whose sizes and digests allow the threshold."""
    p = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for end in "ab":
        p = p.join(classes.select(F.col("node").alias(end), F.col("n").alias(f"n{end}")), end)
    p = p.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    for end in "ba":  # digests are many times larger than sizes
        p = p.join(classes.select(F.col("node").alias(end), F.col("digest").alias(f"d{end}")), end)
    return p.mapInArrow(_possible(num, den), "a long, b long")


def _rooted(found: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (sig, node, n) with their component so far."""
    return found.join(label, "node", "left").select("sig", "node", "n", F.coalesce("root", "node").alias("root"))


def _open(s: Scratch, name: str, found: DataFrame, label: DataFrame) -> DataFrame:
    """The rows (sig, node, n) whose signature has sets of different components, with their root and the group's size."""
    at = _rooted(found, label)
    open_ = at.groupBy("sig").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"))
    return s.write(at.join(open_.where("x <> y").select("sig", "size"), "sig"), name)


def _between(at: DataFrame, classes: DataFrame, num: int, den: int, best: int | None) -> DataFrame:
    """Pairs (a, b) of a large signature's sets that are in different components so
    far and that sizes and digests allow; with ``best`` only each set's most promising
    ones, and the sets of all others (a, sig, n).  The digests are compared in place
    (block by block where the group is very large), so that only possible pairs become rows."""
    blocks = F.ceil(F.col("size") / GROUP_BLOCK).cast("int")
    large = (at.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int"))
             .withColumn("to", F.explode(F.sequence(F.lit(0), blocks - 1)))
             .withColumn("one", F.least("block", "to")).withColumn("two", F.greatest("block", "to")).drop("to"))
    named = at.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, NAMED).alias("named"))
    digests = in_buckets(classes.select("node", "digest"), "node", at, "node")
    large = (large.join(named, "node").join(digests, "node")
             .select("sig", "one", "two", "block", "node", "root", "n", "digest", "named"))
    return (large.repartition("sig", "one", "two").sortWithinPartitions("sig", "one", "two")
            .mapInArrow(_possible_in_groups(num, den, best), arrow_ddl(_PROPOSED)))


def _between_few(found: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of small groups (fewer than ``LARGE_GROUP`` rows) that are in different components."""
    return (_rooted(found, label).repartition("sig").sortWithinPartitions("sig")
            .mapInArrow(_in_few(num, den, LARGE_GROUP), "a long, b long"))


def _links(s: Scratch, name: str, pairs: DataFrame, classes: DataFrame, keyed: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that reach the threshold, judged on their texts."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    need = s.write(classes.join(ends, "node", "left_semi").select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "node"), name)
    near = in_buckets(keyed, "text_key", need, "key")
    text = (near.join(need, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")))
            .select("node", "text").dropDuplicates(["node"]))
    far = pairs.join(text.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = far.join(text.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(k, num, den), arrow_ddl(_LINKS))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-word shingles, similarity 0.85 or more, over all of ``documents``."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, num=85, den=100)


QUERIES = {"op2_ngram_jaccard_join": op2_ngram_jaccard_join}

ORACLE_SQL = {"op2_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 4 THEN w ELSE w[i:i + 3] END, ' ')) AS g
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
half AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""}
