"""A prefix trie of conversations, built as a burst trie.

Every conversation is a sequence of turn ids.  Containers hold the unread
suffixes of the conversations below one trie head; a container of more than
``most`` turns and members bursts: its head becomes a node, and each suffix
moves to the container of its next turn id.  A round bursts 1, 1, 2, 4, ...
levels, so that long shared beginnings take few rounds.  What remains is small:
each container is sorted in one task and swept into nodes.

A node is known by a polynomial hash of its turn ids.  Because that is a sum,
the hash at any depth follows from per-chunk sums, and conversations travel as
chunks of a bounded number of turns, however long one conversation is.

Sums over a head's subtree need no walk over the tree: a node belongs to its
smallest member, and for a member m the nodes that belong to m are the lower
end of m's path, from depth f(m) on.  So a head at depth d gets, from each
member, the bytes of the turns d..f(m)-1 as saved, and one leaf if m's last
node belongs to m and has no children: plain grouped sums over members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, arrow_ddl, only, record_batch, runs, table
from .crc import crc32_sql

#: Turns and members that one container may hold.
CONTAINER = 4096
#: Turns of a chunk: chunk k has the turns 2**k .. 2**(k+1)-1 up to this many, then as many each.
CHUNK = 4096
#: Members' numbers that are joined into one row before they are hashed.
ENDS = 4096
#: Copies of the (few) heads that members of one head are dealt to.
SALTS = 16

_A, _B = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SUMS = pa.schema([("conv", pa.int64()), ("chunk", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("size", pa.int64())])
_PATH = pa.schema([("conv", pa.int64()), ("depth", pa.int64()), ("n1", pa.int64()), ("n2", pa.int64()), ("p1", pa.int64()),
                   ("p2", pa.int64()), ("bytes", pa.int64()), ("upto", pa.int64()), ("total", pa.int64())])
_SWEPT = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
                    ("member", pa.int64()), ("before", pa.int64()), ("leaf", pa.bool_())])
_JOINED = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("at", pa.int64()), ("ids", pa.string())])
_ENDS = pa.schema([("n1", pa.int64()), ("n2", pa.int64()), ("ends_sha256", pa.string())])
OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def positions(turns: DataFrame) -> DataFrame:
    """(conv, turn, role, text) with ``pos`` from 1 on in the order of turn (null
    first), role and text within each conversation: local numbers in range
    partitions, plus the counts of the partitions before."""
    s = Scratch(turns.sparkSession, "positions")
    order = ["conv", "turn", "role", "text"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv", *_turn_ids(), F.monotonically_increasing_id().alias("row"))
    ranged = s.write(ranged, "ranged")  # the numbers must not change between the two reads
    part = F.shiftright("row", 33)
    counted = ranged.groupBy("conv", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    # one row for each partition that a conversation reaches into
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = s.write(counted.select("conv", "part", (before - F.col("first") + 1).alias("offset")), "offsets")
    return ranged.withColumn("part", part).join(offsets, ["conv", "part"]).select(
        "conv", (F.col("row") + F.col("offset")).alias("pos"), "t1", "t2", "bytes")


def _turn_ids():
    return (F.xxhash64("role", "text").alias("t1"), F.xxhash64("text", "role").alias("t2"),
            F.octet_length("text").cast("long").alias("bytes"))


def grafted(turns: DataFrame, conv: str = "conv_id", every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of the rebuilt conversations: the first h turns of
    conversation c - c % ``every``, then c's own after its first h, where h is
    the CRC-32 of c's decimal digits modulo ``most``.  Rows without a
    conversation number are left out; null roles and texts are empty."""
    s = Scratch(turns.sparkSession, "grafted")
    own = s.write(positions(only(turns, conv=conv, turn="turn", role="role", text="text").where("conv is not null").select(
        F.col("conv").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))), "own")
    sizes = s.write(own.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "sizes")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    base = F.col("conv") - F.col("conv") % every
    counts = sizes.select("conv", "n", h.alias("h"), base.alias("base"))
    base_sizes = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = s.write(counts.join(base_sizes, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"), "n"), "convs")
    # at most ``most`` turns of a base, for the at most ``every`` conversations that share it
    heads = own.where(F.col("pos") < most).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "h"), "base") \
        .where("pos <= h").select("conv", "pos", "t1", "t2", "bytes")
    tails = own.join(convs.select("conv", "h", "taken"), "conv").where("pos > h").select(
        "conv", (F.col("taken") + F.col("pos") - F.col("h")).alias("pos"), "t1", "t2", "bytes")
    size = F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return convs.select("conv", size.alias("size")), heads.unionByName(tails)


class Chunks:
    """Where chunks start and end, for chunks of up to ``most`` turns (a power of two)."""

    def __init__(self, most: int):
        self.most, self.levels = most, most.bit_length() - 1

    def of(self, pos):
        small = (F.length(F.bin(pos)) - 1).cast("long")
        return F.when(pos < self.most, small).otherwise(self.levels + F.floor((pos - self.most) / self.most).cast("long"))

    def before(self, chunk: int) -> int:
        """Depth before a chunk's first turn."""
        return (1 << chunk) - 1 if chunk < self.levels else self.most - 1 + (chunk - self.levels) * self.most

    def last(self, chunk):
        """Depth of a chunk's last turn."""
        return F.when(chunk < self.levels, F.pow(F.lit(2.0), chunk + 1).cast("long") - 1).otherwise((chunk - self.levels + 2) * self.most - 1)


def _unpacked(b: pa.RecordBatch):
    """Flat arrays of a batch's chunks: row of each turn, place in the chunk, t1, t2, bytes."""
    packed = b.column("turns")
    offsets = packed.offsets.to_numpy()
    flat = packed.flatten()
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], n)
    t1, t2, size = (flat.field(k).to_numpy() for k in ("t1", "t2", "bytes"))
    return row, place, t1.view(np.uint64), t2.view(np.uint64), size


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2**64, element by element."""
    out, square, left = np.ones(len(exponent), np.uint64), base, exponent.astype(np.uint64)
    while left.any():
        out = np.where(left & W.U(1), out * W.U(square), out)
        square, left = square * square % 2**64, left >> W.U(1)
    return out


def _terms(b: pa.RecordBatch, chunks: Chunks):
    """Each turn's part of the node hashes, by its depth."""
    row, place, t1, t2, size = _unpacked(b)
    chunk = b.column("chunk").to_numpy()
    start = np.array([chunks.before(int(c)) for c in chunk], np.int64)
    depth = start[row] + place + 1
    return row, place, depth, W.mix(t1) * _power(_A, depth), W.mix(t2) * _power(_B, depth), size


def _chunk_sums(chunks: Chunks):
    def run(it):
        for b in it:
            row, _, _, a, c, size = _terms(b, chunks)
            out = [np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.int64)]
            for total, x in zip(out, (a, c, size)):
                np.add.at(total, row, x)
            yield record_batch(_SUMS, b.column("conv"), b.column("chunk"), out[0].view(np.int64), out[1].view(np.int64), out[2])
    return run


def _grouped_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Running sums that start anew where ``first`` is the place in the group."""
    total = np.cumsum(x, dtype=x.dtype)
    before = np.concatenate([np.zeros(1, x.dtype), total[:-1]])
    heads = np.flatnonzero(first == 0)
    return total - np.repeat(before[heads], np.diff(np.r_[heads, len(x)])) if len(x) else total


def _paths(chunks: Chunks):
    """Nodes of every depth that the chunks reach: rows (conv, chunk, turns, the
    sums before the chunk, size of the conversation)."""
    def run(it):
        for b in it:
            row, place, depth, a, c, size = _terms(b, chunks)
            s1, s2, upto, total = (b.column(k).to_numpy()[row] for k in ("s1", "s2", "size_before", "size"))
            n1, n2 = (_grouped_sums(x, place) + s.view(np.uint64) for x, s in ((a, s1), (c, s2)))
            p1, p2 = n1 - a, n2 - c
            yield record_batch(_PATH, b.column("conv").to_numpy()[row], depth, *(x.view(np.int64) for x in (n1, n2, p1, p2)),
                               size, _grouped_sums(size, place) + upto, total)
    return run


def _prefixed(chunks: DataFrame, sums: DataFrame) -> DataFrame:
    """Chunk sums become the sums before each chunk: one row a chunk, wrapping
    additions done by halves so that they can't overflow."""
    before = Window.partitionBy("conv").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)

    def wrapped(c):
        high, low = F.sum(F.shiftrightunsigned(c, 32)).over(before), F.sum(F.col(c).bitwiseAND(0xFFFFFFFF)).over(before)
        carried = (F.coalesce(high, F.lit(0)) + F.shiftrightunsigned(F.coalesce(low, F.lit(0)), 32)).bitwiseAND(0xFFFFFFFF)
        return F.shiftleft(carried, 32).bitwiseOR(F.coalesce(low, F.lit(0)).bitwiseAND(0xFFFFFFFF))

    offsets = sums.select("conv", "chunk", wrapped("s1").alias("s1"), wrapped("s2").alias("s2"),
                          F.coalesce(F.sum("size").over(before), F.lit(0)).alias("size_before"))
    return chunks.join(offsets, ["conv", "chunk"])


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.pmod(F.xxhash64("conv"), F.lit(SALTS)).cast("int"))


def _spread(heads: DataFrame) -> DataFrame:
    return heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


class _Sweep:
    """One container: its members' suffixes sorted, then swept into nodes."""

    def __init__(self, members):
        # (suffix of turn ids, conv, bytes up to the head, bytes of each turn); the head's own turn is first
        self.members = sorted(members, key=lambda m: (m[0], m[1]))
        self.nodes = []  # [depth, parent, least conv, members, children, leaves, saved, ends, bytes]
        self.last = {}

    def run(self):
        open_, previous = [], ()
        for ids, conv, _, sizes in self.members:
            shared = 0
            while shared < min(len(ids), len(previous)) and ids[shared] == previous[shared]:
                shared += 1
            while len(open_) > shared:
                self._close(open_)
            for k in range(len(open_), len(ids)):
                self.nodes.append([k, open_[-1] if open_ else None, conv, 0, 0, 0, 0, [], sizes[k]])
                if open_:
                    self.nodes[open_[-1]][4] += 1
                open_.append(len(self.nodes) - 1)
            for at in open_:
                node = self.nodes[at]
                node[2] = min(node[2], conv)
                node[3] += 1
            self.nodes[open_[-1]][7].append(conv)
            self.last[conv] = open_[-1]
            previous = ids
        while open_:
            self._close(open_)
        return self

    def _close(self, open_):
        node = self.nodes[open_.pop()]
        node[5] += not node[4]
        node[6] += (node[3] - 1) * node[8]
        if open_:
            above = self.nodes[open_[-1]]
            above[5] += node[5]
            above[6] += node[6]

    def owned(self):
        """(conv, bytes before the first node that belongs to conv, whether its end is a leaf that does)."""
        for ids, conv, before, sizes in self.members:
            at, own, leaf = self.last[conv], len(ids), False
            if self.nodes[at][2] == conv:
                leaf = not self.nodes[at][4]
            while at is not None and self.nodes[at][2] == conv:
                own, at = own - 1, self.nodes[at][1]
            yield conv, before + sum(sizes[:own]), leaf


def _sweep(chunks: Chunks):
    """Sorted chunk rows of the containers' members -> nodes, and what the heads need of each member."""
    def run(it):
        for group in runs(it, ["n1", "n2"]):
            members, rows = {}, group.to_pylist()
            depth, above = rows[0]["depth"], rows[0]["parent_conv_id"]
            for r in rows:
                ids, sizes, _ = members.setdefault(r["conv"], ([], [], r["upto"]))
                for t in r["turns"][max(0, depth - chunks.before(r["chunk"]) - 1):]:
                    ids.append((t["t1"], t["t2"]))
                    sizes.append(t["bytes"])
            swept = _Sweep([(ids, conv, upto - sizes[0], sizes) for conv, (ids, sizes, upto) in members.items()]).run()
            out = []
            for k, up, conv, n, children, leaves, saved, ends, _ in swept.nodes:
                out.append((conv, depth + k, above if up is None else swept.nodes[up][2], n, children, leaves, saved,
                            hashlib.sha256(",".join(map(str, sorted(ends))).encode()).hexdigest(), None, None, None))
            out += [(None,) * 8 + m for m in swept.owned()]
            for a in range(0, len(out), 8192):
                yield record_batch(_SWEPT, *map(list, zip(*out[a:a + 8192])))
    return run


def _joined(most: int):
    """Sorted (n1, n2, conv) -> rows of up to ``most`` numbers of one node, comma-joined."""
    def run(it):
        for group in runs(it, ["n1", "n2"]):
            ids = group.column("conv").to_numpy()
            n1, n2 = group.column("n1")[0], group.column("n2")[0]
            for a in range(0, len(ids), most):
                yield record_batch(_JOINED, [n1.as_py()], [n2.as_py()], ids[a:a + 1], [",".join(map(str, ids[a:a + most].tolist()))])
    return run


def _hashed(it):
    """Sorted rows of ``_joined`` -> one digest a node, without holding a node's numbers."""
    now, digest = None, None
    for b in it:
        for n1, n2, ids in zip(*(b.column(k).to_pylist() for k in ("n1", "n2", "ids"))):
            if (n1, n2) != now:
                if now:
                    yield record_batch(_ENDS, [now[0]], [now[1]], [digest.hexdigest()])
                now, digest = (n1, n2), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
    if now:
        yield record_batch(_ENDS, [now[0]], [now[1]], [digest.hexdigest()])


def prefix_trie(convs: DataFrame, turns: DataFrame, most: int = CONTAINER, chunk: int = CHUNK) -> DataFrame:
    """The trie of conversations: ``convs`` (conv, size) with every distinct
    conversation once, ``turns`` (conv, pos from 1 on, t1, t2, bytes) with two
    64-bit ids of each turn's content.

    Returns a row per node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256.  Conversations
    without turns are members of the root alone; without conversations there is
    no node.  ``most`` bounds what one task sweeps at a time and ``chunk`` the
    turns that travel in one row, neither the result.
    """
    spark, at = turns.sparkSession, Chunks(chunk)
    s = Scratch(spark, "trie")
    convs = s.write(convs, "convs")
    chunked = turns.withColumn("chunk", at.of(F.col("pos"))).groupBy("conv", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "bytes"))).alias("turns"))  # at most ``chunk`` turns
    chunks = s.write(chunked, "chunks")
    sums = s.write(chunks.select("conv", "chunk", "turns").mapInArrow(_chunk_sums(at), arrow_ddl(_SUMS)), "sums")
    located = s.write(_prefixed(chunks, sums).join(convs, "conv"), "located")
    s.drop("chunks")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), *(F.lit(0).cast("long").alias(c) for c in ("n1", "n2")),
                        *(F.lit(None).cast("long").alias(c) for c in ("p1", "p2")), F.lit(0).cast("long").alias("bytes"),
                        F.lit(0).cast("long").alias("upto"), F.col("size").alias("total"))
    paths, contained, active, level = [root], [], convs.where("size > 0").select("conv"), 0
    while active.head(1):
        deep = level >= at.levels  # all further chunks at once
        here = located.where(F.col("chunk") >= level if deep else F.col("chunk") == level)
        step = s.write(here.join(active, "conv").select("conv", "chunk", "turns", "s1", "s2", "size_before", "size")
                       .mapInArrow(_paths(at), arrow_ddl(_PATH)), f"step{level}")
        # unread turns and members below each node: more than fit make it a head
        held = F.sum(F.col("total") - F.col("depth") + 1)
        heads = s.write(step.groupBy("n1", "n2").agg(held.alias("held")).where(F.col("held") > most).select("n1", "n2"), f"heads{level}")
        marked = s.write(_salted(step).join(_spread(heads).withColumn("head", F.lit(True)), ["n1", "n2", "salt"], "left")
                         .drop("salt"), f"marked{level}")
        s.drop(f"step{level}")
        paths.append(marked.where("head").drop("head"))
        # the highest node that is no head is the member's container
        contained.append(marked.where("head is null").groupBy("conv").agg(
            F.min(F.struct("depth", "n1", "n2", "p1", "p2", "upto")).alias("c")).select("conv", "c.*"))
        # who is not in a container and has turns left bursts on
        last = at.before(level + 1)
        active = spark.createDataFrame([], "conv long") if deep else s.write(
            marked.where(F.col("head") & (F.col("depth") == last) & (F.col("total") > last)).select("conv"), f"active{level}")
        level += 1
    path = _salted(_union(paths))
    heads = s.write(path.groupBy("n1", "n2").agg(
        F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("depth").alias("depth"),
        F.first("p1").alias("p1"), F.first("p2").alias("p2")), "heads")
    over = heads.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    if contained:
        members = s.write(_salted(_union(contained)).join(_spread(over), ["p1", "p2", "salt"]).drop("salt"), "members")
        parts = members.select("conv", "depth", "n1", "n2", "parent_conv_id", "upto").join(located.select("conv", "chunk", "turns"), "conv") \
            .where(at.last(F.col("chunk")) >= F.col("depth"))
        swept = s.write(parts.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "conv", "chunk")
                        .mapInArrow(_sweep(at), arrow_ddl(_SWEPT)), "swept")
        tops = members.select("n1", "n2", "p1", "p2").distinct()
    else:
        swept, tops = spark.createDataFrame([], arrow_ddl(_SWEPT)), heads.select("n1", "n2", "p1", "p2").limit(0)
    # a node's children are heads or the tops of containers
    children = heads.where("p1 is not null").select("n1", "n2", "p1", "p2").unionByName(tops).groupBy(
        F.col("p1").alias("n1"), F.col("p2").alias("n2")).agg(F.count(F.lit(1)).alias("n_children"))
    heads = s.write(heads.join(children, ["n1", "n2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "counted")
    # the bytes before each member's first own node (all, if it has none), and whether its end is a leaf of its own
    placed = s.write(path.join(_spread(heads.select("n1", "n2", "conv_id", "n_children")), ["n1", "n2", "salt"]), "placed")
    mine, ends = F.col("conv") == F.col("conv_id"), F.col("depth") == F.col("total")
    own = placed.where(mine | ends).select(
        F.col("conv").alias("member"), (F.col("upto") - F.when(mine, F.col("bytes")).otherwise(0)).alias("before"),
        (mine & ends & (F.col("n_children") == 0)).alias("leaf"))
    owners = s.write(own.unionByName(swept.where("member is not null").select("member", "before", "leaf")).groupBy("member").agg(
        F.min("before").alias("before"), F.max("leaf").alias("leaf")), "owners")
    saved = F.greatest(F.col("before") - (F.col("upto") - F.col("bytes")), F.lit(0))
    below = placed.select("n1", "n2", F.col("conv").alias("member"), "upto", "bytes").join(owners, "member", "left").groupBy("n1", "n2").agg(
        F.coalesce(F.sum(saved), F.lit(0)).alias("saved_tokens"), F.count(F.when(F.col("leaf"), 1)).alias("n_leaves"))
    none = hashlib.sha256(b"").hexdigest()
    done = heads.join(below, ["n1", "n2"]).join(_ends(placed.where("depth = total")), ["n1", "n2"], "left") \
        .join(over, ["p1", "p2"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none)))
    return done.select(*OUT).unionByName(swept.where("member is null").select(*OUT))


def _ends(ended: DataFrame) -> DataFrame:
    """(n1, n2, ends_sha256) of the members that end at heads.  Numbers are
    ranged over the cluster and joined into rows of ``ENDS``; a hash must read
    its input in order, so the last step streams each node's few rows."""
    parts = ended.select("n1", "n2", "conv").repartitionByRange("n1", "n2", "conv").sortWithinPartitions("n1", "n2", "conv") \
        .mapInArrow(_joined(ENDS), arrow_ddl(_JOINED))
    return parts.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "at").mapInArrow(_hashed, arrow_ddl(_ENDS))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``."""
    return prefix_trie(*grafted(table(spark, sf_dir, "conversations")))


QUERIES = {"op12_prefix_trie": op12_prefix_trie}

ORACLE_SQL = {"op12_prefix_trie": f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
lists AS (SELECT c, list(md5(md5(role) || md5(text)) ORDER BY pos) AS ids, list(octet_length(encode(text)) ORDER BY pos) AS sizes FROM t GROUP BY c),
hs AS (SELECT c, ids, sizes, {crc32_sql('CAST(c AS VARCHAR)')} % 9 AS h FROM lists),
built AS (SELECT a.c, list_concat(coalesce(b.ids, [])[1:a.h], a.ids[a.h + 1:]) AS ids, list_concat(coalesce(b.sizes, [])[1:a.h], a.sizes[a.h + 1:]) AS sizes
          FROM hs a LEFT JOIN lists b ON b.c = a.c - a.c % 5),
member AS (SELECT c, d, len(ids) AS n, md5(array_to_string(ids[1:d], '')) AS node, CASE WHEN d > 0 THEN md5(array_to_string(ids[1:d - 1], '')) END AS parent,
                  CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size FROM (SELECT c, ids, sizes, unnest(range(0, len(ids) + 1)) AS d FROM built)),
nodes AS (SELECT node, any_value(parent) AS parent, any_value(d) AS d, any_value(size) AS size, min(c) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends FROM member GROUP BY node),
kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
under AS (SELECT DISTINCT a.node AS top, b.node FROM member a JOIN member b ON a.c = b.c AND a.d <= b.d),
sums AS (SELECT u.top AS node, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.size) AS saved
         FROM under u JOIN nodes v ON u.node = v.node LEFT JOIN kids k ON k.node = v.node GROUP BY u.top)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN sums s ON s.node = x.node LEFT JOIN nodes p ON x.parent = p.node LEFT JOIN kids k ON k.node = x.node
"""}
