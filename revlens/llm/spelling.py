"""Grouping spelling variants by Bloom-guided neighbourhoods.

A vocabulary of words with counts is summarised in blocked Bloom filters, one
per word length, that are broadcast.  Every word generates its one-letter edits
as hashes (a rolling polynomial gives an edit's hash from the word's in a few
operations, whole batches at a time) and probes the filter of the edit's
length.  Only positives become strings; they are joined with the vocabulary
itself, which removes the filters' false positives.

Nearness is symmetric, so each pair is generated once: a shorter neighbour by a
deletion from the longer word, one of equal length by a replacement with a
later letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, arrow_ddl, only, record_batch, table
from .crc import crc32_sql

#: Letters of a word run.
LETTERS = "A-Za-zÀ-ÿ"
#: Words of this length or more share the last filter.
LAST_SHARD = 64
#: Filter bits a word; each word sets ``PROBES`` bits of one 64-bit block.
BITS, PROBES = 24, 5
#: Filter blocks broadcast at a time (32 MB); a larger vocabulary is probed in several passes.
PASS_BLOCKS = 1 << 22
#: Words generated from by one task, and cells of a batch's edit matrix.
TASK_WORDS, CELLS = 25_000, 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCKS = pa.schema([("block", pa.int64()), ("bits", pa.int64())])
_EDITS = pa.schema([("word", pa.string()), ("n", pa.int64()), ("other", pa.string())])


def runs_of_letters(docs: DataFrame, min_length: int = 1, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): every maximal run of ``LETTERS`` with ``min_length`` letters or more, A-Z lower-cased."""
    # a run shorter than the minimum matches at none of its letters, a longer one as a whole at its first
    found = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(0))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = only(docs, doc_id=doc_id, text=text).select("doc_id", F.explode_outer(found).alias("run"))
    return runs.where("run is not null").select("doc_id", lower.alias("run"))


def misspelt(runs: DataFrame, every: int = 31) -> DataFrame:
    """Runs (doc_id, run) with one letter lost where ``every`` divides the
    CRC-32 of ``<doc_id>:<run>``: the letter at that number modulo the length."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return runs.withColumn("h", h).select("doc_id", F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("run"))


def _letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words, first code point of each, length of each)."""
    length = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
    return points, np.cumsum(length) - length, length


def _code_points(it):
    for b in it:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(_letters(b.column("word"))[0]).astype(np.int32))], ["letter"])


def _values(points: np.ndarray) -> np.ndarray:
    return W.mix((points.astype(np.uint64) + W.U(1)) * W.U(0xD1342543DE82EF95)) | W.U(1)


def _by_length(words: pa.Array, width: int = 1):
    """Batches of equally long words: (length, rows, code points as a matrix);
    a matrix of ``width`` columns for its rows has about ``CELLS`` cells, too."""
    points, first, length = _letters(words)
    order = np.argsort(length, kind="stable")
    heads = np.flatnonzero(np.r_[True, np.diff(length[order]) > 0]) if len(order) else []
    for lo, hi in zip(heads, np.r_[heads[1:], len(order)] if len(order) else []):
        n = int(length[order[lo]])
        step = max(1, CELLS // max(width, n))
        for a in range(lo, hi, step):
            rows = order[a:min(a + step, hi)]
            yield n, rows, points[first[rows][:, None] + np.arange(n)]


def _sums(x: np.ndarray) -> np.ndarray:
    """Prefix sums of ``value * base**position``, one row a word; the last is the word's hash."""
    out = np.zeros((len(x), x.shape[1] + 1), np.uint64)
    np.cumsum(_values(x) * W.powers(_BASE, x.shape[1]), axis=1, out=out[:, 1:])
    return out


class Shards:
    """Where the blocks of each length's filter lie in the sequence of all blocks."""

    def __init__(self, counts: dict[int, int]):
        self.blocks = np.zeros(LAST_SHARD + 1, np.uint64)
        for shard, n in counts.items():
            self.blocks[shard] = -(-n * BITS // 64)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.total = int(self.blocks.sum())

    def place(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, bit source) of hashes of words of one length, which must have a filter."""
        shard = min(length, LAST_SHARD)
        h = W.mix(h + W.U(length))
        return self.first[shard] + ((h >> W.U(32)) * self.blocks[shard] >> W.U(32)), h

    def spans(self, lo: int, hi: int) -> list[int]:
        """Shards with blocks in lo..hi-1."""
        return [int(s) for s in np.flatnonzero((self.blocks > 0) & (self.first < hi) & (self.first + self.blocks > lo))]


def _bit(h: np.ndarray, probe: int) -> np.ndarray:
    return h >> W.U(6 * probe) & W.U(63)


def _blocks(shards: Shards, lo: int, hi: int):
    def run(it):
        for b in it:
            at, bits = [], []
            for n, _, x in _by_length(b.column("word")):
                block, h = shards.place(_sums(x)[:, -1], n)
                mask = np.zeros(len(h), np.uint64)
                for probe in range(PROBES):
                    mask |= W.U(1) << _bit(h, probe)
                here = (block >= lo) & (block < hi)
                at.append(block[here])
                bits.append(mask[here])
            if at:
                yield record_batch(_BLOCKS, np.concatenate(at).view(np.int64), np.concatenate(bits).view(np.int64))
    return run


def _edits(shards: Shards, lo: int, hi: int, alphabet: np.ndarray, held):
    """The edits of each word that the filter blocks lo..hi-1 hold, as strings."""
    values = _values(alphabet)

    def positive(h, length, given=None):
        """Indices of the hashes (of those ``given``) that pass the filter."""
        if not shards.blocks[min(length, LAST_SHARD)]:
            return np.zeros(0, np.int64)
        block, h = shards.place(h, length)
        at = np.flatnonzero((block >= lo) & (block < hi) if given is None else given & (block >= lo) & (block < hi))
        bits, h = held.value[(block[at] - W.U(lo)).astype(np.int64)], h[at]
        for probe in range(PROBES):
            hit = (bits >> _bit(h, probe) & W.U(1)).astype(bool)
            at, bits, h = at[hit], bits[hit], h[hit]
        return at

    def edits(x):
        """(rows, edited code points) of one batch of equally long words."""
        n = x.shape[1]
        sums, power, inverse = _sums(x), W.powers(_BASE, n), W.U(_INVERSE)
        own = _values(x)
        for i in range(n):
            # a deletion within a run of one letter gives the same word: only at the run's end
            new = np.ones(len(x), bool) if i == n - 1 else x[:, i] != x[:, i + 1]
            rows = positive(sums[:, i] + (sums[:, -1] - sums[:, i + 1]) * inverse, n - 1, new)
            if len(rows):
                yield rows, np.delete(x[rows], i, axis=1)
            h = sums[:, -1, None] + (values - own[:, i, None]) * power[i]
            at = positive(h.ravel(), n, (alphabet > x[:, i, None]).ravel())
            if len(at):
                rows, letter = np.divmod(at, len(alphabet))
                changed = x[rows]
                changed[:, i] = alphabet[letter]
                yield rows, changed

    def run(it):
        for b in it:
            words, counts = b.column("word"), b.column("n")
            for n, rows, x in _by_length(words, len(alphabet)):
                for at, changed in edits(x):
                    for a in range(0, len(at), max(1, CELLS // n)):
                        part = np.ascontiguousarray(changed[a:a + max(1, CELLS // n)])
                        if not part.shape[1]:
                            continue
                        back = pa.array(rows[at[a:a + max(1, CELLS // n)]])
                        other = part.view(f"<U{part.shape[1]}").ravel()
                        yield record_batch(_EDITS, words.take(back), counts.take(back), other)
    return run


def near_pairs(vocabulary: DataFrame, s: Scratch) -> DataFrame:
    """(word, n) with distinct words -> (word, n, other, other_n): every pair
    that differs by exactly one inserted, deleted or replaced letter, once."""
    spark = vocabulary.sparkSession
    shard = F.least(F.length("word"), F.lit(LAST_SHARD))
    counts = {r["shard"]: r["n"] for r in vocabulary.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()
              if r["shard"]}  # at most LAST_SHARD rows
    shards = Shards(counts)
    letters = vocabulary.select("word").mapInArrow(_code_points, "letter int").distinct()  # letters, not words
    alphabet = np.sort(letters.toArrow().column("letter").to_numpy()).astype(np.uint32)
    found = None
    for number, lo in enumerate(range(0, shards.total, PASS_BLOCKS)):
        hi = min(lo + PASS_BLOCKS, shards.total)
        here = shards.spans(lo, hi)
        rows = (vocabulary.where(shard.isin(here)).select("word").mapInArrow(_blocks(shards, lo, hi), arrow_ddl(_BLOCKS))
                .groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow())
        bits = np.zeros(hi - lo, np.uint64)
        bits[rows.column("block").to_numpy() - lo] = rows.column("bits").to_numpy().view(np.uint64)
        held = spark.sparkContext.broadcast(bits)
        # a word probes its own length's filter and the one below
        from_here = sorted({x for x in here} | {min(x + 1, LAST_SHARD) for x in here})
        mine = sum(counts.get(x, 0) for x in from_here)
        probing = vocabulary.where(shard.isin(from_here)).repartition(-(-mine // TASK_WORDS), "word")
        # positives are written: a lost executor repeats a task, never the whole pass
        part = s.write(probing.mapInArrow(_edits(shards, lo, hi, alphabet, held), arrow_ddl(_EDITS)), f"edits{number}")
        held.unpersist()
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "word string, n long, other string, other_n long")
    return found.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other") \
        .select("word", "n", "other", "other_n")


def variants(vocabulary: DataFrame, ratio: int = 10) -> DataFrame:
    """Groups a vocabulary (word, n) into spelling variants.

    Two words are near if they differ by exactly one inserted, deleted or
    replaced letter (code point).  A word's ``form`` is its near word of largest
    n (ties: the smallest word), if that n is at least ``ratio`` times the
    word's own; ``root`` is where the forms lead.  Returns word, form, root, n,
    n_near (number of near words) and form_n; form and form_n are null for a
    word without a form, whose root is itself.  Rows with a null or empty word
    or a null n are left out, rows of one word are added up, other columns are
    ignored; an empty table gives none.  Words of any length are whole.
    """
    s = Scratch(vocabulary.sparkSession, "spelling")
    words = s.write(only(vocabulary, word="word", n="n").where("word <> '' and n is not null")
                    .groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_pairs(words, s)
    # each pair counts for both words; only the larger count can be a form
    both = pairs.select(F.explode(F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )).alias("p")).select("p.*")
    better = F.when(F.col("other_n") >= ratio * F.col("n"), F.struct((-F.col("other_n")).alias("least"), F.col("other").alias("form")))
    near = s.write(both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(better).alias("best"))
                   .select("word", "n_near", "best.form", (-F.col("best.least")).alias("form_n")), "near")
    roots = _followed(near.where("form is not null").select("word", F.col("form").alias("root")), s)
    return (words.join(near, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                    F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n"))


def _followed(forms: DataFrame, s: Scratch) -> DataFrame:
    """(word, root): pointers doubled until all lead to words without a form.
    Counts grow by the ratio along a path, so a few rounds are enough."""
    now, number = s.write(forms, "roots0"), 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        number += 1
        after = s.write(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                F.col("next").isNotNull().alias("moved")), f"roots{number}")
        now = after.select("word", "root")
        if not after.where("moved").head(1):
            return now


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of 7 letters or more that occur twice or more in all of ``documents``."""
    runs = misspelt(runs_of_letters(table(spark, sf_dir, "documents"), min_length=7))
    vocabulary = runs.where(F.length("run") >= 7).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return variants(vocabulary)


QUERIES = {"op11_spelling_variants": op11_spelling_variants}

_LOWER = "translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = {"op11_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT doc_id, {_LOWER} AS run FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
counted AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT run, n, {crc32_sql('k')} AS h FROM counted),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM vocab)),
near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
  UNION SELECT c.word, c.n, v.word, v.n FROM cuts c JOIN vocab v ON c.cut = v.word
  UNION SELECT v.word, v.n, c.word, c.n FROM cuts c JOIN vocab v ON c.cut = v.word),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(other_n) AS top, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * v.n THEN other END AS form,
                  CASE WHEN top >= 10 * v.n THEN top END AS form_n FROM vocab v LEFT JOIN best b ON v.word = b.word),
steps AS (SELECT word, word AS root, 0 AS d FROM formed UNION ALL SELECT s.word, f.form, d + 1 FROM steps s JOIN formed f ON s.root = f.word WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, d) AS root FROM steps GROUP BY word)
SELECT f.word, f.form, r.root, f.n, CAST(f.n_near AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM formed f JOIN roots r ON f.word = r.word
"""}
