"""Language-model scoring with a log-bilinear model trained by noise contrast.

The model predicts an *outcome* from the two outcomes before it: a frequent
word, the end of a text, or a class of the other words (by their last two
bytes); a word has its share of its class by its count.  Logits are linear in
each context position, ``A[c1, w] + B[c2, w] + b[w]``, so one matrix product,
``exp(A) (exp(B) exp(b))^T``, holds the normaliser of every context and every
probability is normalised exactly.  A word that training never saw has the
Good-Turing share of unseen words; with it the probabilities of the V known
words and of "unseen" add up to one.

Counts cover all training documents (grouped by Spark).  Training is
data-parallel: a bounded sample gives the start, then every task goes over all
its training tokens and Spark averages the parameters.  Documents look up the
counts of frequent words in a bounded broadcast table, those of all others by a
join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .common import Scratch, arrow_ddl, only, record_batch, table, text_slices

#: Frequent words predicted one by one, word classes, and dimensions of the model.
SHORTLIST, CLASSES, DIM = 767, 256, 24
#: Words whose counts are broadcast (the most frequent ones).
FREQUENT = 1 << 18
#: Expected words of the sample that training starts on.
START_WORDS = 1_000_000
#: Targets of a step, noise samples shared by a step, and noise samples counted per target.
BATCH, SHARED_NOISE, NOISE = 2048, 64, 16
RATE = 0.1
#: Distinct words a task holds before it passes its counts on.
HELD = 1 << 20

_COUNTS = pa.schema([("h", pa.int64()), ("cls", pa.int32()), ("c", pa.int64())])
_PARAMETERS = pa.schema([("i", pa.int32()), ("value", pa.float64()), ("weight", pa.float64())])
_SCORED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base", pa.float64()), ("score", pa.float64()), ("h", pa.int64()), ("m", pa.int64()), ("l", pa.float64())])
END = int(W.mix(np.array([0xE0F], np.uint64)).view(np.int64)[0])


def word_classes(words: W.Words) -> np.ndarray:
    """Class of every word, from its last two bytes (A-Z lower-cased)."""
    last = W.LOWER[words.data[words.end - 1]].astype(np.uint64)
    before = np.where(words.end - words.start > 1, W.LOWER[words.data[np.maximum(words.end - 2, 0)]], 0).astype(np.uint64)
    return (W.mix(last * W.U(257) + before) % W.U(CLASSES)).astype(np.int32)


class Lookup:
    """Values of known hashes, -1 for all others; nearly every look-up is one access."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = W.U((1 << max(4, 2 + len(keys).bit_length())) - 1)
        slot = (keys & self.mask).astype(np.int64)
        self.key = np.zeros(int(self.mask) + 1, np.uint64)
        self.value = np.full(int(self.mask) + 1, -1, np.int64)
        self.key[slot], self.value[slot] = keys, values  # of a slot the last stays
        lost = self.key[slot] != keys
        order = np.argsort(keys[lost])
        self.lost, self.lost_values = keys[lost][order], values[lost][order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        slot = (h & self.mask).astype(np.int64)
        out = np.where(self.key[slot] == h, self.value[slot], -1)
        if len(self.lost):
            miss = np.flatnonzero(out < 0)
            at = np.minimum(np.searchsorted(self.lost, h[miss]), len(self.lost) - 1)
            out[miss] = np.where(self.lost[at] == h[miss], self.lost_values[at], -1)
        return out


@dataclass
class Vocabulary:
    """What scoring knows of the words: ``outcome`` of the shortlist and
    ``count`` of the frequent words by hash; ``class_total``: sum of (count +
    0.5) over the words of each class that are not in the shortlist."""

    short: np.ndarray
    frequent: np.ndarray
    frequent_counts: np.ndarray
    unigram: np.ndarray
    class_total: np.ndarray
    tokens: int
    types: int
    unseen: float
    end_count: int

    def tables(self):
        count = Lookup(self.frequent, self.frequent_counts)
        outcome = Lookup(self.short, np.arange(len(self.short)))
        return count, outcome


OUTCOMES = SHORTLIST + 1 + CLASSES
BEGIN = OUTCOMES  # context before the first token


def contexts(words: W.Words, outcome: Lookup):
    """Token stream of a batch: (outcomes, context 1, context 2, stream position
    of every word, of every end)."""
    n_docs = len(words.first) - 1
    first = words.first + np.arange(n_docs + 1)  # stream position of each document
    at_word = np.arange(len(words.hash)) + words.doc()
    at_end = first[1:] - 1
    y = np.empty(len(words.hash) + n_docs, np.int64)
    y[at_end] = SHORTLIST
    short = outcome(words.hash)
    y[at_word] = np.where(short >= 0, short, SHORTLIST + 1 + word_classes(words)) if len(short) else short
    c1, c2 = np.full(len(y), BEGIN), np.full(len(y), BEGIN)
    c1[1:], c2[2:] = y[:-1], y[:-2]
    c1[first[:-1]] = BEGIN
    c2[first[:-1]] = BEGIN
    second = first[:-1] + 1
    c2[second[second < len(y)]] = BEGIN
    return y, c1, c2, at_word, at_end


class Model:
    """Parameters: context vectors R, one matrix per context position, word
    vectors Q and biases b."""

    shapes = ((OUTCOMES + 1, DIM), (DIM, DIM), (DIM, DIM), (OUTCOMES, DIM), (OUTCOMES,))

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        self.parts, lo = [], 0
        for shape in self.shapes:
            n = int(np.prod(shape))
            self.parts.append(flat[lo:lo + n].reshape(shape))
            lo += n
        self.R, self.C1, self.C2, self.Q, self.b = self.parts

    @classmethod
    def start(cls, unigram: np.ndarray) -> "Model":
        rng = np.random.default_rng(17)
        flat = (rng.normal(size=sum(int(np.prod(s)) for s in cls.shapes)) * 0.1).astype(np.float32)
        out = cls(flat)
        out.C1[:] += np.eye(DIM, dtype=np.float32) * 0.5
        out.C2[:] += np.eye(DIM, dtype=np.float32) * 0.25
        out.b[:] = np.log(unigram)
        return out

    def log_probabilities(self, possible: np.ndarray):
        """(A, B, log Z) in nats, for all contexts and outcomes, with b in A."""
        r = self.R.astype(np.float64)
        q = self.Q.astype(np.float64)
        a, b = r @ self.C1 @ q.T + self.b, r @ self.C2 @ q.T
        a[:, ~possible] = -np.inf
        top_a, top_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        z = np.exp(a - top_a) @ np.exp(b - top_b).T
        return a, b, np.log(np.maximum(z, 1e-300)) + top_a + top_b.T


def _scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the value rows by row number."""
    return np.stack([np.bincount(rows, values[:, k], n) for k in range(values.shape[1])], 1)


class Trainer:
    """Noise-contrastive estimation with Adagrad steps over token batches."""

    def __init__(self, flat: np.ndarray, unigram: np.ndarray, seed: int):
        self.model = Model(flat.copy())
        self.squares = np.full(len(flat), 1e-3, np.float32)
        self.noise = unigram / unigram.sum()
        self.log_noise = np.log(self.noise * NOISE).astype(np.float32)
        self.rng, self.tokens = np.random.default_rng(seed), 0
        self.cumulative = np.cumsum(self.noise)

    def step(self, y, c1, c2) -> None:
        m = self.model
        drawn = np.minimum(np.searchsorted(self.cumulative, self.rng.random(SHARED_NOISE)), OUTCOMES - 1)
        r1, r2 = m.R[c1], m.R[c2]
        guess = r1 @ m.C1 + r2 @ m.C2
        target, others = m.Q[y], m.Q[drawn]
        logit = np.einsum("ij,ij->i", guess, target) + m.b[y] - self.log_noise[y]
        pull = 1 / (1 + np.exp(np.clip(logit, -30, 30)))
        away = guess @ others.T + m.b[drawn] - self.log_noise[drawn]
        push = (-NOISE / SHARED_NOISE) / (1 + np.exp(-np.clip(away, -30, 30)))
        d_guess = pull[:, None] * target + push @ others
        d_q = _scatter(y, pull[:, None] * guess, OUTCOMES) + _scatter(drawn, push.T @ guess, OUTCOMES)
        d_b = np.bincount(y, pull, OUTCOMES) + np.bincount(drawn, push.sum(0), OUTCOMES)
        d_r = _scatter(c1, d_guess @ m.C1.T, OUTCOMES + 1) + _scatter(c2, d_guess @ m.C2.T, OUTCOMES + 1)
        gradient = np.concatenate([d_r.ravel(), (r1.T @ d_guess).ravel(), (r2.T @ d_guess).ravel(), d_q.ravel(), d_b]).astype(np.float32)
        gradient /= len(y)
        self.squares += gradient * gradient
        m.flat += RATE * gradient / np.sqrt(self.squares)
        self.tokens += len(y)


def _train(vocabulary, start, seed: int):
    """Every task trains on all tokens of its documents; rows are its parameters."""
    def run(it):
        v = vocabulary.value
        _, outcome = v.tables()
        trainer = Trainer(start.value, v.unigram, seed)
        for b in text_slices(it):
            y, c1, c2, *_ = contexts(W.split(b.column("text"), lower=True), outcome)
            for lo in range(0, len(y), BATCH):
                trainer.step(y[lo:lo + BATCH], c1[lo:lo + BATCH], c2[lo:lo + BATCH])
        if trainer.tokens:
            flat = trainer.model.flat.astype(np.float64)
            yield record_batch(_PARAMETERS, np.arange(len(flat), dtype=np.int32), flat * trainer.tokens,
                               np.full(len(flat), float(trainer.tokens)))
    return run


def _averaged(parameters: DataFrame, before: np.ndarray) -> np.ndarray:
    got = parameters.groupBy("i").agg(F.sum("value").alias("value"), F.sum("weight").alias("weight")).toArrow()
    out = before.copy()
    if len(got):
        out[got.column("i").to_numpy()] = got.column("value").to_numpy() / got.column("weight").to_numpy()
    return out


def _counted(it):
    """Word counts of a task's documents (end tokens included)."""
    held, waiting = [], 0

    def summed():
        h, cls, c = (np.concatenate(x) for x in zip(*held))
        keys, at, back = np.unique(h, return_index=True, return_inverse=True)
        return keys, cls[at], np.bincount(back, c).astype(np.int64)
    for b in text_slices(it):
        words = W.split(b.column("text"), lower=True)
        keys, at, n = np.unique(words.hash, return_index=True, return_counts=True)
        cls = word_classes(words)[at] if len(at) else np.zeros(0, np.int32)
        held.append((np.r_[keys.view(np.int64), END], np.r_[cls, 0], np.r_[n, b.num_rows]))
        waiting += len(keys) + 1
        if waiting > 4 * HELD:
            held = [summed()]
            waiting = len(held[0][0])
            if waiting > HELD:
                yield record_batch(_COUNTS, held[0][0], held[0][1].astype(np.int32), held[0][2])
                held, waiting = [], 0
    if held:
        keys, cls, c = summed()
        yield record_batch(_COUNTS, keys, cls.astype(np.int32), c)


def _vocabulary(counts: DataFrame) -> Vocabulary:
    end = counts.where(F.col("h") == END).first()
    end_count = end["c"] if end else 0
    tokens, types, once = counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long"))).first()
    tokens = tokens or 0
    top = counts.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c, cls = (top.column(x).to_numpy() for x in ("h", "c", "cls"))
    short = min(SHORTLIST, len(h))
    by_class = counts.where(F.col("h") != END).groupBy("cls").agg(F.sum(F.col("c") + 0.5).alias("t"), F.sum("c").alias("c")).collect()
    total, seen = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        total[r["cls"]], seen[r["cls"]] = r["t"], r["c"]
    total -= np.bincount(cls[:short], c[:short] + 0.5, CLASSES)
    seen -= np.bincount(cls[:short], c[:short], CLASSES)
    total[seen < 0.5] = 0
    unigram = np.zeros(OUTCOMES)
    unigram[:short], unigram[SHORTLIST], unigram[SHORTLIST + 1:] = c[:short], end_count, seen
    unigram = np.maximum(unigram, 1e-3)
    return Vocabulary(h[:short].view(np.uint64), h.view(np.uint64), c, unigram / unigram.sum(), total, tokens, types,
                      min(0.5, ((once or 0) + 0.5) / (tokens + 1)), end_count)


def _scored(vocabulary, model):
    def run(it):
        v = vocabulary.value
        a, b_, log_z = model.value
        count, outcome = v.tables()
        uid = TaskContext.get().partitionId() << 40
        per_log = 1 / np.log(10)
        whole = v.tokens + 0.5 * (v.types + 1)
        with np.errstate(divide="ignore"):
            log_class = np.log10(v.class_total)
        known_share = np.log10(1 - v.unseen)
        for b in text_slices(it):
            words = W.split(b.column("text"), lower=True)
            y, c1, c2, at_word, at_end = contexts(words, outcome)
            n_docs = b.num_rows
            doc = words.doc()
            log_p = (a[c1, y] + b_[c2, y] - log_z[c1, c2]) * per_log + known_share
            c = count(words.hash)
            have = np.flatnonzero(c >= 0)
            base = np.bincount(doc[have], np.log10((c[have] + 0.5) / whole), n_docs).astype(float)  # of no rows: integers
            cls = y[at_word] - SHORTLIST - 1
            in_class = have[cls[have] >= 0]
            score = np.bincount(doc[have], log_p[at_word[have]], n_docs).astype(float)
            score += np.bincount(doc[in_class], np.log10(c[in_class] + 0.5) - log_class[cls[in_class]], n_docs)
            base += np.log10((v.end_count + 0.5) / whole)
            score += log_p[at_end] if v.end_count else np.log10(v.unseen)
            ids = uid + np.arange(n_docs)
            uid += n_docs
            n_known = np.bincount(doc[have], minlength=n_docs) + (1 if v.end_count else 0)
            none = pa.nulls(n_docs, pa.int64())
            yield record_batch(_SCORED, ids, b.column("doc_id"), b.column("held_out"), words.counts + 1, n_known, base, score,
                               none, none, none.cast(pa.float64()))
            rare = np.flatnonzero(c < 0)
            if len(rare):
                order = rare[np.lexsort((words.hash[rare], doc[rare]))]
                head = np.flatnonzero(np.r_[True, (words.hash[order][1:] != words.hash[order][:-1]) | (doc[order][1:] != doc[order][:-1])])
                m = np.diff(np.r_[head, len(order)])
                # of a class that holds no known word, the word is unseen and l is not used
                l = np.add.reduceat(np.where(np.isfinite(log_class[cls[order]]), log_p[at_word[order]] - log_class[cls[order]], 0), head)
                none = pa.nulls(len(head), pa.int64())
                yield record_batch(_SCORED, ids[doc[order[head]]], none, none.cast(pa.bool_()), none, none, none.cast(pa.float64()),
                                   none.cast(pa.float64()), words.hash[order[head]].view(np.int64), m, l)
    return run


def score_documents(docs: DataFrame, held_out, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """log10 probabilities of all texts by a model learnt from those that are
    not ``held_out`` (a Column over ``docs``; null counts as false).

    Returns doc_id, held_out, n_tokens (words and one end), n_known,
    train_tokens, base_score (unigram with 0.5 added to each count) and score,
    one row per input row.  A null or empty text has only the end token.  Rows
    with equal or no doc_id are documents like any other.  With nothing to
    learn from, every word is unseen.  Other columns are ignored; an empty
    table gives none.
    """
    spark = docs.sparkSession
    s = Scratch(spark, "lm")
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"))
    training = base.where("not held_out").select("text")
    rows = training.mapInArrow(_counted, arrow_ddl(_COUNTS))
    counts = s.write(rows.groupBy("h").agg(F.first("cls").alias("cls"), F.sum("c").alias("c")), "counts")
    v = _vocabulary(counts)
    vocabulary = spark.sparkContext.broadcast(v)
    flat = Model.start(v.unigram).flat
    share = min(1.0, START_WORDS / max(1, v.tokens))
    start = training.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    for part in (start.coalesce(1), training):
        flat = _averaged(part.mapInArrow(_train(vocabulary, spark.sparkContext.broadcast(flat), 5), arrow_ddl(_PARAMETERS)), flat)
    possible = np.r_[np.arange(SHORTLIST) < len(v.short), v.end_count > 0, v.class_total > 0]
    model = spark.sparkContext.broadcast(Model(flat).log_probabilities(possible) if possible.any() else
                                         (np.zeros((OUTCOMES + 1, OUTCOMES)), np.zeros((OUTCOMES + 1, OUTCOMES)),
                                          np.zeros((OUTCOMES + 1, OUTCOMES + 1))))
    scored = s.write(base.mapInArrow(_scored(vocabulary, model), arrow_ddl(_SCORED)), "scored")
    rare = scored.where("h is not null").select("uid", "h", "m", "l").join(counts.select("h", "c"), "h", "left")
    whole = v.tokens + 0.5 * (v.types + 1)
    seen = F.col("c").isNotNull()
    more = rare.groupBy("uid").agg(
        F.sum(F.when(seen, F.col("m")).otherwise(0)).alias("known"),
        F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / whole)).alias("more_base"),
        F.sum(F.when(seen, F.col("l") + F.col("m") * F.log10(F.col("c") + 0.5))
              .otherwise(F.col("m") * float(np.log10(v.unseen)))).alias("more_score"))
    out = scored.where("h is null").drop("h", "m", "l").join(more, "uid", "left")
    zero = F.lit(0.0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
                      F.lit(v.tokens).cast("long").alias("train_tokens"),
                      (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
                      (F.col("score") + F.coalesce("more_score", zero)).alias("score"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``; those whose crc32(doc_id as text) leaves 1 divided by 5 are held out."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return score_documents(table(spark, sf_dir, "documents"), remainder == 1)


QUERIES = {"op7_lm_scoring": op7_lm_scoring}
