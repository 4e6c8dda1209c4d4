"""Language identification by Bayesian fusion of independent evidence.

The posterior of a language is the product of

* the text's likelihood under a byte-trigram model of the language (trigrams
  hashed to 2**16 buckets; an "und" model that gives every bucket the same
  probability stands for text of none of the languages),
* the reliability of the declared language (markup or metadata), P(declared |
  language), and
* the host's prior, smoothed hierarchically: host counts towards the shares of
  the host's address suffix, those towards the shares of the whole corpus.

Priors and reliabilities come from grouped sums of text-only posteriors over
all documents.  The trigram models are fitted on a bounded sample of labelled
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, list_array, only, record_batch, table, text_slices, thrifty
from .words import LOWER, utf8

#: Expected number of labelled rows per language that the trigram models are fitted on.
SAMPLE = 400
#: Languages that are modelled: those with the most labelled rows.
LANGUAGES = 200
BUCKETS = 1 << 16
UND = "und"
#: Overlapping trigrams count each byte three times.
DAMPING = 1 / 3

_LIKELIHOOD = pa.schema([("uid", pa.int64()), ("n", pa.int64()), ("ll", pa.list_(pa.float64()))])


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all byte trigrams of a batch (A-Z lower-cased) and each text's offsets."""
    data, offsets = utf8(texts)
    b = LOWER[data].astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    bucket = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.ones(len(bucket), bool)  # not across the end of a text
    for back in (1, 2):
        ends = offsets[1:-1] - back
        inside[ends[(ends >= 0) & (ends < len(bucket))]] = False
    kept = np.r_[0, np.cumsum(inside)]
    return bucket[inside], kept[np.minimum(offsets, len(bucket))]


def _counted(it):
    """Trigram counts (label, bucket, n) of labelled texts, one row per label and bucket and batch."""
    for b in it:
        labels = b.column("label").to_pylist()
        for label in sorted(set(labels)):
            rows = pa.array([i for i, x in enumerate(labels) if x == label])
            n = np.bincount(trigrams(b.column("text").take(rows))[0], minlength=BUCKETS)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(some), pa.string()), pa.array(some, pa.int64()),
                                              pa.array(n[some], pa.int64())], names=["label", "bucket", "n"])


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability of every bucket by language, "und" last) from
    the labelled rows of ``docs`` (text, label): about ``sample`` rows of each
    language, chosen by the hash of their text, of the ``LANGUAGES`` most frequent labels."""
    labelled = docs.where("label is not null and text is not null")
    counts = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(LANGUAGES)
    rates = {r["label"]: min(1.0, sample / r["n"]) for r in counts.collect()}
    languages = sorted(rates)
    logs = np.full((BUCKETS + 1, len(languages) + 1), -math.log(BUCKETS))
    if rates:
        rate = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))[F.col("label")]
        chosen = labelled.where(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)) < rate * (1 << 30))
        counts = (chosen.mapInArrow(_counted, "label string, bucket long, n long")
                  .groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow())
        column = {label: i for i, label in enumerate(languages)}
        table_ = np.full((BUCKETS, len(languages)), 0.5)
        label = np.array([column[x] for x in counts.column("label").to_pylist()], int)
        table_[counts.column("bucket").to_numpy(), label] += counts.column("n").to_numpy()
        logs[:BUCKETS, :-1] = np.log(table_ / table_.sum(0))
    logs[BUCKETS] = 0
    return languages, logs


def _likelihoods(model):
    def run(it):
        logs = model.value
        for b in text_slices(it):
            bucket, offsets = trigrams(b.column("text"))
            sums = np.zeros((b.num_rows, logs.shape[1]))
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            if len(some):
                sums[some] = np.add.reduceat(logs[bucket], offsets[some], axis=0)
            k = logs.shape[1]
            yield record_batch(_LIKELIHOOD, b.column("uid"), n,
                               list_array(np.arange(b.num_rows + 1) * k, (sums * DAMPING).ravel(), pa.float64()))
    return run


def _softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _total(posterior: Column, k: int) -> list[Column]:
    return [F.sum(posterior[i]).alias(f"c{i}") for i in range(k)]


def _smoothed(count: list[Column], parent: list[Column], strength: float) -> Column:
    n = sum(count[1:], count[0])
    return F.array(*((c + strength * p) / (n + strength) for c, p in zip(count, parent)))


def identify(docs: DataFrame, labels: str | None, host: str, declared: str | None = None, suffix: str | None = None,
             languages: tuple[str, ...] | None = None, model: tuple | None = None, least: float = 0.5, strength: float = 20.0,
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Language of every document.

    ``labels``: the column of known languages that the text models are fitted
    on (or give a ``model`` of ``fit``); ``declared``: a column of language
    tags ("en-GB" counts as "en"); ``host`` and ``suffix``: the address and the
    group of addresses it belongs to.  Where ``declared`` names the column of
    ``labels``, it is carried along but is no evidence: the text models were
    fitted on it.  Returns doc_id, declared, language,
    probability, text_language (by the text alone) and accepted, one row per
    input row.  A document is accepted if its most probable language has at
    least the probability ``least``, is not "und" and, if ``languages`` are
    given, is one of them.  A text of fewer than three bytes, an empty or a
    null one is "und".  A null or unknown declaration is no evidence; a null
    host has the prior of its suffix, a null suffix that of the corpus.
    """
    columns = {"doc_id": doc_id, "text": text, "host": host}
    columns |= {"declared": declared} if declared else {}
    columns |= {"suffix": suffix} if suffix else {}
    columns |= {"label": labels} if labels else {}
    base = only(docs, **columns)
    for name in ("declared", "suffix", "label"):
        if name not in columns:
            base = base.withColumn(name, F.lit(None).cast("string"))
    s = Scratch(docs.sparkSession, "languages")
    known, logs = model or fit(base.select("text", "label"))
    names = [*known, UND]
    k = len(names)
    shared = docs.sparkSession.sparkContext.broadcast(logs)
    evidence = base.select("doc_id", "host", "suffix", "declared", "text")
    fields = evidence.drop("text").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n long, ll array<double>"
    scored = s.write(evidence.mapInArrow(_beside(shared, [f.name for f in fields]), ddl), "scored")
    tag = F.lower(F.split(F.trim("declared"), "[-_]")[0]) if declared != labels else F.lit(None).cast("string")
    scored = scored.withColumn("tag", F.when(tag.isin(known), tag)).withColumn(
        "alone", _softmax(F.when(F.col("n") > 0, F.col("ll")).otherwise(F.array(*([F.lit(0.0)] * (k - 1) + [F.lit(60.0)])))))

    whole = scored.agg(*_total(F.col("alone"), k)).first()
    n = sum(x or 0 for x in whole) or 1
    corpus = [F.lit(((x or 0) + 1) / (n + k)) for x in whole]
    by = [F.col(f"c{i}") for i in range(k)]
    suffixes = (scored.where("suffix is not null").groupBy("suffix").agg(*_total(F.col("alone"), k))
                .select("suffix", _smoothed(by, corpus, strength).alias("suffix_prior")))
    suffixes = s.write(suffixes, "suffixes")
    hosts = (scored.groupBy("host", "suffix").agg(*_total(F.col("alone"), k)).where("host is not null or suffix is not null")
             .join(suffixes, "suffix", "left"))
    above = [F.coalesce(F.col("suffix_prior")[i], corpus[i]) for i in range(k)]
    prior = F.when(F.col("host").isNull(), F.array(*above)).otherwise(_smoothed(by, above, strength))
    hosts = s.write(hosts.select(F.col("host").alias("h"), F.col("suffix").alias("s"), prior.alias("prior")), "hosts")

    # P(declared | language): rows are languages, columns declared tags
    table_ = np.full((k, len(known)), 0.5)
    for r in scored.where("tag is not null").groupBy("tag").agg(*_total(F.col("alone"), k)).collect():
        table_[:, known.index(r["tag"])] += [r[f"c{i}"] for i in range(k)]
    table_ /= table_.sum(1, keepdims=True)
    said = {t: np.log(table_[:, j]).tolist() for j, t in enumerate(known)}
    nothing = F.array(*([F.lit(0.0)] * k))
    declared_log = nothing
    if said:
        declared_log = F.coalesce(F.create_map(*(x for t, v in said.items() for x in (F.lit(t), F.array(*map(F.lit, v)))))[F.col("tag")], nothing)

    joined = scored.join(hosts, F.col("host").eqNullSafe(F.col("h")) & F.col("suffix").eqNullSafe(F.col("s")), "left")
    prior = F.coalesce("prior", F.array(*corpus))
    logit = F.zip_with(F.zip_with(F.col("ll"), prior, lambda x, p: x + F.log(p)), declared_log, lambda x, d: x + d)
    fused = joined.withColumn("fused", F.when(F.col("n") > 0, _softmax(logit)).otherwise(F.col("alone")))
    labels_ = F.array(*map(F.lit, names))
    best = lambda p: F.element_at(labels_, F.array_position(p, F.array_max(p)).cast("int"))
    out = fused.select("doc_id", "declared", best(F.col("fused")).alias("language"), F.array_max("fused").alias("probability"),
                       best(F.col("alone")).alias("text_language"))
    accepted = (F.col("language") != UND) & (F.col("probability") >= least)
    if languages is not None:
        accepted = accepted & F.col("language").isin(*languages)
    return out.withColumn("accepted", accepted)


def _beside(model, fields: list[str]):
    """Likelihood rows beside the other columns of each document."""
    inner = _likelihoods(model)

    def run(it):
        for b in text_slices(it):
            uid = pa.array(np.arange(b.num_rows), pa.int64())
            got = pa.Table.from_batches(inner(iter([pa.RecordBatch.from_arrays([uid, b.column("text")], names=["uid", "text"])]))).combine_chunks()
            ll = got.column("ll").combine_chunks()
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in fields), got.column("n").combine_chunks(), ll],
                                             names=[*fields, "n", "ll"])
    return thrifty(run)


def address(url: Column) -> tuple[Column, Column]:
    """(host, suffix) of an address: the host in lower case without user, port and
    final dot, and its last label ("de" of "www.example.de").  Both are null where
    the address names no host; a bare name or a number (IP) has no suffix."""
    found = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]+)", 1)
    host = F.regexp_replace(found, r"\.+$", "")
    suffix = F.regexp_extract(host, r"\.([^.\d\[\]][^.\[\]]*)$", 1)
    return F.when(host != "", host), F.when(suffix != "", suffix)


def markup(html: Column) -> tuple[Column, Column]:
    """(declared language, text) of a page: the ``lang`` (or ``xml:lang``) attribute
    of its html tag, null where there is none, and what stands outside comments,
    scripts, styles and tags.  Character references become blanks."""
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    other = r"""(?:\s+[^\s=>"'/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))?)*?"""
    said = F.regexp_extract(bare, rf"""(?i)<html{other}\s+(?:xml:)?lang\s*=\s*["']?\s*([a-z0-9_-]+)""", 1)
    text = F.regexp_replace(F.regexp_replace(bare, r"</?[A-Za-z!?][^>]*>", " "), r"&#?\w+;", " ")
    return F.when(said != "", said), F.trim(F.regexp_replace(text, r"\s+", " "))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: ``source`` is the host and ``lang``, of a bounded sample, the
    label of the text models.  The table has neither addresses nor markup, so
    there is no suffix and no declared language beside the label."""
    return identify(table(spark, sf_dir, "documents"), labels="lang", host="source", declared="lang")


def op8_page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``, with every kind of evidence: host and suffix of the url, the
    html tag's declared language and the page's text under models of ``documents``.
    ``doc_id`` is the page_id."""
    (host, suffix), (declared, text) = address(F.col("url")), markup(F.col("html"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), suffix.alias("suffix"),
                                                 declared.alias("declared"), text.alias("text"))
    model = fit(table(spark, sf_dir, "documents").select("text", F.col("lang").alias("label")))
    return identify(pages, None, "host", "declared", "suffix", model=model, doc_id="page_id")


QUERIES = {"op8_language_id": op8_language_id, "op8_page_language_id": op8_page_language_id}
