"""Tokens, vocabulary-level maps (lemma, stem) and bags of words.

Design: per-occurrence work stays in native array expressions; anything that
needs a lexicon or many rules (lemmas, stems) runs once per *distinct* token and is
joined back.  The join of occurrences with a vocabulary map is a plain equi
join: adaptive execution broadcasts the map when its measured size is small and
otherwise keeps a sort-merge join whose hot keys (frequent words) are split by
the skew-join rule.  Bags of words aggregate map-side first (partial counts),
so a word that holds a third of all tokens is pre-summed in every task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import blocks as BL
from ..functions import text as T
from ..functions.porter import porter_stem
from ..functions.words import ENGLISH_STOP_WORDS, NOUN_DETACHMENTS, WS_CLASS


# --- token tables ------------------------------------------------------------

def tokenize(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, tokens)``: normalise then tokenise."""
    return docs.select("doc_id", T.tokenize_words(T.normalize_text(F.col(text))).alias("tokens"))


def explode_tokens(df: DataFrame, tokens: str = "tokens", term: str = "term") -> DataFrame:
    """``(doc_id, pos, term)``: one row per token occurrence (position kept)."""
    return T.posexplode_rows(df, ["doc_id"], F.col(tokens), "pos", term)


def distinct_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Sorted distinct tokens over all documents (sorted on output only)."""
    return T.explode_rows(df, [], F.col(tokens), "token").distinct()


def bag_of_words(df: DataFrame, tokens: str = "tokens", min_len: int = 1) -> DataFrame:
    """``(doc_id, term, n)`` term counts per document (long, never wide)."""
    t = T.explode_rows(df, ["doc_id"], F.col(tokens), "term")
    if min_len > 1:
        t = t.where(F.length("term") >= min_len)
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


# --- lemmas --------------------------------------------------------------------

def lemma_candidates(vocab: DataFrame, token: str = "token") -> DataFrame:
    """``(token, cand, ord)``: the token itself (ord 0) and each detachment result."""
    t = F.col(token)
    cands = [F.struct(t.alias("cand"), F.lit(0).alias("ord"))]
    for i, (suf, rep) in enumerate(NOUN_DETACHMENTS, start=1):
        base = F.expr(f"substring({token}, 1, length({token}) - {len(suf)})")
        cands.append(F.struct(
            F.when(t.endswith(suf), F.concat(base, F.lit(rep))).alias("cand"),
            F.lit(i).alias("ord")))
    return (vocab.select(t.alias("token"), F.explode(F.array(*cands)).alias("c"))
            .select("token", "c.cand", "c.ord").where(F.col("cand").isNotNull()))


def lemma_map(vocab: DataFrame, lexicon: DataFrame | None = None) -> DataFrame:
    """``(token, lemma)`` for each distinct token.

    Candidates (token, then the noun detachment rules in order) are kept when the
    lexicon contains them; the lemma is the shortest kept candidate (earliest
    rule on ties), else the token itself.  The default lexicon is the
    vocabulary: a user supplies a dictionary's word list for dictionary lemmas.
    """
    vocab = vocab.select(F.col(vocab.columns[0]).alias("token")).distinct()
    cands = lemma_candidates(vocab)
    if lexicon is None:  # a candidate is known if it is itself a token (ord 0): no second reading of the vocabulary
        cands = cands.withColumn("known", F.max(F.col("ord") == 0).over(Window.partitionBy("cand")))
    else:
        lex = lexicon.select(F.col(lexicon.columns[0]).alias("cand")).distinct().withColumn("known", F.lit(True))
        cands = cands.join(lex, "cand", "left")
    known = F.coalesce("known", F.lit(False))
    # known candidates first, shortest, earliest rule; with none known every key
    # ties on (true, 0) and the token itself (ord 0) wins
    key = F.struct((~known).alias("unknown"), F.when(known, F.length("cand")).otherwise(0).alias("len"),
                   F.col("ord"))
    return cands.groupBy("token").agg(F.min_by("cand", key).alias("lemma"))


# --- stems ---------------------------------------------------------------------

def stem_map(vocab: DataFrame) -> DataFrame:
    """``(token, stem)``: Porter stems of the distinct tokens."""
    v = vocab.select(F.col(vocab.columns[0]).alias("token")).distinct()
    return v.select("token", porter_stem("token").alias("stem"))


# --- mapping token arrays through a vocabulary map ------------------------------

def map_tokens(df: DataFrame, mapping: DataFrame, tokens: str = "tokens", counts: DataFrame | None = None) -> DataFrame:
    """Replace every token by ``mapping(token, value)``; a null value drops the token.

    Occurrences are exploded with their position, joined to the map, and the
    arrays rebuilt per document in position order (one document per group: the
    group is bounded by the document's own length).  With ``counts`` (token, n),
    the occurrences of frequent tokens are not shuffled to the map; ``df``, the
    map and the counts should then be written tables.
    """
    m = mapping.toDF("term", "value").where(F.col("value").isNotNull())
    occ = explode_tokens(df, tokens)
    mapped = occ.join(m, "term") if counts is None else BL.joined(occ, m, "term", counts.toDF("term", "n"), "n")
    rebuilt = (mapped.groupBy("doc_id")
               .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("pv"))
               .select("doc_id", F.transform("pv", lambda s: s["value"]).alias(tokens)))
    # documents whose tokens were all removed keep an empty array
    return (df.select("doc_id").join(rebuilt, "doc_id", "left")
            .select("doc_id", F.coalesce(F.col(tokens), F.array().cast("array<string>")).alias(tokens)))


def clean_map(vocab: DataFrame, lexicon: DataFrame | None = None,
              stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """``(token, term)``: lemma -> stop-word filter (null) -> Porter stem.

    The full cleaning chain composed at vocabulary level, so the occurrences are
    joined only once.
    """
    lm = lemma_map(vocab, lexicon)
    # lemmas are about as many as tokens, so they are stemmed in place rather than deduplicated and joined back; stop-word lemmas map to
    # null, which the caller drops
    return lm.select("token", F.when(T.not_stop_word(F.col("lemma"), stop_words), porter_stem("lemma"))
                     .alias("term"))


def clean_tokens(docs: DataFrame, lexicon: DataFrame | None = None,
                 stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """normalise -> tokenise -> lemmatise -> stop words -> stem; ``(doc_id, tokens)``."""
    toks = BL.written(tokenize(docs), "tokens")
    counts = BL.written(T.explode_rows(toks, [], F.col("tokens"), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token_counts")
    return map_tokens(toks, BL.written(clean_map(counts.select("token"), lexicon, stop_words), "clean_map"), counts=counts)


def clean_bag_of_words(docs: DataFrame, lexicon: DataFrame | None = None,
                       stop_words=ENGLISH_STOP_WORDS) -> DataFrame:
    """Bag of words of ``clean_tokens`` without rebuilding arrays.

    Counts are taken on raw tokens first (map-side partial aggregation), then
    the vocabulary map is joined at (doc, token) level and counts re-summed per
    cleaned term.
    """
    bow = BL.written(bag_of_words(tokenize(docs)).withColumnRenamed("term", "token"), "token_bow")
    counts = BL.written(bow.groupBy("token").agg(F.count(F.lit(1)).alias("rows")), "token_counts")
    m = BL.written(clean_map(counts.select("token"), lexicon, stop_words).where(F.col("term").isNotNull()), "clean_map")
    return (BL.joined(bow, m, "token", counts, "rows")
            .groupBy("doc_id", "term").agg(F.sum("n").alias("n")))


# --- sentences with learned abbreviations -------------------------------------------

#: Score from which a word before a period is an abbreviation, and the share of
#: its occurrences that an abbreviation is supposed to have a period in.
ABBREVIATION, WITH_PERIOD = 0.3, 0.99
#: A word of letters and periods; what ends a sentence, with closing marks after it.
PERIOD_WORD, SENTENCE_END = r"^[^\p{L}]*(\p{L}[\p{L}.]*)$", "[.!?][\"')\\]]*$"


def sentence_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, pos, word, type, period)``: the words between white space; of
    those of letters and periods the lower-cased type without a last period, and
    whether they have one."""
    words = T.posexplode_rows(docs, ["doc_id"], F.split(F.col(text), f"[{WS_CLASS}]+"), "pos", "word").where("word <> ''")
    body = F.regexp_extract("word", PERIOD_WORD, 1)
    return (words.withColumn("body", F.when(body != "", F.lower(body)))
            .select("doc_id", "pos", "word", F.regexp_replace("body", r"\.$", "").alias("type"), F.col("body").endswith(".").alias("period")))


def abbreviations(words: DataFrame) -> DataFrame:
    """``(type, n, n_period, score)`` of the abbreviations among ``sentence_words``.

    Unsupervised, after Kiss and Strunk (2006): the log-likelihood ratio of
    "nearly always before a period" against "before a period as often as any
    word", less for long words, more for inner periods, and much less for each
    occurrence without a period."""
    g = words.where("type is not null").groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("period").cast("long")).alias("n_period"))
    # the share of all words that have a period: one number
    total = g.agg(F.sum("n").alias("n"), F.sum("n_period").alias("n_period"))
    p = F.least(F.greatest(F.col("t.n_period") / F.col("t.n"), F.lit(1e-9)), F.lit(1 - 1e-9))
    plain = F.col("n") - F.col("n_period")
    letters = F.length(F.replace("type", F.lit("."), F.lit("")))
    ratio = 2 * (F.col("n_period") * (F.lit(math.log(WITH_PERIOD)) - F.log(p)) + plain * (F.lit(math.log(1 - WITH_PERIOD)) - F.log(1 - p)))
    score = ratio * (F.length("type") - letters + 1) * F.exp(-letters - plain * F.log(letters.cast("double")))
    one = total.select(F.struct("n", "n_period").alias("t"), F.lit(1).alias("one"))
    scored = g.withColumn("one", F.lit(1)).join(F.broadcast(one), "one").select("type", "n", "n_period", F.round(score, 9).alias("score"))
    return scored.where((F.col("n_period") > 0) & (F.col("score") >= ABBREVIATION))


def learned_sentences(words: DataFrame, known: DataFrame) -> DataFrame:
    """``(doc_id, sent_id, sentence)``: the words up to one that ends in a mark of
    the end, unless that is the period of a ``known`` abbreviation (column
    ``type``) or of an initial; joined by one space.

    Words are split by document.  The abbreviations are broadcast: they are few, as the
    score falls with e to the number of letters and with each use without a period, while
    a join by type would bring all uses of a word (or all that are no words) to one task."""
    marked = words.join(F.broadcast(known.select("type", F.lit(True).alias("known"))), "type", "left")
    inner = F.coalesce(F.col("period"), F.lit(False)) & (F.coalesce(F.col("known"), F.lit(False)) | (F.length("type") == 1))
    ends = (F.col("word").rlike(SENTENCE_END) & ~inner).cast("int")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (marked.select("doc_id", "pos", "word", ends.alias("ends"))
                .withColumn("sent_id", F.coalesce(F.sum("ends").over(before), F.lit(0))))
    sentence = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ")
    return numbered.groupBy("doc_id", "sent_id").agg(sentence.alias("sentence"))
