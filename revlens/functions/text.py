"""Text cleaning as native Column expressions (whole-stage codegen, no Python).

Each builder takes a Column (or column name) and returns a Column, so the same
expressions run in batch and streaming plans.  Regexes are written so that the
Java engine gives the same answer as Python's ``re`` on the same input:
``(?d)`` makes ``.`` stop only at ``\\n`` and whitespace/punctuation classes are
spelled out (see ``words``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .words import (ASCII_PUNCT_CLASS, ENGLISH_STOP_WORDS, SMART_PUNCT_FROM,
                    SMART_PUNCT_TO, TREEBANK_SPLITS, WS_CLASS)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_array(words) -> Column:
    """A literal array<string>; folded once by the optimizer."""
    return F.array(*[F.lit(w) for w in words])


# --- the four normalisation steps -------------------------------------------

def remove_punctuation(c) -> Column:
    """Every character outside a-z/A-Z becomes one space (digits, accents too)."""
    return F.regexp_replace(_c(c), "[^a-zA-Z]", " ")


def lower_case(c) -> Column:
    return F.lower(_c(c))


def remove_tags(c) -> Column:
    """HTML-escaped tags ``&lt;...&gt;`` (shortest, within a line) -> `` &lt;&gt; ``."""
    return F.regexp_replace(_c(c), "(?d)&lt;/?.*?&gt;", " &lt;&gt; ")


def collapse_non_letters(c) -> Column:
    """Runs of digits / non-word characters -> one space (``_`` stays)."""
    return F.regexp_replace(_c(c), r"(?U)(\d|\W)+", " ")


def normalize_text(c) -> Column:
    """remove_punctuation -> lower -> remove_tags -> collapse, as one pass.

    After the first step only ASCII letters and spaces remain, so the tag step
    can never match (no ``&``/``;`` left) and the collapse step only merges
    space runs.  The composition is therefore exactly "runs of non-letters ->
    one space, then lower-case", which is what we evaluate (one regex pass over
    the text instead of four).  Leading/trailing single spaces stay.
    """
    return F.lower(F.regexp_replace(_c(c), "[^a-zA-Z]+", " "))


def normalize_text_stepwise(c) -> Column:
    """The literal four-step chain; kept for tests of ``normalize_text``."""
    return collapse_non_letters(remove_tags(lower_case(remove_punctuation(c))))


# --- tokenising ------------------------------------------------------------

# "cannot" -> "can not", ...: a space is inserted after the first part when
# the second part follows and ends the word (one regex pass, no per-token code)
_SPLIT_RE = r"\b(" + "|".join(rf"{a}(?={b}\b)" for a, b in TREEBANK_SPLITS.values()) + r")"


def tokenize_words(c) -> Column:
    """Word tokens of *normalised* text (letters and single spaces only).

    On such text the Treebank tokenizer reduces to a split on spaces plus the
    whole-word contraction splits (cannot -> can not, ...).  Written without
    higher-order functions so it stays inside whole-stage codegen.
    """
    s = F.trim(F.regexp_replace(_c(c), _SPLIT_RE, "$1 "))
    return F.array_remove(F.split(s, " "), "")  # "" -> [""] -> []


def not_stop_word(t: Column, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """True unless ``t`` is a stop word.  ``isin`` over many literals becomes a
    hash-set lookup (InSet), not a scan of the list per token."""
    return ~t.isin(sorted(set(stop_words)))


def remove_stop_words(tokens, stop_words=ENGLISH_STOP_WORDS) -> Column:
    return F.filter(_c(tokens), lambda t: not_stop_word(t, stop_words))


def join_tokens(tokens) -> Column:
    return F.array_join(_c(tokens), " ")


def clean_doc(c, stop_words=ENGLISH_STOP_WORDS) -> Column:
    """split on whitespace -> strip ASCII punctuation -> alphabetic only ->
    longer than 4 -> lower -> stop words (no stemming).

    Punctuation is removed from the whole text before the split: punctuation is
    never whitespace, so the words are the same as stripping each word, at one
    regex pass per text instead of one per word.
    """
    toks = F.split(F.regexp_replace(_c(c), f"[{ASCII_PUNCT_CLASS}]", ""), f"[{WS_CLASS}]+")
    toks = F.filter(toks, lambda w: (F.length(w) > 4) & w.rlike(r"^\p{L}+$"))
    toks = F.transform(toks, lambda w: F.lower(w))
    return remove_stop_words(toks, stop_words)


# --- raw-text variants -------------------------------------------------------

def strip_lower(c) -> Column:
    """Python ``text.strip().lower()``: trims all Unicode whitespace, not only spaces."""
    return F.lower(F.regexp_replace(_c(c), f"^[{WS_CLASS}]+|[{WS_CLASS}]+$", ""))


def clean_non_ascii(c) -> Column:
    """Control-code smart quotes/dashes -> ASCII, then drop any other non-ASCII."""
    return F.regexp_replace(F.translate(_c(c), SMART_PUNCT_FROM, SMART_PUNCT_TO),
                            r"[^\x00-\x7F]+", "")


# --- sentences -------------------------------------------------------------

SENTENCE_BREAK = "\u001e"  # record separator: never produced by the marks step


def sentences(c) -> Column:
    """Sentences: a break after ``.``, ``!`` or ``?`` followed by whitespace.

    A rule-based stand-in for a parser's sentence splitter.  Pieces are trimmed
    of whitespace and empty pieces dropped.
    """
    marked = F.regexp_replace(_c(c), r"([.!?])[\t\n\x0B\f\r ]+", "$1" + SENTENCE_BREAK)
    parts = F.split(marked, SENTENCE_BREAK)
    parts = F.transform(parts, lambda s: F.btrim(s, F.lit("\t\n\x0b\f\r ")))  # a regular expression would be tried at every character
    return F.filter(parts, lambda s: s != "")


def words_of(c) -> Column:
    """Letter runs of a string (used by the rule-based annotators)."""
    return F.regexp_extract_all(_c(c), F.lit(r"(\p{L}+)"), 1)


def lower_words(words) -> Column:
    return F.transform(_c(words), lambda w: F.lower(w))


def escape_html_brackets(c) -> Column:
    """``<``/``>`` -> ``&lt;``/``&gt;`` (the escaped-HTML form ``remove_tags`` expects)."""
    return F.replace(F.replace(_c(c), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


# --- exploding computed arrays ------------------------------------------------
# ``explode(f(x))`` makes the optimizer infer a ``size(f(x)) > 0`` filter and push
# it below any exchange under the generator, so ``f`` (e.g. the whole
# tokeniser) would run twice, the first time before the data is spread out.
# The outer generators infer nothing; the null row of an empty array is then
# dropped on the generated column, which cannot move below the generator.

def explode_rows(df, keep, arr, alias: str):
    """Rows ``keep + [alias]``, one per element of ``arr`` (no empty-array rows)."""
    return df.select(*keep, F.explode_outer(arr).alias(alias)).where(F.col(alias).isNotNull())


def posexplode_rows(df, keep, arr, pos: str, alias: str):
    """Like ``explode_rows`` with the 0-based element position in ``pos``."""
    return df.select(*keep, F.posexplode_outer(arr).alias(pos, alias)).where(F.col(pos).isNotNull())
