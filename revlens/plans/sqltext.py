"""DuckDB SQL spellings of the text builders in ``functions.text``.

Used only by the SQL oracles: each helper returns a SQL expression string that
computes, in DuckDB, what the matching Column builder computes in Spark.
"""

from __future__ import annotations

from ..functions.words import (ASCII_PUNCT_CLASS, ENGLISH_STOP_WORDS, SMART_PUNCT_FROM,
                               SMART_PUNCT_TO, TREEBANK_SPLITS, WS_CLASS)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def list_lit(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


STOP_LIST = list_lit(sorted(set(ENGLISH_STOP_WORDS)))


def normalize(x: str) -> str:
    return f"lower(regexp_replace({x}, '[^a-zA-Z]+', ' ', 'g'))"


def normalize_stepwise_ascii(x: str) -> str:
    return (f"regexp_replace(regexp_replace(lower(regexp_replace({x}, '[^a-zA-Z]', ' ', 'g')),"
            f" '&lt;/?.*?&gt;', ' &lt;&gt; ', 'g'), '(\\d|\\W)+', ' ', 'g')")


def tokenize(norm: str) -> str:
    cases = " ".join(f"WHEN {q(w)} THEN [{q(a)}, {q(b)}]" for w, (a, b) in TREEBANK_SPLITS.items())
    return (f"flatten(list_transform(list_filter(string_split({norm}, ' '), lambda t: t <> ''),"
            f" lambda t: CASE t {cases} ELSE [t] END))")


def remove_stop(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: NOT list_contains({STOP_LIST}, t))"


def join_tokens(tokens: str) -> str:
    return f"array_to_string({tokens}, ' ')"


def clean_doc(x: str) -> str:
    toks = f"string_split_regex({x}, '[{WS_CLASS}]+')"
    toks = f"list_transform({toks}, lambda w: regexp_replace(w, '[{ASCII_PUNCT_CLASS}]', '', 'g'))"
    toks = f"list_filter({toks}, lambda w: regexp_full_match(w, '\\p{{L}}+') AND length(w) > 4)"
    toks = f"list_transform({toks}, lambda w: lower(w))"
    return remove_stop(toks)


def strip_lower(x: str) -> str:
    return f"lower(regexp_replace({x}, '^[{WS_CLASS}]+|[{WS_CLASS}]+$', '', 'g'))"


def clean_non_ascii(x: str) -> str:
    return (f"regexp_replace(translate({x}, {q(SMART_PUNCT_FROM)}, {q(SMART_PUNCT_TO)}),"
            f" '[^\\x00-\\x7F]+', '', 'g')")


def sentences(x: str) -> str:
    ws = "[\\t\\n\\x0B\\f\\r ]"
    marked = f"regexp_replace({x}, '([.!?]){ws}+', '\\1' || chr(30), 'g')"
    parts = f"string_split({marked}, chr(30))"
    parts = f"list_transform({parts}, lambda s: regexp_replace(s, '^{ws}+|{ws}+$', '', 'g'))"
    return f"list_filter({parts}, lambda s: s <> '')"


def words_of(x: str) -> str:
    return f"regexp_extract_all({x}, '\\p{{L}}+')"


def escape_brackets(x: str) -> str:
    return f"replace(replace({x}, '<', '&lt;'), '>', '&gt;')"


# corpus view in the reference's shape (documents + labels)
CORPUS_CTE = """corpus AS (
  SELECT d.doc_id, coalesce(d.text, '') AS text, d.lang AS genre, d.source AS title,
         CASE WHEN l.quality = 1 THEN 'Positive' WHEN l.quality = 0 THEN 'Negative' END AS review_type,
         d.lang || '_' || d.source || '_' ||
           CASE WHEN (CASE WHEN l.quality = 1 THEN 'Positive' WHEN l.quality = 0 THEN 'Negative' END)
                     IS NOT DISTINCT FROM 'Positive' THEN 'P' ELSE 'N' END
           || '_' || CAST(d.doc_id AS VARCHAR) AS descriptor
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
