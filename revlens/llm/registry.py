"""Collects the registered queries of the operator modules."""

from __future__ import annotations

from collections.abc import Callable

from . import (byte_bpe, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, multi_index, ngram_join, prefix_trie,
               secret_scan, spelling, substring_dedup, warc)

_MODULES = (byte_bpe, embedding_dedup, language_id, line_dedup, lm_scoring, mixing, multi_index, ngram_join, prefix_trie,
            secret_scan, spelling, substring_dedup, warc)

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
for _m in _MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE_SQL.update(getattr(_m, "ORACLE_SQL", {}))
