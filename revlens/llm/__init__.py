"""Training-data operators: deduplication, search, archives, tokenising,
language models, language identification and mixing.

``QUERIES`` and ``ORACLE_SQL`` hold the registered ``opN_<name>`` queries and
the DuckDB spelling of those that SQL can express.
"""

from .registry import ORACLE_SQL, QUERIES  # noqa: F401
