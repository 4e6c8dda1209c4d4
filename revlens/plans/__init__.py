"""Registered named queries.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the semantics are
expressible in SQL, ``ORACLE_SQL[name]`` holding the DuckDB spelling used as an
independent check.  Importing this package imports every catalog module.
"""

from .registry import QUERIES, ORACLE_SQL  # noqa: F401
from . import catalog_text, catalog_tfidf, catalog_ml, catalog_graph, catalog_vec, catalog_io  # noqa: F401,E402
