from .fixtures import load_table, corpus, documents  # noqa: F401
