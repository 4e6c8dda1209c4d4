from . import text, words  # noqa: F401
