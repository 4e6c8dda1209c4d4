from .clean_stream import clean_stream, run_available  # noqa: F401
