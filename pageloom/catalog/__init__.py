"""The query catalog behind ``__spark_entry__.py``."""

from . import index_queries, language_queries, page_queries, stream_queries, text_queries  # noqa: F401
