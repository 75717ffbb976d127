"""All queries."""

from . import burst_queries, monitor_queries, series_queries, stream_queries, string_queries, text_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
