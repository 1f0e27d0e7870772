"""Named queries with their SQL oracles."""

from . import interval_queries, relation_queries, row_queries, stream_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "interval_queries", "relation_queries", "row_queries", "stream_queries"]
