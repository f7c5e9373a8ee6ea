"""All queries of this library but those of its optional subpackage."""

from . import context_queries, interval_queries, matching_queries, row_queries, series_queries  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
