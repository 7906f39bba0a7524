"""Queries over the test tables."""

from boxoffice.plans import report_queries, check_queries, change_queries, stream_queries  # noqa: F401, I001
from boxoffice.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
