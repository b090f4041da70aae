"""Queries over the test tables, each with the SQL that must give the same rows."""

from tidemill.queries import checking, guarding, loading, marts, operating, profiling, relational  # noqa: F401
from tidemill.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
