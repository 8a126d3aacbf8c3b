"""Named queries and the SQL that gives the same rows."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
