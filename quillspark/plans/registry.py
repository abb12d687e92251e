"""Registered queries of the library's own operators, with their oracle SQL."""

from __future__ import annotations

from quillspark.plans.stream_queries import ORACLE, QUERIES

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES"]

FLAGSHIP = "a10_cross_facet"
