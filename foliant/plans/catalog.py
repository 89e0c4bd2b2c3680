"""Registered queries and their SQL, by name. Each runs over its whole tables and whole texts."""

from __future__ import annotations

from foliant.plans import graph_queries, layout_queries, linear_queries, pair_queries, raster_queries
from foliant.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "graph_queries", "layout_queries", "linear_queries", "pair_queries", "raster_queries"]
