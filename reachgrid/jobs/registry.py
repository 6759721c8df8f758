"""Registered queries over the given tables and their DuckDB SQL."""

from __future__ import annotations

from reachgrid.jobs.road_queries import ORACLE_SQL, QUERIES

FLAGSHIP = "travel_time_bands"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
