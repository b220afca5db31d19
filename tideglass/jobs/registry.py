"""Queries over the given tables and their DuckDB twins, by operator name."""

from __future__ import annotations

from tideglass.jobs import (  # noqa: F401
    attention_queries,
    extract_queries,
    forest_queries,
    match_queries,
    pair_queries,
    profile_queries,
    scalar_queries,
    stream_queries,
)
from tideglass.jobs.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
