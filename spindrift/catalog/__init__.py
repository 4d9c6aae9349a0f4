"""Registered queries over the test tables, each with SQL for DuckDB where SQL can express it."""

from __future__ import annotations

from spindrift.catalog import evidence, graph, pages, pipeline, scheduling, searching
from spindrift.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evidence", "graph", "pages", "pipeline", "scheduling", "searching"]
