"""Named queries over the test tables, with their SQL equivalents."""

from __future__ import annotations

import importlib

from waymesh.sources.fixtures import duck

MODULES = ("graph_queries", "raster_queries", "metric_queries")


def _modules():
    return [importlib.import_module(f"waymesh.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: duck(t) for m in _modules() for k, t in m.SQL.items()}
