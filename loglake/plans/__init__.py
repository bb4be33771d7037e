"""Registered queries and the data they run on."""

from __future__ import annotations

import importlib

_MODULES = [
    "q_aggregates",
    "q_filters",
    "q_ingest",
    "q_joins",
    "q_alerts",
    "q_schema",
    "q_matviews",
    "q_tiers",
    "q_storage",
    "q_streaming",
    "q_functions",
]


def all_queries():
    """(name -> callable, name -> SQL) of every registered query."""
    for name in _MODULES:
        importlib.import_module(f"loglake.plans.{name}")
    from loglake.plans.registry import ORACLES, QUERIES

    return dict(QUERIES), dict(ORACLES)
