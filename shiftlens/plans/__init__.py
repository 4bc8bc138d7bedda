"""Queries over the bound tables, with oracle text."""

from __future__ import annotations

from importlib import import_module

from shiftlens.plans.registry import QUERIES, Query

FAMILIES = [
    "cohort_queries",
    "score_queries",
    "quality_queries",
    "text_queries",
    "answer_queries",
    "stored_queries",
]


def load() -> dict[str, Query]:
    """All registered queries."""
    if not QUERIES:
        for family in FAMILIES:
            import_module(f"shiftlens.plans.{family}").register()
    return QUERIES
