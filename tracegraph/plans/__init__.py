"""Registered queries with their checking SQL."""

from tracegraph.plans import extracted, graphs, lookups, ranking, scalars, sources  # noqa: F401
from tracegraph.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
