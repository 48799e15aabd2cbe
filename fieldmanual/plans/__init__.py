"""Registered queries by area."""

from fieldmanual.plans import corpus, faults, graph, refresh, search, secure  # noqa: F401
from fieldmanual.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
