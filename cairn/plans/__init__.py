"""The registered queries."""

from cairn.plans import base, counts, graphs, pairs, retrieval
from cairn.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "base", "counts", "graphs", "pairs", "retrieval"]
