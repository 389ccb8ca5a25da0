"""All registered queries."""

from cairn.plans import queries_itinerary, queries_loops, queries_network, queries_scoring, queries_trips  # noqa: F401
from cairn.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
