"""All text queries."""

from cairn.llm import queries_links, queries_models, queries_tokens  # noqa: F401
from cairn.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
