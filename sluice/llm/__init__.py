"""Operators for preparing training text, and their queries."""

from sluice.llm import queries  # noqa: F401
from sluice.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
