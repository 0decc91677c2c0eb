"""Queries over the test tables, one or more per operator."""

from queries import (  # noqa: F401
    ask_queries,
    edge_queries,
    gate_queries,
    issue_queries,
    profile_queries,
    repair_queries,
    rule_queries,
    source_queries,
)
from queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
