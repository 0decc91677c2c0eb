"""A write-audit-publish gate for tables, built on Spark DataFrames."""

from sluice.errors import GateError
from sluice.operators.inspection import Inspection
from sluice.plans.gate import Gate, audit
from sluice.rules import Rules
from sluice.sources.readers import Source, read

__all__ = ["Gate", "GateError", "Inspection", "Rules", "Source", "audit", "read"]
