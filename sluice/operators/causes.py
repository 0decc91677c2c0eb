"""A likely cause for each issue: a lookup, refined by the issue's evidence."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import fixed
from sluice.operators.issues import Issue

CAUSE_SCHEMA = """
    id string, issue_id string, column string, category string, confidence double,
    summary string, evidence array<string>
"""

# What each category says about the column it was found in.
SUMMARIES = {
    "sentinel_encoding": "{column} was exported with words that stand for no value.",
    "display_formatting": "{column} was exported the way it is shown to people, not as plain numbers.",
    "invalid_entry": "{column} accepted text that does not fit its type.",
    "ingestion_replay": "the extract was loaded or appended more than once.",
    "conflicting_keys": "{column} does not identify one record: different rows share it.",
    "export_formatting": "{column} was typed or exported without trimming.",
    "inconsistent_entry": "{column} was filled in under several conventions.",
    "mixed_date_formats": "{column} mixes ways of writing a date.",
    "sign_convention": "{column} may hold refunds, reversals or sign errors.",
    "truncated_extract": "{column} is empty towards the end: a late column or a cut export.",
    "missingness": "{column} was optional, skipped or dropped upstream.",
    "unit_error": "{column} holds values of another order of magnitude: a unit or scale slip.",
    "outlier": "{column} holds rare values that may be real.",
    "unspecified": "{column} shows an issue with no known pattern.",
}


@dataclass
class Cause:
    id: str
    issue_id: str
    column: str | None
    category: str
    confidence: float
    summary: str
    evidence: list[str]


def _category(issue: Issue) -> tuple[str, float]:
    if issue.issue_type == "missing_values" and (issue.evidence.get("tail_ratio") or 0) >= fixed.TAIL_CLUSTER:
        return fixed.TRUNCATED_EXTRACT
    if issue.issue_type == "outliers" and issue.evidence.get("unit_scale"):
        return fixed.UNIT_ERROR
    return fixed.CAUSES.get(issue.issue_type, fixed.UNKNOWN_CAUSE)


def _details(issue: Issue) -> list[str]:
    shown = issue.evidence.get("tokens") or issue.evidence.get("examples")
    return [issue.description] + ([f"For example: {', '.join(shown)}."] if shown else [])


def explain(issues: Sequence[Issue]) -> list[Cause]:
    causes = []
    for number, issue in enumerate(issues, start=1):
        category, confidence = _category(issue)
        summary = SUMMARIES[category].format(column=issue.column or "the table")
        causes.append(
            Cause(f"C{number:03d}", issue.id, issue.column, category, confidence, summary, _details(issue))
        )
    return causes


def causes_frame(spark: SparkSession, causes: Sequence[Cause]) -> DataFrame:
    return spark.createDataFrame([asdict(cause) for cause in causes], CAUSE_SCHEMA)


def with_causes(issues: DataFrame) -> DataFrame:
    """Adds ``category`` and ``confidence`` to a (stored, possibly long) frame of issues."""
    spark = issues.sparkSession
    known = [(kind, *cause) for kind, cause in fixed.CAUSES.items()]
    lookup = spark.createDataFrame(known, "issue_type string, category string, confidence double")
    joined = issues.join(F.broadcast(lookup), "issue_type", "left")  # thirteen rows
    cut_off = (F.col("issue_type") == "missing_values") & (F.col("evidence.tail_ratio") >= fixed.TAIL_CLUSTER)
    slipped = (F.col("issue_type") == "outliers") & F.col("evidence.unit_scale")

    def pick(position: int, name: str):
        return (
            F.when(cut_off, F.lit(fixed.TRUNCATED_EXTRACT[position]))
            .when(slipped, F.lit(fixed.UNIT_ERROR[position]))
            .otherwise(F.coalesce(F.col(name), F.lit(fixed.UNKNOWN_CAUSE[position])))
        )

    return joined.withColumns({"category": pick(0, "category"), "confidence": pick(1, "confidence")})
