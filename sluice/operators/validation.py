"""The publish decision: five checks over the issues that remain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions.severity import score, score_column
from sluice.operators.issues import Issue
from sluice.rules import DEFAULT_RULES, Rules


@dataclass
class Check:
    name: str
    passed: bool
    detail: str


@dataclass
class Validation:
    score_before: int
    score_after: int
    checks: list[Check]

    @property
    def passed(self) -> bool:
        return all(check.passed for check in self.checks)


def score_of(issues: Sequence[Issue]) -> int:
    return score(issue.severity for issue in issues)


def validate(
    rows_before: int,
    rows_after: int,
    columns: int,
    residual: Sequence[Issue],
    score_before: int,
    rules: Rules = DEFAULT_RULES,
) -> Validation:
    after = score_of(residual)
    levels = [issue.severity for issue in residual]
    critical, high = levels.count("critical"), levels.count("high")
    checks = [
        Check("non_empty", rows_after > 0 and columns > 0, f"{rows_after} rows, {columns} columns"),
        Check(
            "rows_retained",
            rows_after >= rules.min_rows_retained * rows_before,
            f"{rows_after} of {rows_before} rows kept",
        ),
        Check("no_critical_issues", critical == 0, f"{critical} critical issues"),
        Check("no_high_issues", high == 0, f"{high} high issues"),
        Check("quality_score", after >= rules.pass_score, f"score {after}, needed {rules.pass_score}"),
    ]
    return Validation(score_before, after, checks)


def checks_by_run(issues: DataFrame, runs: DataFrame, rules: Rules = DEFAULT_RULES) -> DataFrame:
    """The same five checks for every run of a stored history at once.

    ``issues`` has ``run_id`` and ``severity``; ``runs`` has ``run_id``,
    ``rows_before``, ``rows_after`` and ``columns``.
    """
    levels = issues.groupBy("run_id").agg(
        score_column(F.col("severity")).alias("score_after"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "high").alias("high"),
    )
    joined = runs.join(levels, "run_id", "left").na.fill(0, ["critical", "high"]).na.fill(100, ["score_after"])
    made = {
        "non_empty": (F.col("rows_after") > 0) & (F.col("columns") > 0),
        "rows_retained": F.col("rows_after") >= F.col("rows_before") * rules.min_rows_retained,
        "no_critical_issues": F.col("critical") == 0,
        "no_high_issues": F.col("high") == 0,
        "quality_score": F.col("score_after") >= rules.pass_score,
    }
    passed = F.lit(True)
    for name in made:
        passed &= F.col(name)
    return joined.withColumns(made).withColumn("passed", passed)
