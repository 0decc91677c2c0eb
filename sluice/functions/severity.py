"""Severity bands and the score, on the driver and as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions import fixed

Bands = Sequence[tuple[float, str]]


def severity(ratio: float, bands: Bands) -> str | None:
    """Level of the highest band reached; None for a ratio of zero."""
    reached = [band for band in bands if 0 < ratio and band[0] <= ratio]
    return max(reached)[1] if reached else None


def severity_column(ratio: Column, bands: Bands) -> Column:
    """The same decision over a column of ratios."""
    level = F.lit(None).cast("string")
    for minimum, name in sorted(bands):
        level = F.when((ratio > 0) & (ratio >= minimum), F.lit(name)).otherwise(level)
    return level


def score(severities: Iterable[str]) -> int:
    return max(0, 100 - sum(fixed.SEVERITY_WEIGHTS.get(level, 0) for level in severities))


def score_column(level: Column) -> Column:
    """Aggregate expression: the score of all severities in a group."""
    weight = F.lit(0)
    for name, points in fixed.SEVERITY_WEIGHTS.items():
        weight = F.when(level == name, F.lit(points)).otherwise(weight)
    return F.greatest(F.lit(0), F.lit(100) - F.coalesce(F.sum(weight), F.lit(0))).cast("bigint")
