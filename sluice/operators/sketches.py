"""Column sketches that merge: approximate profiles of many extracts without reading them again.

One aggregate over one scan gives each column its counts, a HyperLogLog sketch of its distinct caseless
values and a KLL sketch of its numbers. No value table is built, so what is shuffled is a few kilobytes a
column and task, whatever the values. Sketches of extracts with the same columns merge into those of
all their rows, in any order, and are kept with the runs of a store for that.

Stated errors, at 99 %: distinct counts within ``DISTINCT_ERROR`` of the exact ones, and quantiles at a
rank within ``RANK_ERROR`` of the rank asked for. Counts, least, largest and mean are exact (the mean up to
rounding). Empty tables have counts of zero and no numbers; a column without numbers has no quantiles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.cells import Cell, cells_of, with_facts
from sluice.functions.sqltext import text
from sluice.rules import DEFAULT_RULES, Rules

_LG_BUCKETS = 14
_KLL_SIZE = 800
DISTINCT_ERROR = 0.025
RANK_ERROR = 0.005

SCHEMA = """name string, rows bigint, blank bigint, sentinel bigint, numbers bigint, low double, high double,
    total double, words binary, quantiles binary"""


def _measures(cell: Cell) -> dict[str, Column]:
    word = F.when(cell.present, F.lower(cell.bare))
    return {
        "rows": F.count(F.lit(1)),
        "blank": F.count_if(cell.blank),
        "sentinel": F.count_if(cell.sentinel),
        "numbers": F.count(cell.number),
        "low": F.min(cell.number),
        "high": F.max(cell.number),
        "total": F.sum(cell.number),
        "words": F.hll_sketch_agg(word, F.lit(_LG_BUCKETS)),
        "quantiles": F.kll_sketch_agg_double(cell.number, F.lit(_KLL_SIZE)),
    }


def sketch(df: DataFrame, rules: Rules = DEFAULT_RULES, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column, as SCHEMA says."""
    cells = cells_of(df, columns, rules)
    aggregates, structs = [], []
    for cell in cells:
        measures = _measures(cell)
        aggregates += [measure.alias(f"{name}_{cell.index}") for name, measure in measures.items()]
        fields = ", ".join(f"{name}_{cell.index} AS {name}" for name in measures)
        structs.append(f"struct({text(cell.name)} AS name, {fields})")
    if not cells:
        return df.sparkSession.createDataFrame([], SCHEMA)
    return with_facts(df, cells).agg(*aggregates).selectExpr(f"inline(array({', '.join(structs)}))")


def merged(sketches: DataFrame) -> DataFrame:
    """Sketches of several extracts below each other, put together by column name."""
    return sketches.groupBy("name").agg(
        *[F.sum(name).alias(name) for name in ("rows", "blank", "sentinel", "numbers")],
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.sum("total").alias("total"),
        F.hll_union_agg("words").alias("words"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
    )


def sketched_profile(sketches: DataFrame, shares: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """What sketches tell of each column: ``quartiles`` are the values at ``shares``, null without numbers."""
    at = F.array(*[F.lit(float(share)) for share in shares])
    share_of_rows = [
        F.round(F.col(name) / F.greatest("rows", F.lit(1)), 4).alias(f"{short}_pct")
        for name, short in (("blank", "null"), ("sentinel", "sentinel"))
    ]
    return sketches.select(
        "name",
        "rows",
        F.col("blank").alias("null_count"),
        F.col("sentinel").alias("sentinel_count"),
        *share_of_rows,
        F.hll_sketch_estimate("words").alias("unique_count"),
        F.col("numbers"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        (F.col("total") / F.when(F.col("numbers") > 0, F.col("numbers"))).alias("mean"),
        F.when(F.col("numbers") > 0, F.kll_sketch_get_quantile_double("quantiles", at)).alias("quartiles"),
    )
